import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import merge, stats, survival
from cohortspark.operators.ordered import by_richness, quantiles, row_numbers


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame(
        [(1, "l1", "x"), (2, "l2", "x"), (2, "l2b", "y"), (None, "ln", "y"), (7, "l7", "z")], "id int, note string, a string"
    )
    right = spark.createDataFrame([(2, "r2", 1.0), (2, None, 2.0), (None, "rn", 3.0), (9, "r9", 4.0)], "key int, note string, b double")
    return left, right


MATCHED = [
    (2, "r2", "x", 2, 1.0), (2, None, "x", 2, 2.0), (2, "r2", "y", 2, 1.0), (2, None, "y", 2, 2.0), (None, "rn", "y", None, 3.0),
]
LEFT_ONLY = [(1, "l1", "x", None, None), (7, "l7", "z", None, None)]
RIGHT_ONLY = [(None, "r9", None, 9, 4.0)]


@pytest.mark.parametrize(
    ("how", "want"),
    [
        ("inner", MATCHED), ("left", MATCHED + LEFT_ONLY), ("right", MATCHED + RIGHT_ONLY),
        ("outer", MATCHED + LEFT_ONLY + RIGHT_ONLY),
    ],
)
def test_merge(sides, rows, how, want):
    df = merge.merge(*sides, "id", "key", how)
    assert df.columns == ["id", "note", "a", "key", "b"]
    assert rows(df) == sorted(want, key=lambda t: tuple((v is not None, str(v)) for v in t))


def test_merge_empty_sides(sides):
    left, right = sides
    assert merge.merge(left.limit(0), right, "id", "key", "outer").count() == 4
    assert merge.merge(left, right.limit(0), "id", "key", "left").count() == 5
    with pytest.raises(ValueError):
        merge.merge(left, right, "id", "key", "cross")


def test_same_key_name_on_both_sides(spark, rows):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, l string")
    right = spark.createDataFrame([(2, "c"), (3, "d")], "id int, r string")
    assert rows(merge.merge(left, right, "id", "id", "outer")) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]


def test_metadata_wins_where_it_matches(spark, rows):
    data = spark.createDataFrame([("s1", "own", 1), ("s2", "own", 2)], "sid string, kind string, v int")
    meta = spark.createDataFrame([("s1", None)], "sample_id string, kind string")
    assert rows(merge.with_metadata(data, meta, "sid")) == [("s1", None, 1, "s1"), ("s2", "own", 2, None)]
    assert rows(merge.of_samples(data, meta, "sid")) == [("s1", "own", 1)]


def test_clinical_merge_goes_by_patient(spark, rows):
    samples = spark.createDataFrame([("s1", "p2", "a"), ("s2", "p1", "b"), ("s3", "p9", "c")], "sample_id string, patient_id string, site string")
    patients = spark.createDataFrame([("p1", 40, "X"), ("p2", 50, "Y")], "patient_id string, age int, site string")
    assert rows(merge.merge_clinical(samples, patients)) == [("s1", "p2", "a", 50), ("s2", "p1", "b", 40), ("s3", "p9", "c", None)]


def test_enrich_tags(spark):
    studies = spark.createDataFrame([("a", "brca"), ("b", "zzz")], "key string, type_of_cancer string")
    lookup = spark.createDataFrame([("BRCA", "Breast Cancer", "Breast")], "code string, name string, tissue string")
    found = {r["key"]: r["tags"] for r in merge.enrich_tags(studies, lookup).collect()}
    assert found == {"a": ["disease:Breast Cancer", "organ:Breast", "org:Unassigned"], "b": ["org:Unassigned"]}


# ------------------------------------------------------------------ quantiles and positions


def values(seed, kind):
    rng = random.Random(seed)
    if kind == "skewed":  # one group holds most rows, one value a third of it
        return [("big", 5.0 if rng.random() < 0.33 else rng.gauss(0, 50)) for _ in range(4000)] + [
            (g, rng.random()) for g in ("a", "b", None) for _ in range(rng.randrange(1, 6))
        ]
    if kind == "ties":
        return [(rng.choice("ab"), float(rng.randrange(4))) for _ in range(500)]
    return [(rng.choice("abc"), rng.uniform(-1, 1)) for _ in range(999)]


def expected(sample, p, rule):
    s, n = sorted(sample), len(sample)
    h = {"linear": (n - 1) * p, "hazen": min(max(n * p - 0.5, 0), n - 1), "upper": min(math.floor(n * p), n - 1)}[rule]
    low, high = s[math.floor(h)], s[math.ceil(h)]
    return low + (high - low) * (h - math.floor(h))


@pytest.mark.parametrize("rule", ["linear", "hazen", "upper"])
@pytest.mark.parametrize("kind", ["skewed", "ties", "even"])
@pytest.mark.parametrize(("limit", "accuracy"), [(100_000, 10_000), (0, 20), (0, 10_000)])
def test_quantiles_are_exact(spark, rule, kind, limit, accuracy):
    data = values(3, kind)
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "top": 1.0}
    found = quantiles(df, ["g"], "v", wanted, rule=rule, group_values=limit, accuracy=accuracy).collect()
    assert len(found) == len({g for g, _ in data})
    for row in found:
        sample = [v for g, v in data if g == row["g"]]
        for name, p in wanted.items():
            assert row[name] == pytest.approx(expected(sample, p, rule), abs=1e-9), (row["g"], name)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_quantiles_without_groups(spark, limit):
    data = [v for _, v in values(5, "even")]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    for rule in ("linear", "upper"):
        found = quantiles(df, [], "v", {"m": 0.5}, rule=rule, group_values=limit, accuracy=50).first()
        assert found["m"] == pytest.approx(expected(data, 0.5, rule))


@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("limit", [10_000, 0])
def test_row_numbers(spark, down, limit):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randrange(50) if rng.random() < 0.9 else None, i) for i in range(800)]
    df = spark.createDataFrame(data, "k string, v int, id int").repartition(3)
    found = row_numbers(df, ["k"], [("v", down), ("id", False)], group_rows=limit, ranges=8).collect()
    assert len(found) == len(data)
    for key in {d[0] for d in data}:
        mine = [d for d in data if d[0] == key]
        order = sorted(mine, key=lambda d: (d[1] is None, (-d[1] if down else d[1]) if d[1] is not None else 0, d[2]))
        got = [r["id"] for r in sorted((r for r in found if r["k"] == key), key=lambda r: r["row_number"])]
        assert got == [d[2] for d in order]


# ------------------------------------------------------------------ statistics


def test_frequency(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,), ("b",)], "v string")
    assert [tuple(r) for r in stats.frequency(df, "v").collect()] == [("NA", 2, 40.0), ("a", 2, 40.0), ("b", 1, 20.0)]
    numbers = spark.createDataFrame([(1.0,), (1.001,), (2.5,), (2.345,), (None,), (0.125,), (100.0,)], "v double")
    assert {r["value"] for r in stats.frequency(numbers, "v").collect()} == {"1", "2.5", "2.35", "NA", "0.13", "100"}


def test_percentages_round_like_the_shown_text(spark):
    df = spark.range(20000).selectExpr("CASE WHEN id < 765 THEN 'a' WHEN id < 765 + 625 THEN 'b' ELSE 'c' END AS v")
    assert {r["value"]: r["percent"] for r in stats.frequency(df, "v").collect()} == {"a": 3.82, "b": 3.13, "c": 93.05}


def test_counts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "x"), (2, None), (3, "")], "a int, b string")
    assert stats.value_count(df, "a").first()[0] == 4
    assert stats.value_count(df.limit(0), "a").first()[0] == 0
    assert tuple(stats.coverage(df.filter("a = 1"), df).first()) == (2, 5, 40.0)
    assert tuple(stats.coverage(df.limit(0), df.limit(0)).first()) == (0, 0, 0.0)
    assert stats.drop_missing(df, "a", "b").count() == 2
    assert {tuple(r) for r in stats.category_counts(df, "b").collect()} == {("x", 2), ("y", 1)}


@pytest.mark.parametrize("limit", [1000, 0])
def test_grouped_stats(spark, limit):
    data = [("a", 1.0), ("a", 4.0), ("a", 10.0), ("a", 3.0), ("b", 2.0), ("b", None), ("b", float("nan")), (None, 1.0), ("", 2.0), ("c", float("nan"))]
    df = spark.createDataFrame(data, "x string, y double")
    found = {r["group"]: r.asDict() for r in stats.grouped_stats(df, "x", "y", group_values=limit).collect()}
    assert set(found) == {"a", "b", "c"}
    assert found["a"] == {"group": "a", "count": 4, "mean": 4.5, "median": 3.5, "min": 1.0, "max": 10.0, "std": pytest.approx(statistics.pstdev([1, 4, 10, 3]))}
    assert found["b"]["count"] == 2 and found["b"]["mean"] == 2.0 and found["b"]["std"] == 0.0
    assert [found["c"][k] for k in ("count", "mean", "median", "min", "max", "std")] == [1, 0, 0, 0, 0, 0]


def test_grouped_stats_of_texts_are_zero(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2")], "x string, y string")
    assert tuple(stats.grouped_stats(df, "x", "y").first())[:4] == ("a", 2, 0.0, 0.0)


def test_mean_error(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "x string, y double")
    found = {r["group"]: (r["mean"], r["error"]) for r in stats.grouped_mean_error(df, "x", "y").collect()}
    assert found == {"a": (2.0, pytest.approx(1.0)), "b": (5.0, 0.0)}


def test_histogram(spark, rows):
    df = spark.createDataFrame([(-1.0, "a"), (0.0, "a"), (9.99, "b"), (10.0, "b"), (None, "b"), (25.0, None)], "v double, g string")
    assert rows(stats.histogram(df, "v")) == [(-10.0, 1), (0.0, 2), (10.0, 1), (20.0, 1)]
    assert rows(stats.histogram(df, "v", "g")) == [("a", -10.0, 1), ("a", 0.0, 1), ("b", 0.0, 1), ("b", 10.0, 1)]


@pytest.mark.parametrize("limit", [1000, 0])
def test_box(spark, limit):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5, 6, 7, 8, 100)], "x string, y double")
    box = stats.box_stats(df, "x", "y", group_values=limit).first()
    assert (box["q1"], box["median"], box["q3"]) == (3.0, 5.0, 7.0)
    assert (box["lower_whisker"], box["upper_whisker"], box["outliers"]) == (1.0, 8.0, 1)
    assert [tuple(r) for r in stats.box_outliers(df, "x", "y", group_values=limit).collect()] == [("a", 100.0)]


def test_facets(spark, rows):
    catalog = spark.createDataFrame(
        [("k1", "v0.0.9", ["disease:old"]), ("k1", "v0.0.10", ["disease:X", "org:Y", "free"]), ("k2", "v0.0.1", ["disease:X"]),
         ("k3", "v0.0.1", []), ("k4", "v0.0.1", None)], "key string, version string, tags array<string>")
    assert rows(stats.tag_facets(catalog)) == [("No tags", 2, "none"), ("disease:X", 2, "disease"), ("free", 1, "org"), ("org:Y", 1, "org")]
    assert stats.datasets_of_tag(catalog).count() == 7
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), (None, 1, 6.0)], "f string, g int, y double")
    assert rows(stats.facet_sweep(df, ["f", "g"], "y"), "field", "value", "count", "mean") == [("f", "a", 2, 3.0), ("g", "1", 2, 4.0), ("g", "2", 1, 4.0)]
    df = df.union(spark.createDataFrame([("a", 3, None), ("b", 3, float("nan"))], df.schema))
    assert rows(stats.facet_sweep(df, ["f", "g"], "y"), "field", "value", "count", "median", "std") == [
        ("f", "a", 3, 3.0, 1.0), ("f", "b", 1, 0.0, 0.0), ("g", "1", 2, 4.0, 2.0), ("g", "2", 1, 4.0, 0.0), ("g", "3", 2, 0.0, 0.0)]


# ------------------------------------------------------------------ survival


def product_limit(sample):
    """Survival after each time, events before censorings at a tie."""
    out, survive, left = {}, 1.0, len(sample)
    for time in sorted({t for t, _ in sample}):
        here = [e for t, e in sample if t == time]
        survive *= 1 - sum(here) / left
        left -= len(here)
        out[time] = (survive, left)
    return out


@pytest.mark.parametrize("limit", [1000, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_kaplan_meier_against_brute_force(spark, limit, seed):
    rng = random.Random(seed)
    data = [(rng.choice(["hot", "hot", "a"]), round(rng.expovariate(0.1), rng.choice([0, 3])), rng.randrange(2)) for _ in range(600)]
    data += [("censored", float(t), 0) for t in range(5)] + [("dies", 1.0, 1), ("dies", 2.0, 1)]
    df = spark.createDataFrame([(g, t, "1:DECEASED" if e else "0:LIVING") for g, t, e in data], "g string, os_months double, os_status string")
    found = survival.kaplan_meier_by(df, "os_months", "os_status", "g", group_times=limit, ranges=8).collect()
    for group in {d[0] for d in data}:
        sample = [(t, e) for g, t, e in data if g == group]
        want = product_limit(sample)
        mine = [r for r in found if r["group"] == group]
        assert sum(r["time"] == 0.0 and r["survival"] == 1.0 and r["at_risk"] == len(sample) for r in mine) == 1
        steps = {r["time"]: (r["survival"], r["at_risk"]) for r in mine if not (r["time"] == 0 and r["at_risk"] == len(sample))}
        assert set(steps) == set(want)
        for time, (survive, left) in want.items():
            assert steps[time][0] == pytest.approx(survive, abs=1e-12) and steps[time][1] == left
    whole = survival.kaplan_meier(df, "os_months", "os_status", group_times=limit, ranges=8).collect()
    want = product_limit([(t, e) for _, t, e in data])
    assert len(whole) == len(want) + 1
    assert all(any(r["time"] == t and r["survival"] == pytest.approx(s) for r in whole) for t, (s, _) in want.items())


def test_survival_rows_skip_missing(spark):
    df = spark.createDataFrame([("5", 1), (None, 1), ("x", 1), ("6", None), ("7", 0)], "t string, s int")
    assert sorted(tuple(r) for r in survival.survival_rows(df, "t", "s").collect()) == [(5.0, 1), (7.0, 0)]


def test_median_split(spark):
    df = spark.createDataFrame([(float(i), bool(i % 2), i) for i in range(1, 8)] + [(1.0, True, None)], "t double, s boolean, dose int")
    found = survival.kaplan_meier_by(df, "t", "s", "dose").collect()
    start = {r["group"]: r["at_risk"] for r in found if r["survival"] == 1.0 and r["time"] == 0}
    assert start == {"<= median (4.00)": 4, "> median (4.00)": 3}
    assert survival.kaplan_meier_by(df.limit(0), "t", "s", "dose").count() == 0


def test_endpoints(spark):
    df = spark.createDataFrame([(1.0, "1", 2.0, "0"), (2.0, "0", None, "1")], "os_months double, os_status string, dfs_months double, dfs_status string")
    found = survival.kaplan_meier_endpoints(df)
    assert {r["endpoint"]: r["count"] for r in found.groupBy("endpoint").count().collect()} == {"os": 3, "dfs": 2}
    with pytest.raises(ValueError):
        survival.kaplan_meier_endpoints(df.select("os_months"))


def test_rich_groups_alone_take_the_ranged_way(spark):
    rows = [("rich", float(i)) for i in range(500)] + [("poor", float(i % 7)) for i in range(90)] + [(None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    few, many = by_richness(df, ["g"], "v", 100)
    assert {r.g for r in few.collect()} == {"poor", None} and {r.g for r in many.collect()} == {"rich"}
    assert by_richness(df, ["g"], "v", 10**6)[1] is None and by_richness(df, ["g"], "v", 0)[0] is None
    assert by_richness(df.limit(0), ["g"], "v", 0)[1] is None
    for rule in ("linear", "hazen", "upper"):
        want = sorted(map(str, quantiles(df, ["g"], "v", {"a": 0.3, "b": 0.9}, rule=rule).collect()))
        assert sorted(map(str, quantiles(df, ["g"], "v", {"a": 0.3, "b": 0.9}, rule=rule, group_values=100, accuracy=50).collect())) == want
    events = df.select(F.lit(1).alias("dead"), "v", "g")
    curves = [sorted((r.group, r.time, round(r.survival, 9), r.events, r.at_risk)
                     for r in survival.kaplan_meier_by(events, "v", "dead", "g", group_times=n, ranges=8).collect()) for n in (100, 10**6)]
    assert curves[0] == curves[1]
