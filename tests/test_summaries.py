import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import summaries


def test_merged_summaries(spark, tmp_path):
    rng = random.Random(5)
    rows = [(v, rng.choice([None, "", *(f"s{i}" for i in range(3000))]), rng.choice([None, float("nan"), 1e6 + rng.gauss(0, 5)]))
            for v in ("v1", "v2", "v2", "v2") for _ in range(4000)]
    df = spark.createDataFrame(rows, "version string, name string, size double").repartition(5)
    summaries.summarise(df, ["name", "size"], ["version"]).write.parquet(f"{tmp_path}/s")
    stored = spark.read.parquet(f"{tmp_path}/s")
    assert stored.count() == 4
    merged = summaries.merge(stored)
    assert "name" not in merged.columns and merged.count() == 2
    for frame, keep in ((summaries.figures(stored).filter("version = 'v2'"), "v2"), (summaries.figures(merged), None)):
        found = {r.field: r for r in frame.collect()}
        some = [r for r in rows if keep in (None, r[0])]
        names = [r[1] for r in some if r[1]]
        numbers = sorted(r[2] for r in some if r[2] is not None and not math.isnan(r[2]))
        name, size = found["name"], found["size"]
        assert (name.rows, name.missing, name.low, name.std, name.median) == (len(some), len(some) - len(names), None, None, None)
        assert abs(name.distinct - len(set(names))) < 0.06 * len(set(names))
        assert (size.low, size.high) == (numbers[0], numbers[-1])
        assert size.mean == pytest.approx(statistics.fmean(numbers)) and size.std == pytest.approx(statistics.pstdev(numbers), rel=1e-6)
        for p, q in ((0.25, size.q1), (0.5, size.median), (0.75, size.q3)):
            assert abs(sum(n <= q for n in numbers) / len(numbers) - p) < 0.03


def test_summaries_of_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (None, "")], "x int, t string")
    found = {r.field: r for r in summaries.figures(summaries.merge(summaries.summarise(df, ["x", "t"]))).collect()}
    for field in ("x", "t"):
        assert (found[field].rows, found[field].missing, found[field].distinct, found[field].mean, found[field].median) == (2, 2, 0, None, None)
    assert summaries.figures(summaries.summarise(df.limit(0), ["x"], ["t"])).collect() == []
    both = summaries.summarise(df.withColumn("k", F.lit(1)), ["x"], ["k"])
    assert summaries.merge(both.unionByName(both), ["k"]).first()["rows"] == 4
    for fields, keys in (([], []), (["x"], ["rows"])):
        with pytest.raises(ValueError):
            summaries.summarise(df.withColumn("rows", F.lit(1)), fields, keys)
