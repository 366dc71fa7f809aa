import math
import random

import pytest

from cohortspark.operators.inequality import compared

MEASURES = {"n": ("count", None), "given": ("count", "x"), "total": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x")}


def brute(left, right, comparison):
    def beats(a, b):
        a, b = (math.inf if math.isnan(a) else a), (math.inf if math.isnan(b) else b)
        return {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[comparison]

    out = []
    for i, k, v in left:
        hits = [x for rk, rv, x in right if None not in (k, v, rk, rv) and k == rk and beats(v, rv)]
        xs = [x for x in hits if x is not None]
        out.append((i, len(hits), len(xs), sum(xs) if xs else None, min(xs, default=None), max(xs, default=None)))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 20])
@pytest.mark.parametrize("comparison", [">", ">=", "<", "<="])
def test_compared_equals_brute_force(spark, comparison, limit):
    rng = random.Random(3)

    def key():
        return rng.choice(["hot", "hot", "hot", "b", None])

    left = [(i, key(), rng.choice([None, 0.0, -0.0, float("nan"), *map(float, range(60))])) for i in range(300)]
    right = [(key(), rng.choice([None, 0.0, -0.0, *map(float, range(80))]), rng.choice([None, *range(9)])) for _ in range(400)]
    found = compared(
        spark.createDataFrame(left, "i int, k string, v double").repartition(3),
        spark.createDataFrame(right, "k string, w double, x int"), {"k": "k"}, ("v", comparison, "w"), MEASURES, limit, 8)
    assert found.columns == ["i", "k", "v", *MEASURES]
    assert sorted((r.i, r.n, r.given, r.total, r.low, r.high) for r in found.collect()) == brute(left, right, comparison)


def test_compared_empty_and_wrong(spark):
    left = spark.createDataFrame([(1, 5)], "i int, v int")
    none = spark.createDataFrame([], "w long, x int")
    assert compared(left, none, {}, ("v", ">", "w"), MEASURES).drop("v").collect() == [(1, 0, 0, None, None, None)]
    assert compared(left.limit(0), none, {}, ("v", ">", "w"), MEASURES).collect() == []
    for on, measures in ((("v", "!=", "w"), MEASURES), (("v", ">", "w"), {}), (("v", ">", "w"), {"a": ("avg", "x")}),
                         (("v", ">", "w"), {"a": ("sum", None)}), (("v", ">", "w"), {"v": ("count", None)})):
        with pytest.raises(ValueError):
            compared(left, none, {}, on, measures)
