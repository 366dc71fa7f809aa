"""Summaries of fields that can be stored and merged, so that figures over several versions or cohorts read no rows.

Counts, extremes, means and deviations of merged summaries are exact; the number of distinct values comes from a HyperLogLog
sketch (relative error about 1.04 / sqrt(2 ** DISTINCT_BITS)), quantiles from a KLL sketch (rank error about
1.7 / SHAPE_SIZE ** 0.9). A summary has the size of its sketches, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortspark.operators.stats import _numbers, is_numeric, present

#: Two to this power are the counters of a distinct-value sketch: about 1.6 % of error.
DISTINCT_BITS = 12
#: Size of a quantile sketch: a rank is off by about 1.3 %.
SHAPE_SIZE = 200
#: Quantiles that ``figures`` reads from a merged summary.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}

_STORED = ("rows", "given", "numbers", "low", "high", "mean", "spread", "distinct", "shape")


def summarise(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, field), the keys being a dataset version or a group, say.

    ``rows`` counts all rows and ``given`` those with a value (texts: not empty); ``numbers``, ``low``, ``high``, ``mean``,
    ``spread`` (sum of squared deviations) and the sketch ``shape`` take the numbers of a numeric field but NaN, and are 0 or
    null for other fields. ``distinct`` is the sketch of given values. One pass, aggregated before the shuffle.
    """
    clash = set(keys) & {"field", *_STORED}
    if clash:
        raise ValueError(f"keys {sorted(clash)} have the name of a figure")
    if not fields:
        raise ValueError("no fields")
    cells = [
        F.struct(
            F.lit(f).alias("field"),
            F.when(present(df, f), F.col(f).cast("string")).alias("_text"),
            (_numbers(df, f) if is_numeric(df, f) else F.lit(None).cast("double")).alias("_number"),
        )
        for f in fields
    ]
    long = df.select(*keys, F.inline(F.array(*cells)))
    return long.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("_text").alias("given"),
        F.count("_number").alias("numbers"),
        F.min("_number").alias("low"),
        F.max("_number").alias("high"),
        F.avg("_number").alias("mean"),
        (F.var_pop("_number") * F.count("_number")).alias("spread"),
        F.hll_sketch_agg("_text", F.lit(DISTINCT_BITS)).alias("distinct"),
        F.kll_sketch_agg_double("_number", F.lit(SHAPE_SIZE)).alias("shape"),
    )


def merge(summaries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Summaries with the same (keys, field) put together; of the other keys all are taken. Again a summary.

    Deviations are merged around the mean of all, not by subtracting squares.
    """
    same = Window.partitionBy(*keys, "field")
    whole = F.sum(F.col("mean") * F.col("numbers")).over(same) / F.nullif(F.sum("numbers").over(same), F.lit(0))
    rows = summaries.withColumn("_mean", whole)
    return rows.groupBy(*keys, "field").agg(
        F.sum("rows").alias("rows"),
        F.sum("given").alias("given"),
        F.sum("numbers").alias("numbers"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.max("_mean").alias("mean"),
        F.sum(F.col("spread") + F.col("numbers") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("spread"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("shape", F.lit(SHAPE_SIZE)).alias("shape"),
    )


def figures(summaries: DataFrame, wanted: Mapping[str, float] = QUARTILES) -> DataFrame:
    """(keys, field, rows, missing, distinct, low, high, mean, std, quantiles) read from summaries.

    ``distinct`` and the quantiles are estimates; a field without numbers has null in all columns of numbers.
    """
    keys = [c for c in summaries.columns if c != "field" and c not in _STORED]
    has = F.col("numbers") > 0
    cuts = [
        F.when(has, F.kll_sketch_get_quantile_double("shape", F.lit(float(p)))).alias(name) for name, p in wanted.items()
    ]
    return summaries.select(
        *keys, "field", "rows", (F.col("rows") - F.col("given")).alias("missing"),
        F.hll_sketch_estimate("distinct").alias("distinct"), "low", "high", "mean",
        F.when(has, F.sqrt(F.col("spread") / F.col("numbers"))).alias("std"), *cuts)
