"""Joins on equal keys and an unequal value that are only aggregated: no pair is ever produced.

A customer with ten million events and a rule ``event.value < other.value`` has 10^14 pairs. Their count, sum, smallest
and largest value per left row follow from running aggregates over the right side's values in order, one row per
(keys, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortspark.operators.ordered import (
    GROUP_ROWS,
    RANGES,
    attach_stored,
    common_prefix,
    earlier_ranges,
    largest_group,
    order_number,
    range_splits,
    with_range,
)
from cohortspark.session import written

#: Comparisons of the left value with the right one: (falling order of values, whether equal values count).
_COMPARISONS = {">": (False, False), ">=": (False, True), "<": (True, False), "<=": (True, True)}
#: How partial results of one measure are put together.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def _measure(function: str, column: str | None) -> Column:
    if function == "count":
        return F.count(F.lit(1) if column is None else F.col(column))
    return {"sum": F.sum, "min": F.min, "max": F.max}[function](column)


def _together(function: str, first: Column, second: Column) -> Column:
    """Two partial results; a null one has seen no value."""
    if function in ("count", "sum"):
        return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(first + second)
    return (F.least if function == "min" else F.greatest)(first, second)


def _running(points: DataFrame, keys: Sequence[str], falling: bool, equal: bool, functions: Mapping[str, str],
             group_rows: int, ranges: int) -> DataFrame:
    """``points`` with each measure over the values before (or up to) the row's own one."""
    order = F.col("_v").desc() if falling else F.col("_v").asc()
    last = 0 if equal else -1
    if largest_group(points, keys) <= group_rows:
        seen = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        return points.select(*keys, "_v", "_asked", *[_MERGE[f](m).over(seen).alias(m) for m, f in functions.items()])
    number = order_number(F.col("_v"), points.schema["_v"].dataType, common_prefix(points, "_v"))
    number = -number if falling else number
    ranged = with_range(points, range_splits(points, keys, number, ranges), keys, number, ranges)
    seen = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    local = ranged.select(*keys, "_range", "_v", "_asked", *[_MERGE[f](m).over(seen).alias(m) for m, f in functions.items()])
    totals = ranged.groupBy(*keys, "_range").agg(*[_MERGE[f](m).alias(m) for m, f in functions.items()])
    carried = totals.select(
        *keys, "_range", *[_MERGE[f](m).over(earlier_ranges(keys)).alias(f"_before_{m}") for m, f in functions.items()])
    both = attach_stored(local, carried, [*keys, "_range"], "inequality-ranges")
    merged = [_together(f, F.col(f"_before_{m}"), F.col(m)).alias(m) for m, f in functions.items()]
    return both.select(*keys, "_v", "_asked", *merged)


def compared(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str],
    on: tuple[str, str, str],
    measures: Mapping[str, tuple[str, str | None]],
    group_rows: int = GROUP_ROWS,
    ranges: int = RANGES,
) -> DataFrame:
    """Every left row with aggregates over the right rows that match it.

    ``keys`` maps left key columns to right ones (none: all rows share one group), ``on`` is (left column, comparison,
    right column) with one of ``> >= < <=``, and ``measures`` names results: ``{"n": ("count", None), "most": ("max",
    "price")}`` of ``count``, ``sum``, ``min`` and ``max``. A left row without a match has count 0 and otherwise null, as in
    a left join; null keys and null values match nothing; NaN is the largest number. Both sides are reduced to distinct
    (keys, value) before the only ordered step, a large group is cut into ranges of values, and left rows are joined back
    by equality, so that a hot key costs no task more than a range of its values.
    """
    own, comparison, other = on
    if comparison not in _COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    unknown = {f for f, _ in measures.values()} - set(_MERGE)
    if unknown or not measures:
        raise ValueError(f"unknown measures {sorted(unknown)}" if unknown else "no measures")
    if any(column is None for function, column in measures.values() if function != "count"):
        raise ValueError("a measure other than count needs a column")
    clash = set(measures) & set(left.columns)
    if clash:
        raise ValueError(f"measures {sorted(clash)} are columns of the left table")
    falling, equal = _COMPARISONS[comparison]
    names = [f"_k{i}" for i in range(len(keys))]
    inner = {f"_m{i}": measure for i, measure in enumerate(measures.values())}
    functions = {m: function for m, (function, _) in inner.items()}
    value_type = left.select(own).unionAll(right.select(other)).schema[0].dataType  # the wider of the two

    def value(df: DataFrame, column: str) -> Column:
        number = df[column].cast(value_type)
        # adding 0 makes one value of both zeros
        return number + F.lit(0).cast(value_type) if isinstance(value_type, (T.DoubleType, T.FloatType)) else number

    def matching(df: DataFrame) -> DataFrame:
        for name in [*names, "_v"]:
            df = df.filter(F.col(name).isNotNull())
        return df

    needed = {column for _, column in inner.values() if column is not None}
    given = right.select(
        *[right[k].alias(n) for n, k in zip(names, keys.values(), strict=True)], value(right, other).alias("_v"),
        *[right[c].alias(f"_c_{c}") for c in sorted(needed)])
    given = matching(given).groupBy(*names, "_v").agg(
        *[_measure(f, None if c is None else f"_c_{c}").alias(m) for m, (f, c) in inner.items()])
    asked = left.select(*[left[k].alias(n) for n, k in zip(names, keys, strict=True)], value(left, own).alias("_v"))
    points = given.withColumn("_asked", F.lit(False)).unionByName(
        matching(asked).distinct().withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    points = points.groupBy(*names, "_v").agg(
        F.bool_or("_asked").alias("_asked"), *[_MERGE[f](m).alias(m) for m, f in functions.items()])
    answers = _running(written(points, "inequality-points"), names, falling, equal, functions, group_rows, ranges)
    answers = answers.filter("_asked").drop("_asked").withColumnRenamed("_v", "_w")
    condition = value(left, own) == F.col("_w")
    for name, key in zip(names, keys, strict=True):
        condition = condition & (left[key] == F.col(name))
    joined = left.join(answers, condition, "left")
    results = [
        F.coalesce(F.col(m), F.lit(0)).cast("long").alias(name) if functions[m] == "count" else F.col(m).alias(name)
        for m, name in zip(inner, measures, strict=True)
    ]
    return joined.select(*[left[c] for c in left.columns], *results)
