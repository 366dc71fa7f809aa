"""The next row in the order of an id, without a global sort in one task.

Ids are cut into ranges at values that occur in the data (approximate percentiles, two levels of about the square root of
the number of ranges each). A row that opens a range is also dealt to the range before it, and the very first row to the
last range, so the next row is found inside each range by a window and the table moves once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows per range, about.
RANGE_ROWS = 400
#: Ranges of one level at most; with two levels a million ranges, beyond which ranges hold more rows.
LEVEL_RANGES = 1000


def range_starts(ids: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> list[int]:
    """Ascending ids, each the first of a range; the smallest id is the first of them. Null ids are left out."""
    row = ids.agg(F.count(key).alias("n"), F.min(key).alias("low")).first()
    if not row.n:
        return []
    ranges = math.ceil(row.n / range_rows)
    fractions = [i / ranges for i in range(1, min(ranges, LEVEL_RANGES * LEVEL_RANGES))]
    if not fractions:
        return [row.low]
    cuts = ids.agg(F.percentile_approx(key, fractions, 10 * len(fractions) + 1000).alias("cuts")).first().cuts
    return sorted({row.low, *cuts})


def _position(key: Column, starts: list[int]) -> Column:
    """Index of the range of a key: the number of starts up to it, looked up in two steps."""
    step = math.isqrt(len(starts)) + 1
    coarse = starts[::step]
    fine = [starts[i:i + step] for i in range(0, len(starts), step)]
    at_most = lambda values: F.size(F.filter(values, lambda v: v <= key))
    long = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    block = at_most(long(coarse)) - 1
    return block * step + at_most(F.get(F.array(*[long(v) for v in fine]), block)) - 1


def with_next(rows: DataFrame, key: str, columns: dict[str, str], starts: list[int]) -> DataFrame:
    """``rows`` with, for every (column: name) of ``columns``, its value in the next row by ``key`` under ``name``; the
    row after the last is the first. Rows with equal keys follow each other by the listed columns. Rows without a key
    are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    if not starts:
        return rows.withColumns({name: F.col(column) for column, name in columns.items()})
    opens = F.array_contains(F.array(*[F.lit(v).cast("long") for v in starts]), F.col(key))
    at = F.col("_range")
    guest = F.when(opens, F.when(at == 0, F.lit(len(starts) - 1)).otherwise(at - 1))
    dealt = rows.withColumn("_range", _position(F.col(key), starts)).withColumn(
        "_place", F.explode(F.array_compact(F.array(
            F.struct(at.alias("range"), F.lit(0).alias("guest")),
            F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(1).alias("guest"))))))).drop("_range")
    order = Window.partitionBy("_place.range").orderBy(F.col("_place.guest"), F.col(key), *sorted(columns))
    found = dealt.withColumns({name: F.lead(column).over(order) for column, name in columns.items()})
    return found.where("_place.guest = 0").drop("_place")
