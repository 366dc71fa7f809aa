"""Ordering and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.operators.ordered import common_prefix, order_number

# Up to this many rows Spark keeps a page with its skipped rows as one top-k heap per task.
HEAP_ROWS = 100_000


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [
        F.col(f"`{name}`").desc_nulls_last() if descending else F.col(f"`{name}`").asc_nulls_last()
        for name, descending in order
    ]


def page_of(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    offset: int = 0,
    limit: int | None = None,
    heap_rows: int = HEAP_ROWS,
) -> DataFrame:
    """Sort, skip ``offset`` rows and keep ``limit`` rows.

    A shallow page is a distributed top-k. A deep page would make every task keep all skipped rows, so there value ranges
    before and after the page are cut off by their row counts, on as many sort columns as it takes. Skipped rows without a
    limit are cut off in the same way; those of the one range that the cut goes through are numbered, and the rest is
    sorted by Spark in ranges. Rows that agree in all sort columns cannot be told apart by a cut.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    if order and limit is None and offset > 0:
        return after_rows(df, order, offset, heap_rows).orderBy(*sort_columns(order))
    if order and limit is not None and offset + limit > heap_rows:
        df, offset = around_page(df, order, offset, limit, heap_rows)
    if order:
        df = df.orderBy(*sort_columns(order))
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def _pieces(df: DataFrame, name: str, descending: bool, rows: Sequence[int], ranges: int) -> Column | None:
    """The place of a row's piece in the sort order of a column, nulls last; None if the column has no value.

    Split points come from a sketch. Only those next to the wanted places cut pieces, so a row meets a few comparisons in
    generated code however fine the sketch is. A split point is a piece of its own, as many rows may share it.
    """
    number = order_number(F.col(f"`{name}`"), df.schema[name].dataType, common_prefix(df, name))
    probabilities = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(number, probabilities, 10_000).alias("s"), F.count(number).alias("n")).first()
    if not row["n"]:
        return None
    points = set()
    for wanted in rows:
        rank = max(1, min(wanted, row["n"]))
        near = int((row["n"] - rank if descending else rank) / row["n"] * ranges) - 1
        # the sketch is off by a tenth of a range, so one more split point on either side nearly always holds the place
        points |= {row["s"][max(0, min(i, ranges - 2))] for i in range(near - 1, near + 3)}
    splits = sorted(points)
    place = F.when(number.isNull(), F.lit(2 * len(splits) + 1))
    for i, s in enumerate(splits):
        for k, within in enumerate((number < F.lit(s), number == F.lit(s))):
            place = place.when(within, F.lit(2 * (len(splits) - i) - k if descending else 2 * i + k))
    return place.otherwise(F.lit(0 if descending else 2 * len(splits)))


def cut(
    df: DataFrame, order: Sequence[tuple[str, bool]], rows: int, heap_rows: int = HEAP_ROWS, ranges: int = 1000
) -> tuple[Column, Column, int]:
    """Where the first ``rows`` rows end: a condition of ranges wholly before, one of the range that the cut goes through,
    and how many rows of that range are before it.

    A range of more than ``heap_rows`` is cut again, by the same column while that tells its rows apart, then by the next.
    Counts are exact.
    """
    return cuts(df, order, [rows], heap_rows, ranges)[0]


def cuts(
    df: DataFrame, order: Sequence[tuple[str, bool]], rows: Sequence[int], heap_rows: int = HEAP_ROWS, ranges: int = 1000
) -> list[tuple[Column, Column, int]]:
    """``cut`` for several places, which share their jobs as long as they lie in the same range."""

    def within(before: Column, inside: Column, left: list[int], columns: list[tuple[str, bool]]) -> list[tuple[Column, Column, int]]:
        while columns:
            part = df.filter(inside)
            position = _pieces(part, *columns[0], left, ranges)
            counts = {} if position is None else dict(part.groupBy(position.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
            if len(counts) > 1:
                break
            columns = columns[1:]
        else:
            return [(before, inside, n) for n in left]
        places, last = [], max(counts)
        for n in left:
            seen = 0
            for p in sorted(counts):
                if seen + counts[p] >= n or p == last:
                    break
                seen += counts[p]
            places.append((p, n - seen))
        ends = {}
        for p in dict(places):
            state, rest = (before | (inside & (position < p)), inside & (position == p)), [n for q, n in places if q == p]
            ends[p] = iter([(*state, n) for n in rest] if counts[p] <= heap_rows else within(*state, rest, columns))
        return [next(ends[p]) for p, _ in places]

    return within(F.lit(False), F.lit(True), list(rows), list(order))


def around_page(
    df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, limit: int, heap_rows: int = HEAP_ROWS
) -> tuple[DataFrame, int]:
    """Keep only the value ranges that a page touches; returns the smaller table and the rows still to skip in it."""
    *first, (upto, last, _) = cuts(df, order, [offset, offset + limit] if offset else [limit], heap_rows)
    before, _, skipped = first[0] if first else (F.lit(False), None, 0)
    return df.filter(~before & (upto | last)), skipped


def after_rows(df: DataFrame, order: Sequence[tuple[str, bool]], offset: int, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """All rows but the first ``offset``, in any order."""
    before, inside, skipped = cut(df, order, offset, heap_rows)
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*sort_columns(order)))
    rest = df.filter(inside).withColumn("_place", place).filter(F.col("_place") > skipped).drop("_place")
    return df.filter(~before & ~inside).unionByName(rest)


def page(
    df: DataFrame, order: Sequence[tuple[str, bool]], number: int | None = None, size: int | None = None
) -> DataFrame:
    """A 1-based page, by default the first with ten rows."""
    number, size = number or 1, size or 10
    if number < 1:
        raise ValueError("pages count from 1")
    return page_of(df, order, (number - 1) * size, size)
