"""Work that depends on order inside a group: positions, running totals, exact quantiles.

A group can be a large part of a table, so none of these sorts a whole large group in one task.
Each operator first looks at how large its groups are (one cheap, partially aggregated job). Small
groups take the plain window or aggregate. Large groups are cut into value ranges: split points
come from a sketch, every range is sorted on its own, and per-range totals carry the prefix over.
The sketch only decides where to cut; results are exact on both ways.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortspark.session import written

#: Rows of one group that one task may sort or hold.
GROUP_ROWS = 1_000_000
#: Distinct values of one group that an exact percentile may hold in memory.
GROUP_VALUES = 100_000
#: Ranges a large group is cut into, a power of two.
RANGES = 256
#: Accuracy of the sketches; a value's rank is off by at most rows / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000


def common_prefix(df: DataFrame, name: str) -> int:
    """How many leading bytes all values of a text column share; one aggregate over the column."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return 0
    ends = df.agg(F.min(f"`{name}`").alias("low"), F.max(f"`{name}`").alias("high")).first()
    if ends["low"] is None:
        return 0
    return len(os.path.commonprefix([ends["low"].encode(), ends["high"].encode()]))


def order_number(column: Column, data_type: T.DataType, skip: int = 0) -> Column:
    """A number that never falls when the value rises, used to cut ranges.

    Texts are told apart by the six bytes after the first ``skip``, which all must share. Different values may share a
    number; they then stay in the same range. NaN counts as the largest number, like infinity.
    """
    if isinstance(data_type, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), skip + 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
        return F.unix_date(column.cast("date")).cast("double") * 86400 + seconds
    number = column.cast("double")
    return F.when(F.isnan(number), F.lit(float("inf"))).otherwise(number)


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of keys, those on the right carrying a prefix."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[f"{prefix}{key}"])
    return condition


def attach(df: DataFrame, per_group: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-group table to every row of its group.

    Without keys the table has one row, which becomes a scalar subquery. With keys Spark joins by
    hash, and adaptive execution broadcasts the small side once its real size is known.
    """
    extra = [c for c in per_group.columns if c not in keys]
    if not keys:
        one = per_group.select(F.struct(*extra)).scalar()
        out = df.withColumn("_one", one)
        return out.select(*df.columns, *[F.col(f"_one.{c}").alias(c) for c in extra])
    renamed = per_group.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *extra)
    joined = df.join(renamed, same_keys(df, renamed, keys, "_k_"), "left")
    return joined.select(*[df[c] for c in df.columns], *[renamed[c] for c in extra])


def attach_stored(df: DataFrame, per_group: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``attach`` for a table of one row per group that is costly to guess the size of.

    Spark takes an aggregate to be as large as its input and would shuffle ``df`` to join it. Stored
    in the shared folder the table shows its real size: a small one gets broadcast, and ``df`` with
    its large groups stays where it is; a large one is still joined by shuffle.
    """
    return attach(df, written(per_group, name) if keys else per_group, keys)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group. Runs one aggregation over the key columns."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("n")).first()["n"] or 0


def by_richness(
    df: DataFrame, keys: Sequence[str], column: str, limit: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups with about ``limit`` distinct values at most, and rows of richer groups; None where there is no group.

    Only where both kinds occur are the keys of the rich groups stored; they are few, as each has more than ``limit`` values.
    """
    values = df.groupBy(*keys).agg(F.approx_count_distinct(column).alias("_values"))
    span = values.agg(F.max("_values").alias("most"), F.min("_values").alias("least")).first()
    if (span["most"] or 0) <= limit:
        return df, None
    if span["least"] > limit:
        return None, df
    names = [F.col(k).alias(f"_k_{k}") for k in keys]
    rich = written(values.filter(F.col("_values") > limit).select(*names), "rich-groups")
    condition = same_keys(df, rich, keys, "_k_")
    return df.join(rich, condition, "left_anti"), df.join(rich, condition, "left_semi")


def range_splits(df: DataFrame, keys: Sequence[str], number: Column, ranges: int = RANGES) -> DataFrame:
    """One row per group with the ``ranges - 1`` sorted split points that cut it about equally."""
    probabilities = [i / ranges for i in range(1, ranges)]
    splits = F.percentile_approx(number, probabilities, SKETCH_ACCURACY)
    return df.groupBy(*keys).agg(splits.alias("_splits"))


def with_range(
    df: DataFrame, splits: DataFrame, keys: Sequence[str], number: Column, ranges: int = RANGES
) -> DataFrame:
    """Add ``_range``, which rises with ``number`` inside a group; nulls come last.

    The range is the count of split points below the number, found by halving: one comparison per
    power of two, all in generated code.
    """
    if ranges < 2 or ranges & (ranges - 1):
        raise ValueError("the number of ranges must be a power of two")
    out = attach_stored(df.withColumn("_number", number), splits, keys, "range-splits")
    out = out.withColumn("_range", F.lit(0))
    step = ranges // 2
    while step:
        above = F.get("_splits", F.col("_range") + (step - 1)) < F.col("_number")
        out = out.withColumn("_range", F.when(above, F.col("_range") + step).otherwise(F.col("_range")))
        step //= 2
    last = F.when(F.col("_number").isNull(), ranges).otherwise(F.col("_range"))
    return out.withColumn("_range", last).drop("_splits", "_number")


def earlier_ranges(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    out: str = "row_number",
    group_rows: int = GROUP_ROWS,
    ranges: int = RANGES,
) -> DataFrame:
    """Number rows from 1 inside each group by ``order``, a list of (column, descending).

    Nulls sort last. The order should be total, as ties are numbered in any order.
    """
    by = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]
    if largest_group(df, keys) <= group_rows:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
        return df.withColumn(out, place.cast("long"))
    first, descending = order[0]
    number = order_number(F.col(first), df.schema[first].dataType, common_prefix(df, first))
    number = -number if descending else number
    ranged = with_range(df, range_splits(df, keys, number, ranges), keys, number, ranges)
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*by))
    )
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(earlier_ranges(keys)), F.lit(0)).alias("_offset")
    )
    numbered = attach(local, offsets, [*keys, "_range"])
    return numbered.withColumn(out, F.col("_local") + F.col("_offset")).drop(
        "_local", "_offset", "_range"
    )


def _position(n: Column, p: float, rule: str) -> Column:
    """0-based fractional position of quantile ``p`` among ``n`` sorted values."""
    if rule == "linear":
        return (n - 1) * F.lit(float(p))
    if rule == "hazen":
        return F.least(F.greatest(n * F.lit(float(p)) - 0.5, F.lit(0.0)), (n - 1).cast("double"))
    if rule == "upper":
        return F.least(F.floor(n * F.lit(float(p))), n - 1).cast("double")
    raise ValueError(f"unknown quantile rule {rule!r}")


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    rule: str = "linear",
    group_values: int = GROUP_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact quantiles of a numeric column, one row per group.

    Rules: ``linear`` interpolates at (n-1)p; ``hazen`` interpolates at np-1/2; ``upper`` takes the
    element at position floor(np) of the sorted values. Null values are left out.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    few, many = by_richness(rows, keys, "_v", group_values)
    parts = []
    if few is not None:
        parts.append(_quantiles_of(few, keys, wanted, rule, group_values, accuracy, bracketed=False))
    if many is not None:
        parts.append(_quantiles_of(many, keys, wanted, rule, group_values, accuracy, bracketed=True))
    return reduce(DataFrame.unionByName, parts)


def _quantiles_of(
    rows: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, float],
    rule: str,
    group_values: int,
    accuracy: int,
    bracketed: bool,
) -> DataFrame:
    """Quantiles of the values ``_v``; all groups take the one way or the other."""
    if bracketed:
        placed = _bracket_positions(rows, keys, list(wanted.values()), accuracy)
    elif rule == "linear":
        found = rows.groupBy(*keys).agg(F.percentile("_v", list(wanted.values())).alias("_q"))
        return found.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(wanted)])
    else:
        placed = _value_positions(rows, keys)

    def at(i: int, position: Column) -> Column:
        inside = (position >= F.col("_end") - F.col("_c")) & (position < F.col("_end"))
        return F.max(F.when((F.coalesce("_i", F.lit(i)) == i) & inside, F.col("_v")))

    picked = []
    for i, p in enumerate(wanted.values()):
        h = _position(F.col("_n"), p, rule)
        picked += [
            at(i, F.floor(h)).alias(f"_low{i}"),
            at(i, F.ceil(h)).alias(f"_high{i}"),
            F.max(h - F.floor(h)).alias(f"_part{i}"),
        ]
    out = placed.groupBy(*keys).agg(*picked)

    def interpolated(rows: DataFrame) -> DataFrame:
        return rows.select(
            *keys,
            *[
                (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(name)
                for i, name in enumerate(wanted)
            ],
        )

    if not bracketed:
        return interpolated(out)
    # a quantile that its bracket missed is looked for again in wider ones; the widest hold every value
    missed = F.lit(False)
    for i in range(len(wanted)):
        missed = missed | F.col(f"_low{i}").isNull() | F.col(f"_high{i}").isNull()
    out = written(out.withColumn("_missed", missed & F.col("_part0").isNotNull()), "quantiles")
    again = out.filter("_missed").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    if again.isEmpty():
        return interpolated(out)
    rest = rows.join(again, same_keys(rows, again, keys, "_k_"), "left_semi") if keys else rows
    wider = quantiles(rest, keys, "_v", wanted, rule, group_values, max(accuracy // 8, 1))
    return interpolated(out.filter("NOT _missed")).unionByName(wider)


def _value_positions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Where each distinct value ends in the sorted order of its group (few distinct values)."""
    counted = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counted.select(
        *keys,
        F.lit(None).cast("int").alias("_i"),
        "_v",
        "_c",
        F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")).alias("_end"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"),
    )


def _bracket_positions(
    rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], accuracy: int
) -> DataFrame:
    """Where the values around each quantile end in the sorted order of their group.

    A sketch with known rank error gives a bracket that surely holds the quantile. Rows below it are
    only counted, rows inside keep their value. Both aggregate before the shuffle, so little more
    than the brackets' own values moves, and no task sorts more than one bracket.
    """
    margin = 3.0 / accuracy
    sides = [s for p in probabilities for s in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", sides, accuracy).alias("_sides")
    )
    marked = attach_stored(rows, sketch, keys, "quantile-brackets")
    # a margin has to reach past the neighbouring values, so small groups are kept whole
    whole = F.col("_n") <= accuracy

    def low(i: int) -> Column:
        return F.when(whole | (F.col("_v") >= F.col("_sides")[2 * i]), F.col("_v"))

    def kept(i: int) -> Column:
        return whole | (F.col("_v") <= F.col("_sides")[2 * i + 1])

    if len(probabilities) == 1:
        below_or_in = marked.filter(kept(0)).select(*keys, "_n", F.lit(0).alias("_i"), low(0).alias("_v"))
    else:
        brackets = [
            F.struct(F.lit(i).alias("_i"), low(i).alias("_v"), kept(i).alias("_keep"))
            for i in range(len(probabilities))
        ]
        below_or_in = marked.select(*keys, "_n", F.inline(F.array(*brackets))).filter("_keep")
    counted = below_or_in.groupBy(*keys, "_n", "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # a null value stands for all rows below the bracket and comes first
    up_to = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first())
    return counted.withColumn("_end", F.sum("_c").over(up_to))
