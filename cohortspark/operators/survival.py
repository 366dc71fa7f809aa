"""Kaplan-Meier curves, plain and per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cohortspark.functions.scalars import event_code
from cohortspark.operators.ordered import (
    GROUP_ROWS,
    RANGES,
    attach_stored,
    by_richness,
    earlier_ranges,
    quantiles,
    range_splits,
    with_range,
)
from cohortspark.operators.stats import drop_missing, is_numeric
from cohortspark.session import written

# Endpoints with a ``<name>_months`` time and a ``<name>_status`` event column.
ENDPOINTS = ("os", "dfs", "rfs", "dmfs")


def survival_rows(df: DataFrame, time: str, status: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, time, event) of the rows in which both time and status are given."""
    given = df.filter(F.col(time).isNotNull() & F.col(status).isNotNull())
    event = event_code(F.col(status), df.schema[status].dataType)
    rows = given.select(*keys, F.col(time).try_cast("double").alias("time"), event.alias("event"))
    return rows.filter(F.col("time").isNotNull() & ~F.isnan("time"))


def curve(
    rows: DataFrame, keys: Sequence[str] = (), group_times: int = GROUP_ROWS, ranges: int = RANGES
) -> DataFrame:
    """Survival after each distinct time, with a start row (time 0, survival 1) per group.

    ``at_risk`` counts the subjects left after that time. Events come before censorings at a tie.
    Subjects are first aggregated per (group, time), so windows run over times, not subjects; only
    groups with very many times are cut into time ranges.
    """
    keys = list(keys)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("at_risk"))
    few, many = by_richness(rows, keys, "time", group_times)
    parts = []
    if few is not None:
        parts.append(_plain_steps(_times(few, keys), keys))
    if many is not None:
        parts.append(_ranged_steps(many, keys, ranges))
    steps = reduce(DataFrame.unionByName, parts)
    columns = [*keys, "time", "survival", "events", "at_risk"]
    start = groups.select(
        *keys,
        F.lit(0.0).alias("time"),
        F.lit(1.0).alias("survival"),
        F.lit(0).cast("long").alias("events"),
        "at_risk",
    )
    after = steps.withColumn("at_risk", F.col("_before") - F.col("subjects"))
    return start.unionByName(after.select(*columns))


def _times(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "time").agg(F.sum("event").alias("events"), F.count(F.lit(1)).alias("subjects"))


def _plain_steps(times: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Steps of groups whose times fit one task; ``_before`` counts the subjects left before a time."""
    up_to = Window.partitionBy(*keys).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    left = times.withColumn("_before", F.sum("subjects").over(whole) - F.sum("subjects").over(up_to))
    left = left.withColumn("_before", F.col("_before") + F.col("subjects"))
    steps = left.withColumn("survival", F.product(1 - F.col("events") / F.col("_before")).over(up_to))
    return steps.select(*keys, "time", "survival", "events", "subjects", "_before")


def _ranged_steps(rows: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """The same of groups with very many times, each cut into time ranges."""
    # used several times below: written once, so that the rows are not read again for each use
    splits = range_splits(rows, keys, F.col("time"), ranges)
    ranged = written(with_range(_times(rows, keys), splits, keys, F.col("time"), ranges), "survival-times")
    sizes = ranged.groupBy(*keys, "_range").agg(F.sum("subjects").alias("_n"))
    later = Window.partitionBy(*keys).orderBy("_range").rowsBetween(0, Window.unboundedFollowing)
    starts = sizes.select(*keys, "_range", F.sum("_n").over(later).alias("_start"))
    ranged = attach_stored(ranged, starts, [*keys, "_range"], "survival-starts")
    inside = Window.partitionBy(*keys, "_range").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sum("subjects").over(inside) - F.col("subjects")
    left = ranged.withColumn("_before", F.col("_start") - gone)
    factor = 1 - F.col("events") / F.col("_before")
    local = written(left.withColumn("_local", F.product(factor).over(inside)), "survival-ranges")
    # factors are at most 1, so the smallest running product of a range is its last one
    per_range = local.groupBy(*keys, "_range").agg(F.min("_local").alias("_p"))
    earlier = F.coalesce(F.product("_p").over(earlier_ranges(keys)), F.lit(1.0))
    carried = per_range.select(*keys, "_range", earlier.alias("_earlier"))
    steps = attach_stored(local, carried, [*keys, "_range"], "survival-carried")
    survival = (F.col("_earlier") * F.col("_local")).alias("survival")
    return steps.select(*keys, "time", survival, "events", "subjects", "_before")


def kaplan_meier(df: DataFrame, time: str, status: str, **limits: int) -> DataFrame:
    """One curve over the whole table."""
    return curve(survival_rows(df, time, status), **limits)


def kaplan_meier_by(df: DataFrame, time: str, status: str, by: str, **limits: int) -> DataFrame:
    """One curve per category of ``by``; a numeric ``by`` is split at its median element.

    The split value is the element at position floor(n/2) of the sorted values; this one number is
    computed first and reaches the driver.
    """
    rows = drop_missing(df, by)
    if not is_numeric(df, by):
        rows = survival_rows(rows.withColumn("group", F.col(by).cast("string")), time, status, ["group"])
        return curve(rows, ["group"], **limits)
    rows = survival_rows(rows.withColumn("_by", F.col(by).cast("double")), time, status, ["_by"])
    rows = rows.filter(~F.isnan("_by"))
    found = quantiles(rows, [], "_by", {"middle": 0.5}, rule="upper").first()
    if found is None or found["middle"] is None:
        return curve(rows.select(F.lit("").alias("group"), "time", "event").limit(0), ["group"], **limits)
    middle = found["middle"]
    side = F.when(F.col("_by") <= middle, F.lit("<=")).otherwise(F.lit(">"))
    label = F.concat(side, F.format_string(" median (%.2f)", F.lit(middle)))
    return curve(rows.select(label.alias("group"), "time", "event"), ["group"], **limits)


def endpoint_pairs(columns: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Endpoints whose time and status columns are both there."""
    pairs = {name: (f"{name}_months", f"{name}_status") for name in ENDPOINTS}
    return {name: pair for name, pair in pairs.items() if set(pair) <= set(columns)}


def kaplan_meier_endpoints(df: DataFrame, **limits: int) -> DataFrame:
    """Curves of every endpoint the table has, from one pass over it."""
    pairs = endpoint_pairs(df.columns)
    if not pairs:
        raise ValueError("no <endpoint>_months and <endpoint>_status columns")
    observed = F.array(
        *[
            F.struct(
                F.lit(name).alias("endpoint"),
                F.col(time).try_cast("double").alias("time"),
                event_code(F.col(status), df.schema[status].dataType).alias("event"),
            )
            for name, (time, status) in pairs.items()
        ]
    )
    rows = df.select(F.inline(observed))
    rows = rows.filter(F.col("time").isNotNull() & ~F.isnan("time") & F.col("event").isNotNull())
    return curve(rows, ["endpoint"], **limits)
