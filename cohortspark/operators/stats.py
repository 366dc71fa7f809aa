"""Frequency tables, grouped statistics, histograms and box statistics over whole cohorts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortspark.functions.scalars import display_number, percent_of
from cohortspark.operators.ordered import GROUP_VALUES, attach, attach_stored, by_richness, quantiles
from cohortspark.operators.versions import latest

BIN_WIDTH = 10


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def present(df: DataFrame, column: str) -> Column:
    """Neither null nor, for texts, empty."""
    given = F.col(column).isNotNull()
    return given & (F.col(column) != "") if isinstance(df.schema[column].dataType, T.StringType) else given


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every given column has a value."""
    for column in columns:
        df = df.filter(present(df, column))
    return df


def _numbers(df: DataFrame, y: str) -> Column:
    """The numeric values of ``y``; a column of another type has none."""
    if not is_numeric(df, y):
        return F.lit(None).cast("double")
    value = F.col(y).cast("double")
    return F.when(~F.isnan(value), value)


def shown_value(df: DataFrame, column: str) -> Column:
    """A value as frequency tables show it: ``NA`` for missing, numbers to two decimals."""
    value = F.col(column)
    text = display_number(value) if is_numeric(df, column) else value.cast("string")
    return F.when(present(df, column), text).otherwise(F.lit("NA"))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, count, percent) of a field, most frequent first."""
    counts = df.groupBy(shown_value(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = counts.withColumn("_rows", rows).withColumn("percent", percent_of(F.col("count"), F.col("_rows")))
    return counts.drop("_rows").orderBy(F.col("count").desc(), "value")


def value_count(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """How many different values a field has, null counting as one."""
    counter = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    has_null = F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
    return df.agg((counter + has_null).alias("values"))


def coverage(loaded: DataFrame, everything: DataFrame) -> DataFrame:
    """Loaded rows out of all rows, with the percentage."""
    whole = everything.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = loaded.agg(F.count(F.lit(1)).alias("loaded")).withColumn("total", whole)
    share = F.when(F.col("total") > 0, percent_of(F.col("loaded"), F.col("total")))
    return out.withColumn("percent", F.coalesce(share, F.lit(0.0)))


def grouped_stats(
    df: DataFrame, x: str, y: str, group_values: int = GROUP_VALUES, **sketch: int
) -> DataFrame:
    """count, mean, median, min, max and population deviation of ``y`` per value of ``x``.

    Groups without any number get zeros. Rows missing ``x`` or ``y`` do not count.
    """
    rows = drop_missing(df, x, y).select(F.col(x).alias("group"), _numbers(df, y).alias("_y"))
    measures = [
        F.count(F.lit(1)).alias("count"),
        F.avg("_y").alias("mean"),
        F.min("_y").alias("min"),
        F.max("_y").alias("max"),
        F.stddev_pop("_y").alias("std"),
    ]
    few, many = by_richness(rows, ["group"], "_y", group_values)
    parts = []
    if few is not None:
        parts.append(few.groupBy("group").agg(*measures, F.percentile("_y", 0.5).alias("median")))
    if many is not None:
        medians = quantiles(many, ["group"], "_y", {"median": 0.5}, group_values=group_values, **sketch)
        parts.append(attach(many.groupBy("group").agg(*measures), medians, ["group"]))
    out = reduce(DataFrame.unionByName, parts)
    columns = ["mean", "median", "min", "max", "std"]
    return out.select("group", "count", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def grouped_mean_error(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean and standard error of ``y`` per ``x``; the error is 0 for fewer than two numbers."""
    rows = drop_missing(df, x, y).select(F.col(x).alias("group"), _numbers(df, y).alias("_y"))
    error = F.when(F.count("_y") > 1, F.stddev_samp("_y") / F.sqrt(F.count("_y"))).otherwise(F.lit(0.0))
    return rows.groupBy("group").agg(
        F.coalesce(F.avg("_y"), F.lit(0.0)).alias("mean"), error.alias("error")
    )


def category_counts(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Rows per category, or per pair of categories."""
    fields = [x] if y is None else [x, y]
    return drop_missing(df, *fields).groupBy(*fields).agg(F.count(F.lit(1)).alias("count"))


def histogram(df: DataFrame, y: str, by: str | None = None, width: float = BIN_WIDTH) -> DataFrame:
    """Rows per bin ``[bin, bin + width)``, optionally per value of another field."""
    rows = df.withColumn("_y", _numbers(df, y)).filter(F.col("_y").isNotNull())
    if by is not None:
        rows = rows.filter(present(df, by))
    start = (F.floor(F.col("_y") / width) * width).cast("double").alias("bin")
    keys = [start] if by is None else [F.col(by).alias("group"), start]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, x: str, y: str, rule: str = "linear", **limits: int) -> DataFrame:
    """Quartiles, fences and whiskers of ``y`` per ``x``, with the mean line of violin plots.

    Whiskers are the outermost values within 1.5 interquartile ranges of the quartiles.
    """
    rows = drop_missing(df, x, y).select(F.col(x).alias("group"), _numbers(df, y).alias("_y"))
    rows = rows.filter(F.col("_y").isNotNull())
    quartiles = quantiles(
        rows, ["group"], "_y", {"q1": 0.25, "median": 0.5, "q3": 0.75}, rule=rule, **limits
    )
    spread = F.col("q3") - F.col("q1")
    fenced = attach_stored(
        rows,
        quartiles.withColumn("lower_fence", F.col("q1") - 1.5 * spread).withColumn(
            "upper_fence", F.col("q3") + 1.5 * spread
        ),
        ["group"],
        "quartiles",
    )
    inside = (F.col("_y") >= F.col("lower_fence")) & (F.col("_y") <= F.col("upper_fence"))
    carried = ["q1", "median", "q3", "lower_fence", "upper_fence"]
    return fenced.groupBy("group", *carried).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_y").alias("mean"),
        F.min(F.when(inside, F.col("_y"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("_y"))).alias("upper_whisker"),
        F.count(F.when(~inside, 1)).alias("outliers"),
    )


def box_outliers(df: DataFrame, x: str, y: str, rule: str = "linear", **limits: int) -> DataFrame:
    """The rows of a table whose ``y`` lies outside the fences of its group."""
    rows = drop_missing(df, x, y).withColumn("_y", _numbers(df, y)).filter(F.col("_y").isNotNull())
    quartiles = quantiles(rows, [x], "_y", {"_q1": 0.25, "_q3": 0.75}, rule=rule, **limits)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    outside = (F.col("_y") < F.col("_q1") - reach) | (F.col("_y") > F.col("_q3") + reach)
    return attach_stored(rows, quartiles, [x], "quartiles").filter(outside).select(*df.columns)


def selected_size(df: DataFrame, size: str = "size") -> DataFrame:
    """Total size in GB, three decimals."""
    return df.agg(F.round(F.coalesce(F.sum(size), F.lit(0)) / 1024**3, 3).alias("gigabytes"))


def facet_sweep(df: DataFrame, fields: Sequence[str], y: str) -> DataFrame:
    """``y`` summarised against every field at once: one row per (field, value).

    ``count`` has all rows of the value, also those whose ``y`` is no number; the other figures take the numbers, and
    are 0 where there is none. The median is exact. Each row is widened to one row per field and aggregated before the
    shuffle.
    """
    texts = df.select(_numbers(df, y).alias("_y"), *[F.col(f).cast("string").alias(f) for f in fields])
    long = texts.unpivot(["_y"], list(fields), "field", "value")
    number = F.when(~F.isnan("_y"), F.col("_y"))
    rows = long.filter(F.col("value").isNotNull() & (F.col("value") != "")).withColumn("_y", number)
    figures = rows.groupBy("field", "value").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_y").alias("mean"),
        F.min("_y").alias("min"),
        F.max("_y").alias("max"),
        F.stddev_pop("_y").alias("std"),
    )
    medians = quantiles(rows, ["field", "value"], "_y", {"median": 0.5})
    return figures.join(medians, ["field", "value"], "left").fillna(0.0, ["mean", "median", "min", "max", "std"])


def tag_facets(catalog: DataFrame) -> DataFrame:
    """Datasets per tag with the tag's namespace, by the latest version of each; datasets without tags fall under
    ``No tags``."""
    catalog = latest(catalog)
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("No tags")))
    exploded = catalog.select("key", F.explode(F.array_distinct(tags)).alias("tag"))
    head = F.substring_index("tag", ":", 1)
    space = (
        F.when(F.col("tag") == "No tags", "none")
        .when(F.col("tag").contains(":") & head.isin("disease", "organ"), head)
        .otherwise("org")
    )
    return (
        exploded.groupBy("tag").agg(F.count(F.lit(1)).alias("datasets")).withColumn("namespace", space)
    )


def datasets_of_tag(catalog: DataFrame) -> DataFrame:
    """The (tag, dataset key) pairs behind the facets."""
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("No tags")))
    return catalog.select(F.explode(F.array_distinct(tags)).alias("tag"), "key")
