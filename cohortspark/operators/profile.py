"""Type inference, typed casts, data dictionaries and view recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.functions.scalars import boolean_value, missing_to_null
from cohortspark.operators.ordered import GROUP_ROWS, row_numbers
from cohortspark.operators.survival import ENDPOINTS

STRING, NUMBER, BOOLEAN = "STRING", "NUMBER", "BOOLEAN"

# Texts read as numbers and as booleans by type inference.
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
BOOLEAN_TEXTS = ("True", "False", "true", "false", "0", "1")

# Limits of the view recommendation.
PIE_VALUES, BAR_VALUES, TABLE_VALUES, ID_VALUES, LINE_VALUES = 6, 25, 500, 100, 50
ID_RATIO = 0.8

DICTIONARY_ROW = (
    "key string, position int, data_type string, notes string, minimum double, maximum double, value_count bigint"
)

#: Values of a field that one dictionary row lists, at most; a field of more has more rows, numbered by ``part``.
VALUES_PER_ROW = 10_000

#: Up to this many columns types are inferred by one plain aggregate over the table.
MEASURED_COLUMNS = 100


def is_number_text(col: Column) -> Column:
    return col.rlike(NUMBER_TEXT)


def number_value(col: Column) -> Column:
    """A text as a number; null when it is none. ``1d`` is no number, although Spark casts it."""
    return F.when(is_number_text(col), F.trim(col).try_cast("double"))


def _cells(df: DataFrame) -> DataFrame:
    """All cells as (key, value) texts. Every row widens to its cells inside the scan stage."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return texts.unpivot([], df.columns, "key", "value")


def _type_of(present: Column, numbers: Column, booleans: Column) -> Column:
    return (
        F.when(present == 0, STRING)
        .when(numbers == present, NUMBER)
        .when(booleans == present, BOOLEAN)
        .otherwise(STRING)
    )


def infer_types(df: DataFrame) -> DataFrame:
    """(key, data_type) of every column of a table of texts, in one pass.

    All values numeric: NUMBER; all boolean texts: BOOLEAN; otherwise, or without values, STRING.
    """

    def counts(value: Column) -> list[Column]:
        return [
            F.count(value).alias("present"),
            F.count(F.when(is_number_text(value), 1)).alias("numbers"),
            F.count(F.when(value.isin(*BOOLEAN_TEXTS), 1)).alias("booleans"),
        ]

    if len(df.columns) <= MEASURED_COLUMNS:
        # one row per task, no shuffle of cells
        fields = [
            F.struct(F.lit(c).alias("key"), *counts(F.col(f"`{c}`").cast("string"))).alias(f"_c{i}")
            for i, c in enumerate(df.columns)
        ]
        table = df.agg(*fields).select(F.inline(F.array(*[f"_c{i}" for i in range(len(fields))])))
    else:
        table = _cells(df).groupBy("key").agg(*counts(F.col("value")))
    kind = _type_of(F.col("present"), F.col("numbers"), F.col("booleans"))
    return table.select("key", kind.alias("data_type"))


def types_of(df: DataFrame) -> dict[str, str]:
    """Inferred types as a dict; only one row per column reaches the driver."""
    found = {row["key"]: row["data_type"] for row in infer_types(df).collect()}
    return {c: found.get(c, STRING) for c in df.columns}


def cast_to(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast columns of texts to their dictionary types."""

    def cast(name: str) -> Column:
        column = F.col(f"`{name}`")
        kind = types.get(name, STRING)
        if kind == NUMBER:
            return number_value(column).alias(name)
        return boolean_value(column).alias(name) if kind == BOOLEAN else column.alias(name)

    return df.select(*[cast(c) for c in df.columns])


def cast_declared(df: DataFrame, declared: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Cast to declared types; where the values disagree, the inferred type wins.

    Placeholders for missing values become null in columns declared NUMBER only.
    """
    cleaned = df.select(
        *[
            (missing_to_null(F.col(f"`{c}`")) if declared.get(c) == NUMBER else F.col(f"`{c}`")).alias(c)
            for c in df.columns
        ]
    )
    types = types_of(cleaned)
    return cast_to(cleaned, types), types


def type_conflicts(df: DataFrame, declared: DataFrame) -> DataFrame:
    """(key, declared, inferred) of columns whose values disagree with their declared type."""
    both = infer_types(df).join(declared.select("key", F.col("data_type").alias("declared")), "key")
    return both.filter(F.col("declared") != F.col("data_type")).select(
        "key", "declared", F.col("data_type").alias("inferred")
    )


def field_values(df: DataFrame) -> DataFrame:
    """Every distinct value of every column with its count: (key, value, count)."""
    return _cells(df).filter(F.col("value").isNotNull()).groupBy("key", "value").agg(F.count(F.lit(1)).alias("count"))


def dictionary(df: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """One row per column: key, position, data_type, notes, range of a number, number of values, name, description, order.

    The values themselves are rows of ``dictionary_values``. ``header`` adds name, description and order by key. All
    columns are measured in one pass; one row per column comes to the driver.
    """
    values = field_values(df)
    value = F.col("value")
    number = number_value(value)
    stats = values.groupBy("key").agg(
        F.count(F.lit(1)).alias("value_count"),
        F.sum("count").alias("present"),
        F.sum(F.when(is_number_text(value), F.col("count")).otherwise(0)).alias("numbers"),
        F.sum(F.when(value.isin(*BOOLEAN_TEXTS), F.col("count")).otherwise(0)).alias("booleans"),
        F.min(number).alias("_min"),
        F.max(number).alias("_max"),
    )
    kind = _type_of(F.col("present"), F.col("numbers"), F.col("booleans"))
    stats = stats.select("key", "value_count", "present", kind.alias("data_type"), "_min", "_max")
    found = {row["key"]: row for row in stats.collect()}
    rows = []
    for position, key in enumerate(df.columns):
        row = found.get(key)
        is_number = row is not None and row["data_type"] == NUMBER
        rows.append(
            (
                key,
                position,
                row["data_type"] if row else STRING,
                "",
                row["_min"] if is_number else None,
                row["_max"] if is_number else None,
                row["value_count"] if row else 0,
            )
        )
    out = df.sparkSession.createDataFrame(rows, DICTIONARY_ROW)
    if header is None:
        return out.select(
            "*", F.col("key").alias("name"), F.lit("").alias("description"), F.lit(0).alias("order")
        )
    return out.join(header.select("key", "name", "description", "order"), "key", "left")


def dictionary_values(df: DataFrame, fields: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, place, value): the distinct values of every field that is no number, numbered from 1 in their order.

    A reader takes them for what is allowed, so all are there; a field of any number of values is cut into ranges to be
    ordered. Only the columns asked for are read.
    """
    listed = {r["key"] for r in fields.filter(F.col("data_type") != NUMBER).select("key").collect()}
    columns = [c for c in df.columns if c in listed]
    if not columns:
        return df.sparkSession.createDataFrame([], "key string, place long, value string")
    values = _cells(df.select(*[F.col(f"`{c}`") for c in columns])).filter(F.col("value").isNotNull()).distinct()
    return row_numbers(values, ["key"], [("value", False)], "place", group_rows).select("key", "place", "value")


def value_lists(values: DataFrame, per_row: int = VALUES_PER_ROW) -> DataFrame:
    """(_key, part, values): the rows of ``dictionary_values`` as ordered lists of ``per_row`` values at most.

    The first list of a field has no ``part``; a field of more values goes on in parts 1, 2, ..., so no row is larger than
    that, whatever the field.
    """
    part = F.floor((F.col("place") - 1) / per_row).cast("int")
    lists = values.groupBy(F.col("key").alias("_key"), part.alias("_part")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda v: v["value"]).alias("values"))
    return lists.select("_key", F.when(F.col("_part") > 0, F.col("_part")).alias("part"), "values")


def recommend_view(fields: DataFrame, total: Column, selected: Sequence[str] = ()) -> DataFrame:
    """Add ``view`` to dictionary fields by type and number of values; ``total`` counts the rows."""
    times = [
        f"{e}_months" for e in ENDPOINTS if f"{e}_months" in selected and f"{e}_status" in selected
    ]
    n = F.col("value_count")
    ratio = n / total
    is_string, is_number = F.col("data_type") == STRING, F.col("data_type") == NUMBER
    view = (
        F.when(F.col("key").isin(*times) if times else F.lit(False), "kaplan_meier")
        .when(F.col("key") == "__summary", "summary")
        .when(F.col("data_type") == BOOLEAN, "pie")
        .when(is_string & (n <= PIE_VALUES), "pie")
        .when(is_string & (n <= BAR_VALUES), "bar")
        .when(is_string & (ratio <= ID_RATIO) & (n <= TABLE_VALUES), "table")
        .when(is_string & (ratio > ID_RATIO) & (n > ID_VALUES), "id")
        .when(is_number & (n <= LINE_VALUES), "linechart")
        .when(is_number, "histogram")
        .otherwise("unsupported")
    )
    return fields.withColumn("view", view)


def recommend_grouped_view(x_type: Column, y_type: Column) -> Column:
    """View for two fields together."""
    return (
        F.when((x_type == STRING) & (y_type == NUMBER), "box")
        .when((x_type == NUMBER) & (y_type == NUMBER), "scatter")
        .when((x_type == STRING) & (y_type == STRING), "summary")
        .otherwise("unsupported")
    )
