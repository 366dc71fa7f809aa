"""Writers. Every output is a new path; nothing that is being read gets overwritten."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.operators.profile import VALUES_PER_ROW, value_lists


def rows_as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects in one text column, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, emptyValue="", nullValue="")


def dictionary_rows(fields: DataFrame, values: DataFrame, *more: str, per_row: int = VALUES_PER_ROW) -> DataFrame:
    """Dictionary fields in the shape they are stored in, with ``more`` columns to order them by.

    ``allowed_values`` is ``[min, max]`` of a number, and the ordered values of any other field. A field of more than
    ``per_row`` values goes on in rows with a ``part`` of 1, 2, ..., so no row is larger than that.
    """
    rows = fields.join(value_lists(values, per_row), F.col("key") == F.col("_key"), "left")
    limits = F.to_json(F.array("minimum", "maximum"))
    listed = F.to_json(F.coalesce("values", F.array().cast("array<string>")))
    return rows.select(
        *more,
        "key",
        "name",
        "description",
        "data_type",
        "notes",
        F.try_parse_json(F.when(F.col("data_type") == "NUMBER", limits).otherwise(listed)).alias("allowed_values"),
        "order",
        "part",
    )


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON texts of a task as the lines of one array."""
    held = None
    for batch in batches:
        texts = batch.column(0).to_pylist()
        if not texts:
            continue
        lines = ["["] if held is None else [f"{held},"]
        lines += [f"{text}," for text in texts[:-1]]
        held = texts[-1]
        yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held, "]"])], names=["value"])


def write_json_array(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write a table as JSON arrays below ``path``, a row per line, in the order of the column ``by``, which is not written.

    Every task writes a part of its own that is a whole array, and Spark publishes all parts together; small tables are one
    part. Read them as one with ``spark.read.json(path, multiLine=True)``, which takes a file as well.
    """
    columns = [c for c in df.columns if c != by]
    json = F.to_json(F.struct(*columns)).alias("value")
    ordered = df.repartitionByRange(by).sortWithinPartitions(by) if by else df
    ordered.select(json).mapInArrow(_arrays, "value string").write.text(path)


def write_table_bundle(table: DataFrame, about: DataFrame, output: str, prefix: str, per_row: int = VALUES_PER_ROW) -> None:
    """Parquet, TSV, dictionary, values and description of one table below ``output``.

    The dictionary comes from the Parquet just written, so a heavy conversion runs once. The values of all fields are in
    ``<prefix>_values.parquet`` with their counts.
    """
    from cohortspark.operators.profile import field_values

    table.write.parquet(f"{output}/{prefix}.parquet")
    stored = table.sparkSession.read.parquet(f"{output}/{prefix}.parquet")
    write_tsv(stored, f"{output}/{prefix}.tsv")
    write_dictionary(stored, f"{output}/{prefix}_dictionary.json", per_row=per_row)
    write_json_array(about, f"{output}/{prefix}_metadata.json")
    field_values(stored).write.parquet(f"{output}/{prefix}_values.parquet")


def write_dictionary(stored: DataFrame, path: str, fields: DataFrame | None = None, per_row: int = VALUES_PER_ROW) -> None:
    """The dictionary of a stored table, or the given ``fields`` of it, with the values of the table."""
    from cohortspark.operators.profile import dictionary, dictionary_values

    fields = dictionary(stored) if fields is None else fields
    rows = dictionary_rows(fields, dictionary_values(stored, fields), "position", per_row=per_row)
    write_json_array(rows.withColumn("_by", F.struct("position", "part")).drop("position"), path, by="_by")
