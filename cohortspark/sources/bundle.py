"""Dataset bundles: ``<base>/index.json`` and ``<base>/<key>/<version>/`` folders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fields of a dataset record, of a dictionary field, of a table description.
DATASET_SCHEMA = (
    "key string, name string, description string, citation string, pmid string, groups array<string>, "
    "tags array<string>, total bigint, is_filebased boolean, version string, license string"
)
TABLE_SCHEMA = (
    "title string, description string, datatype string, genetic_alteration_type string, id_column_name string"
)
FIELD_SCHEMA = (
    "key string, name string, description string, data_type string, notes string, allowed_values string, "
    "order int, part int"
)
# The three files of one datafile table.
GROUP_FILE = r"([^/]+?)(\.parquet|_dictionary\.json|_metadata\.json)$"

SAMPLE_ID = "sample_id"


def _file_path() -> Column:
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _bundle_of(path: Column, depth: int) -> Column:
    """``<key>/<version>`` of a path whose bundle folder lies ``depth`` levels above the file."""
    return F.concat_ws("/", F.element_at(F.split(path, "/"), -depth - 2), F.element_at(F.split(path, "/"), -depth - 1))


def read_catalog(spark: SparkSession, base: str) -> DataFrame:
    """Dataset records of ``index.json``."""
    return spark.read.schema(DATASET_SCHEMA).json(f"{base}/index.json", multiLine=True)


def scan_datasets(spark: SparkSession, base: str) -> DataFrame:
    """Every ``dataset.json`` below the base with its bundle; malformed ones have no key."""
    rows = spark.read.schema(DATASET_SCHEMA).json(f"{base}/*/*/dataset.json", multiLine=True, mode="PERMISSIVE")
    path = F.regexp_replace(_file_path(), r"(/dataset\.json)/[^/]+$", "$1")  # a file, or a folder of one part
    return rows.select(_bundle_of(path, 1).alias("bundle"), *rows.columns)


def write_datasets(records: DataFrame, base: str) -> None:
    """Write (key, version, value) as ``<base>/<key>/<version>/dataset.json``, many files per task.

    A record is a file of its own, so a task that runs again writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for key, version, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store.create_dir(f"{root}/{key}/{version}")
                with store.open_output_stream(f"{root}/{key}/{version}/dataset.json") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    records.select("key", "version", "value").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def build_catalog(spark: SparkSession, base: str, output: str | None = None) -> DataFrame:
    """Collect all readable dataset records; with ``output`` also write ``<output>/index.json``, which ``read_catalog``
    reads back: one array."""
    from cohortspark.sources.sinks import write_json_array

    catalog = scan_datasets(spark, base).filter(F.col("key").isNotNull()).drop("bundle")
    if output:
        write_json_array(catalog.withColumn("_by", F.struct("key", "version")), f"{output}/index.json", by="_by")
        return read_catalog(spark, output)
    return catalog


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, modificationTime) of files matching a glob; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")


def bundle_listing(spark: SparkSession, base: str) -> DataFrame:
    """(bundle, file) of everything below ``<base>/<key>/<version>``, file relative to the bundle.

    Bundles may differ in what they have, so both levels are listed with one recursive scan.
    """
    root = base.rstrip("/").split("://")[-1]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"))
    )
    below = F.regexp_replace(F.substring_index("path", f"{root}/", -1), "^/+", "")
    parts = F.split(below, "/", 3)
    return files.select(parts.alias("p")).filter(F.size("p") == 3).select(
        F.concat_ws("/", F.col("p")[0], F.col("p")[1]).alias("bundle"), F.col("p")[2].alias("file")
    )


def file_groups(listing: DataFrame, path: str = "path") -> DataFrame:
    """Prefixes with all of table, dictionary and description: (folder, prefix, three paths).

    A table may be one ``.parquet`` file or a ``.parquet`` folder of part files.
    """
    table = F.regexp_replace(F.col(path), r"\.parquet/[^/]+$", ".parquet")
    parts = listing.select(
        table.alias("path"),
        F.regexp_extract(table, r"^(.*)/[^/]+$", 1).alias("folder"),
        F.regexp_extract(table, GROUP_FILE, 1).alias("prefix"),
        F.regexp_extract(table, GROUP_FILE, 2).alias("suffix"),
    ).filter(F.col("suffix") != "")

    def path_of(suffix: str) -> Column:
        return F.min(F.when(F.col("suffix") == suffix, F.col("path")))

    groups = parts.groupBy("folder", "prefix").agg(
        path_of(".parquet").alias("parquet"),
        path_of("_dictionary.json").alias("dictionary"),
        path_of("_metadata.json").alias("metadata"),
    )
    return groups.dropna(subset=["parquet", "dictionary", "metadata"])


def _dictionaries(spark: SparkSession, pattern: str, depth: int) -> DataFrame:
    """All rows of dictionaries with (bundle, table); a dictionary may be a file or a folder of parts."""
    rows = spark.read.schema(FIELD_SCHEMA).json(pattern, multiLine=True)
    path = F.regexp_replace(_file_path(), r"(_dictionary\.json)/[^/]+$", "$1")
    table = F.regexp_extract(path, r"([^/]+)_dictionary\.json$", 1)
    return rows.select(_bundle_of(path, depth).alias("bundle"), table.alias("table"), *rows.columns)


def read_dictionaries(spark: SparkSession, pattern: str, depth: int = 1) -> DataFrame:
    """Dictionary fields of many bundles with (bundle, table), a row per field; the first allowed values stay JSON text."""
    return _dictionaries(spark, pattern, depth).filter(F.col("part").isNull()).drop("part")


def read_allowed_values(spark: SparkSession, pattern: str, depth: int = 1) -> DataFrame:
    """(bundle, table, key, data_type, value): all allowed values, or both limits of a number, as rows of texts."""
    values = F.explode(F.from_json("allowed_values", "array<string>")).alias("value")
    return _dictionaries(spark, pattern, depth).select("bundle", "table", "key", "data_type", values)


def parquet_columns(paths: DataFrame, bundle: str = "bundle", path: str = "path") -> DataFrame:
    """(bundle, column) of Parquet files, read from their footers inside tasks."""

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            found = []
            for name, uri in zip(batch[bundle], batch[path]):
                store, inner = fs.FileSystem.from_uri(uri)
                with store.open_input_file(inner) as handle:
                    found += [(name, column) for column in pq.read_schema(handle).names]
            yield pd.DataFrame(found, columns=[bundle, "column"])

    wanted = paths.select(bundle, path)
    return wanted.mapInPandas(footers, f"{bundle} string, column string").distinct()


@dataclass(frozen=True)
class Table:
    """A lazily scanned table and the column its samples are identified by."""

    data: DataFrame
    id_column: str
    title: str = ""
    description: str = ""


class Dataset:
    """One bundle: its metadata table and its datafile tables, all lazy scans."""

    def __init__(self, spark: SparkSession, base: str, key: str, version: str):
        self.spark, self.path = spark, f"{base.rstrip('/')}/{key}/{version}"

    def metadata(self) -> Table:
        return Table(self.spark.read.parquet(f"{self.path}/metadata_table.parquet"), SAMPLE_ID)

    def table(self, name: str) -> Table:
        """A datafile table by its prefix, or ``metadata_table``."""
        if name == "metadata_table":
            return self.metadata()
        folder = f"{self.path}/datafiles"
        about = self.spark.read.schema(TABLE_SCHEMA).json(f"{folder}/{name}_metadata.json", multiLine=True).first()
        if about is None or not about["id_column_name"]:
            raise ValueError(f"{name} has no readable description")
        data = self.spark.read.parquet(f"{folder}/{name}.parquet")
        return Table(data, about["id_column_name"], about["title"] or "", about["description"] or "")

    def dictionary(self, name: str = "metadata") -> DataFrame:
        folder = self.path if name == "metadata" else f"{self.path}/datafiles"
        rows = self.spark.read.schema(FIELD_SCHEMA).json(f"{folder}/{name}_dictionary.json", multiLine=True)
        return rows.filter(F.col("part").isNull()).drop("part")

    def tables(self, names: Sequence[str]) -> dict[str, DataFrame]:
        """DataFrames by name, as query descriptions want them."""
        return {name: self.table(name).data for name in names}
