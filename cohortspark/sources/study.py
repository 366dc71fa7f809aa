"""Raw study folders: annotated tables, key-value files, omics matrices and their conversion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.functions.names import drop_duplicate_columns, normalize_name, select_positions
from cohortspark.functions.scalars import MISSING_TOKENS, TABLE_MISSING_TOKENS, missing_to_null
from cohortspark.operators import profile
from cohortspark.operators.merge import merge_clinical
from cohortspark.operators.reshape import SAMPLE, matrix_long, matrix_wide
from cohortspark.sources.sinks import write_table_bundle

# Prefixes of the omics files that get converted.
OMICS_PREFIXES = ("cna", "mutation", "mrna_seq", "sv", "methylation")
# The id column of each kind of alteration table.
ID_COLUMNS = {
    "COPY_NUMBER_ALTERATION": "sample_id",
    "MUTATION_EXTENDED": "Tumor_Sample_Barcode",
    "STRUCTURAL_VARIANT": "Sample_Id",
    "MRNA_EXPRESSION": "sample_id",
    "METHYLATION": "sample_id",
}
# The kinds that are gene by sample matrices.
MATRIX_KINDS = ("COPY_NUMBER_ALTERATION", "MRNA_EXPRESSION", "METHYLATION")
# What the comment rows of an annotated table hold, in order.
HEADER_ROWS = ("name", "description", "data_type", "order")


def omics_pairs(listing: DataFrame, path: str = "path") -> DataFrame:
    """(prefix, data_path, meta_path) of ``data_<p>.txt`` files with their ``meta_<p>.txt``."""
    shape = rf"(data|meta)_((?:{'|'.join(OMICS_PREFIXES)}).*)\.txt$"
    name = F.element_at(F.split(F.col(path), "/"), -1)
    files = listing.select(
        F.col(path).alias("path"),
        F.regexp_extract(F.col(path), r"^(.*)/[^/]+$", 1).alias("folder"),
        F.regexp_extract(name, f"^{shape}", 1).alias("kind"),
        F.regexp_extract(name, f"^{shape}", 2).alias("prefix"),
    )
    data = files.filter(F.col("kind") == "data").select("folder", "prefix", F.col("path").alias("data_path"))
    meta = files.filter(F.col("kind") == "meta").select("folder", "prefix", F.col("path").alias("meta_path"))
    return data.join(meta, ["folder", "prefix"], "inner")


def key_values(lines: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """(file, key, value) of ``key: value`` lines; of repeated keys the last line counts.

    ``lines`` has (file, line, value). Lines without a colon are skipped.
    """
    parts = F.split(F.trim(F.col(value)), ":", 2)
    pairs = lines.filter(F.col(value).contains(":")).select(
        file, F.trim(parts[0]).alias("key"), F.struct("line", F.trim(parts[1]).alias("value")).alias("_last")
    )
    return pairs.groupBy(file, "key").agg(F.max("_last").alias("_last")).select(file, "key", F.col("_last.value").alias("value"))


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """(file, line, value) of text files; line numbers rise within a file but may have gaps."""
    return spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value"
    )


def _fields(pairs: DataFrame, names: Sequence[str], file: str = "file") -> DataFrame:
    columns = [F.max(F.when(F.col("key") == n, F.col("value"))).alias(n) for n in names]
    return pairs.groupBy(file).agg(*columns)


def _list(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda t: F.trim(t)), lambda t: t != "")


def study_records(pairs: DataFrame, file: str = "file") -> DataFrame:
    """Dataset records of ``dataset.txt`` style key-value pairs, one per file."""
    names = ("key", "name", "description", "citation", "pmid", "groups", "tags", "total", "is_filebased", "version", "license")
    rows = _fields(pairs, names, file)

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    return rows.select(
        file,
        text("key", "unknown"),
        text("name", "Unnamed Study"),
        text("description"),
        text("citation"),
        text("pmid"),
        _list(F.col("groups")).alias("groups"),
        _list(F.col("tags")).alias("tags"),
        F.coalesce(F.col("total").try_cast("long"), F.lit(0)).alias("total"),
        F.coalesce(F.lower("is_filebased") == "true", F.lit(False)).alias("is_filebased"),
        text("version", "v0.0.1"),
        text("license"),
    )


def omics_records(pairs: DataFrame, file: str = "file") -> DataFrame:
    """Table descriptions of ``meta_<p>.txt`` key-value pairs, one per file."""
    names = ("stable_id", "profile_description", "datatype", "genetic_alteration_type")
    rows = _fields(pairs, names, file).fillna("", subset=list(names))
    ids = F.coalesce(
        *[F.when(F.col("genetic_alteration_type") == kind, F.lit(name)) for kind, name in ID_COLUMNS.items()],
        F.lit("sample_id"),
    )
    return rows.select(
        file,
        F.upper("stable_id").alias("title"),
        F.col("profile_description").alias("description"),
        "datatype",
        "genetic_alteration_type",
        ids.alias("id_column_name"),
    )


def read_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An annotated table and its header: texts with normalised column names, and
    (key, name, description, data_type, order).

    ``path`` is a file, or a folder of which one file has the comment rows and the row of column ids, and any file has
    rows. Only the comment rows and the row of column ids reach the driver.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    marked = text.filter(F.col("value").startswith("#")).limit(4).collect()
    comments = [r["value"][1:].strip("\r\n").split("\t") for r in marked]
    own = F.col("file") == (marked[0]["file"] if marked else "")
    head = text.filter(own & ~F.col("value").startswith("#") & (F.trim("value") != "")).limit(1).collect()
    if len(comments) < 4 or not head:
        raise ValueError(f"{path} needs four comment rows and a row of column ids")
    ids = head[0]["value"].strip().split("\t")
    columns = ", ".join(f"_c{i} string" for i in range(len(ids)))
    body = spark.read.schema(columns).csv(
        path, sep="\t", comment="#", header=False, quote="", escape="", enforceSchema=True, mode="PERMISSIVE"
    )
    is_head = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(f"_c{i}")), F.lit("")) == name.strip() for i, name in enumerate(ids)])
    body = body.filter(~is_head)
    first = {}
    for i, name in enumerate(ids):
        first.setdefault(normalize_name(name), i)
    rows = []
    for key, i in first.items():
        cells = [row[i].strip() if i < len(row) else "" for row in comments]
        order = int(cells[3]) if cells[3].lstrip("+-").isdigit() else 0
        rows.append((key, cells[0], cells[1], cells[2].upper(), order))
    header = spark.createDataFrame(rows, "key string, name string, description string, data_type string, order int")
    return select_positions(body, [(i, key) for key, i in first.items()]), header


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with all columns as texts; empty cells are null."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', mode="PERMISSIVE")


def typed_table(raw: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> tuple[DataFrame, dict[str, str]]:
    """Replace placeholders of missing values and cast every column to its inferred type."""
    cleaned = raw.select(*[missing_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in raw.columns])
    types = profile.types_of(cleaned)
    return profile.cast_to(cleaned, types), types


def convert_omics(
    spark: SparkSession,
    data_path: str,
    meta_path: str,
    output: str,
    prefix: str,
    genes: Sequence[str] | None = None,
) -> DataFrame:
    """Convert one omics file to a table bundle at ``<output>/<prefix>*`` and return its data.

    Event tables stay as they are. Matrices are stored long as (sample_id, gene_symbol, value); a
    gene list asks for the wide form with those genes as columns.
    """
    meta = omics_records(key_values(read_lines(spark, meta_path)))
    about = meta.drop("file").first()
    kind = about["genetic_alteration_type"] if about else ""
    raw = read_matrix(spark, data_path)
    if kind in MATRIX_KINDS:
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        cells = [missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns]
        long = matrix_long(raw.select(*cells, place.alias("_place")), "_place", kind != "METHYLATION")
        table = matrix_wide(long, genes) if genes else long
        keep = {SAMPLE: profile.STRING, "gene_symbol": profile.STRING}
        types = {**profile.types_of(table), **{k: v for k, v in keep.items() if k in table.columns}}
        table = profile.cast_to(table, types)
    else:
        table, types = typed_table(raw)
    table = drop_duplicate_columns(table, lambda name: normalize_name(name, lower=False))
    write_table_bundle(table, meta.drop("file"), output, prefix)
    return spark.read.parquet(f"{output}/{prefix}.parquet")


def convert_annotated(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An annotated metadata table as typed data and its dictionary, by declared types.

    Values that do not fit the declared type keep the whole column as text.
    """
    raw, header = read_annotated(spark, path)
    cleaned = raw.select(*[missing_to_null(F.col(c), TABLE_MISSING_TOKENS).alias(c) for c in raw.columns])
    declared = {r["key"]: r["data_type"] for r in header.select("key", "data_type").collect()}
    inferred = profile.types_of(cleaned)

    def settled(name: str) -> str:
        wanted = declared.get(name, profile.STRING)
        return wanted if wanted == inferred[name] else profile.STRING

    types = {c: settled(c) for c in cleaned.columns}
    return profile.cast_to(cleaned, types), _dictionary(cleaned, header, types)


def convert_clinical(samples: tuple[DataFrame, DataFrame], patients: tuple[DataFrame, DataFrame], key: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """Merge sample and patient tables by patient; declared types give way to what values show."""
    merged = merge_clinical(samples[0], patients[0], key)
    own = patients[1].join(samples[1].select("key"), "key", "left_anti")
    header = samples[1].unionByName(own)
    declared = {r["key"]: r["data_type"] for r in header.select("key", "data_type").collect()}
    typed, types = profile.cast_declared(merged, declared)
    return typed, _dictionary(merged, header, types)


def _dictionary(texts: DataFrame, header: DataFrame, types: dict[str, str]) -> DataFrame:
    """Dictionary of a table of texts under settled types."""
    typed = profile.cast_to(texts, types)
    fields = profile.dictionary(typed, header)
    pairs = [part for name, kind in types.items() for part in (F.lit(name), F.lit(kind))]
    settled = F.create_map(*pairs)[F.col("key")]
    is_number = settled == profile.NUMBER
    return fields.withColumn("data_type", settled).withColumns(
        {c: F.when(is_number, F.col(c)) for c in ("minimum", "maximum")}
    )
