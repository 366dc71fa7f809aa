"""Checks over many dataset bundles or rows at once; each returns the violations as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fields every metadata dictionary needs, key shape and the dictionary types.
REQUIRED_FIELDS = ("sample_id",)
KEY_PATTERN = r"^[a-z][a-z0-9_]*$"
DATA_TYPES = ("STRING", "NUMBER", "BOOLEAN")
# Files a complete bundle has.
BUNDLE_FILES = ("metadata_table.parquet", "metadata_dictionary.json", "dataset.json", "datafile.tsv")


def missing_fields(
    dictionary: DataFrame, required: Sequence[str] = REQUIRED_FIELDS, bundle: str = "bundle", bundles: DataFrame | None = None
) -> DataFrame:
    """(bundle, key) of required fields a bundle's dictionary lacks."""
    every = (bundles if bundles is not None else dictionary).select(bundle).distinct()
    wanted = every.select(bundle, F.explode(F.array(*[F.lit(r) for r in required])).alias("key"))
    return wanted.join(dictionary.select(bundle, "key").distinct(), [bundle, "key"], "left_anti")


def missing_columns(dictionary: DataFrame, columns: DataFrame, bundle: str = "bundle") -> DataFrame:
    """(bundle, key) of dictionary fields that are no column of the bundle's table."""
    have = columns.select(bundle, F.col("column").alias("key")).distinct()
    return dictionary.select(bundle, "key").distinct().join(have, [bundle, "key"], "left_anti")


def rule_violations(dictionary: DataFrame, bundle: str = "bundle") -> DataFrame:
    """(bundle, key, data_type, problem): a bad key first, otherwise a bad type."""
    problem = F.when(~F.col("key").rlike(KEY_PATTERN), "invalid key").when(
        ~F.col("data_type").isin(*DATA_TYPES), "invalid data_type"
    )
    found = dictionary.select(bundle, "key", "data_type", problem.alias("problem"))
    return found.filter(F.col("problem").isNotNull())


def incomplete_bundles(
    listing: DataFrame,
    datasets: DataFrame | None = None,
    expected: Sequence[str] = BUNDLE_FILES,
    table_pattern: str = r"^datafiles/[^/]+\.parquet$",
) -> DataFrame:
    """(bundle, problem) of bundles with missing files or a key that is not their directory.

    ``listing`` has (bundle, file), bundle being ``<key>/<version>`` and file the path below it.
    ``datasets`` has (bundle, key) as read from each ``dataset.json``.
    """
    files = listing.select("bundle", "file").distinct()
    bundles = files.select("bundle").distinct()
    wanted = bundles.select("bundle", F.explode(F.array(*[F.lit(f) for f in expected])).alias("file"))
    absent = wanted.join(files, ["bundle", "file"], "left_anti")
    problems = absent.select("bundle", F.concat(F.lit("missing "), F.col("file")).alias("problem"))
    with_table = files.filter(F.col("file").rlike(table_pattern)).select("bundle").distinct()
    no_table = bundles.join(with_table, "bundle", "left_anti")
    problems = problems.unionByName(no_table.select("bundle", F.lit("no datafile table").alias("problem")))
    if datasets is not None:
        wrong = datasets.filter(~F.col("key").eqNullSafe(F.substring_index("bundle", "/", 1)))
        problems = problems.unionByName(wrong.select("bundle", F.lit("key does not match directory").alias("problem")))
    return problems


def table_problems(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """(bundle, table, problem) of datafile tables whose description, dictionary and data do not fit.

    ``tables`` has (bundle, table, id_column, columns) with the columns of the data as an array, null for a missing file;
    ``fields`` has (bundle, table, key) of the dictionaries.
    """
    keys = fields.groupBy("bundle", "table").agg(F.collect_set("key").alias("_keys"))
    rows = tables.join(keys, ["bundle", "table"], "left")
    problems = F.array_compact(F.array(
        F.when(F.col("columns").isNull(), "missing data"),
        F.when(F.col("_keys").isNull(), "missing dictionary"),
        F.when(~F.array_contains("_keys", F.col("id_column")), "id column not in dictionary"),
        F.when(F.size(F.array_except("_keys", "columns")) > 0, "dictionary field not in data"),
        F.when(F.size(F.array_except("columns", "_keys")) > 0, "data column not in dictionary"),
    ))
    return rows.select("bundle", "table", F.explode(problems).alias("problem"))


def unreadable_datafiles(rows: DataFrame) -> DataFrame:
    """(bundle, guid, problem) of rows of ``datafile.tsv`` that do not parse: texts in the flattened registry form."""
    def whole(column: str) -> Column:
        return F.coalesce(F.col(column).rlike(r"^\d+$"), F.lit(False))

    problems = F.array_compact(F.array(
        F.when(F.coalesce(F.col("guid"), F.lit("")) == "", "no guid"),
        F.when(F.coalesce(F.col("filename"), F.lit("")) == "", "no filename"),
        *[F.when(~whole(c), f"{c} is not a whole number") for c in ("size", "created_at", "updated_at", "version")],
    ))
    return rows.select("bundle", "guid", F.explode(problems).alias("problem"))


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reasons``: the names of all rules a row breaks. A rule that is null counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*broken)))


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def check_lines(
    lines: DataFrame, schema: str, rules: Mapping[str, Column], sep: str = ",", header: bool = True
) -> DataFrame:
    """Parse delimited lines and report the bad ones: (file, line, reasons).

    ``lines`` has (file, line, value) with lines counted from 1, see ``sources.lines``. A line whose
    cells do not fit the schema breaks the rule ``cannot be parsed``.
    """
    rows = lines.filter(F.col("value") != "")
    if header:
        rows = rows.filter(F.col("line") > 1)
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = rows.select("file", "line", F.from_csv("value", f"{schema}, _corrupt string", options).alias("row"))
    checked = check_rows(
        parsed.select("file", "line", "row.*"), {"cannot be parsed": F.col("_corrupt").isNull(), **rules}
    )
    return rejected(checked).select("file", "line", "reasons")
