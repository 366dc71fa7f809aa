"""Flattened registry tables: one row per file, children in ``url_0_url`` style columns."""

from __future__ import annotations

import json
import math
import re
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.operators.registry import ARRAY_NAMES, CHILDREN, Registry, with_children
from cohortspark.session import shuffles_removed, written

# Plain columns of a flattened row and the sub-columns of each child kind.
FILE_COLUMNS = (
    "guid", "filename", "size", "created_at", "updated_at", "status", "baseid", "rev", "version",
    "uploader", "access", "acl",
)
SUB_COLUMNS = {
    "url": ("url", "status", "uploader"),
    "hash": ("hash_type", "hash"),
    "alias": ("name",),
    "tag": ("field_name", "field_value"),
}
# Sub-columns a child cannot do without.
NEEDED = {"url": ("url",), "hash": ("hash_type", "hash"), "alias": ("name",), "tag": ("field_name", "field_value")}
#: Children that are gathered at once when a flattened file is written: so much shuffle lies on disk at a time.
MOVED_ROWS = 64_000_000
# Separators by file extension.
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": " "}


def separator(path: str) -> str:
    """Column separator of a file by its extension."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2]
    if "." not in path.rsplit("/", 1)[-1]:
        raise ValueError("file has no extension")
    if extension not in SEPARATORS:
        raise ValueError(f"unsupported file type: {extension}")
    return SEPARATORS[extension]


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A delimited file with a header row, texts only unless a schema is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.csv(path, sep=separator(path), header=True, inferSchema=False)


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """A flattened registry file; fields are plain texts without quoting."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote="", escape="", nullValue="")


def _groups(columns: list[str], kind: str) -> dict[int, dict[str, str]]:
    """Child positions of one kind and the column of each sub-field."""
    found: dict[int, dict[str, str]] = {}
    for column in columns:
        match = re.fullmatch(rf"{kind}_(\d+)_([a-zA-Z0-9_]+)", column)
        if match and match[2] in SUB_COLUMNS[kind]:
            found.setdefault(int(match[1]), {})[match[2]] = column
    return dict(sorted(found.items()))


def _wanted(header: list[str]) -> list[dict]:
    """One entry per child of a row: its kind, position and the places of its cells in a line, -1 for a missing one."""
    places = {name: i for i, name in reversed(list(enumerate(header)))}
    found = []
    for kind in CHILDREN:
        for position, columns in _groups(header, kind).items():
            if set(NEEDED[kind]) <= set(columns):
                cells = [places[columns[sub]] if sub in columns else -1 for sub in SUB_COLUMNS[kind]]
                found.append({"kind": kind, "position": position} | {f"c{i}": c for i, c in enumerate(cells)})
    return found


def _registry_of(lines: DataFrame, header: list[str], now: int) -> Registry:
    """Registry tables of rows whose texts are one array ``cells`` in the order of ``header``.

    The children of all kinds come out of one pass, whose expressions do not grow with their number: places of cells are
    one literal.
    """
    places = {name: i for i, name in reversed(list(enumerate(header)))}

    def text(name: str, default: str | None = "") -> Column:
        value = F.get("cells", F.lit(places[name])) if name in places else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default)) if default is not None else value

    def number(name: str, kind: str, default: int) -> Column:
        return F.coalesce(text(name, None).try_cast(kind), F.lit(default).cast(kind)).alias(name)

    acl, access = text("acl"), text("access")
    rows = lines.filter(text("guid") != "").withColumn("guid", text("guid"))
    file = rows.select(
        "guid",
        text("filename").alias("filename"),
        number("size", "long", 0),
        number("created_at", "long", now),
        number("updated_at", "long", now),
        text("status").alias("status"),
        text("baseid").alias("baseid"),
        text("rev").alias("rev"),
        number("version", "int", 1),
        text("uploader").alias("uploader"),
        F.when(access != "", access).otherwise("private").alias("access"),
        F.when(acl != "", acl).alias("acl"),
    )
    width = max(map(len, SUB_COLUMNS.values()))
    form = "array<struct<kind:string,position:int," + ",".join(f"c{i}:int" for i in range(width)) + ">>"
    wanted = F.from_json(F.lit(json.dumps(_wanted(header))), form)

    def cell(place: Column) -> Column:
        value = F.get("cells", F.coalesce(place, F.lit(-1)))
        return F.when(value != "", value)

    children = F.transform(wanted, lambda w: F.struct(
        w["kind"].alias("kind"), w["position"].alias("position"), *[cell(w[f"c{i}"]).alias(f"c{i}") for i in range(width)]))
    needed = F.lit(False)
    for kind in CHILDREN:
        whole = F.col("kind") == kind
        for sub in NEEDED[kind]:
            whole = whole & F.col(f"c{SUB_COLUMNS[kind].index(sub)}").isNotNull()
        needed = needed | whole
    stored = written(rows.select(F.col("guid").alias("file"), F.inline(children)).filter(needed), "flat-children", compression="zstd")

    def table(kind: str) -> DataFrame:
        cells = {sub: F.col(f"c{i}") for i, sub in enumerate(SUB_COLUMNS[kind])}
        if kind == "url":
            cells["status"] = F.coalesce(cells["status"], F.lit("pending"))
            cells["uploader"] = F.coalesce(cells["uploader"], F.lit(""))
            cells["created_at"] = F.lit(now).cast("long")
        return stored.filter(F.col("kind") == kind).select("file", "position", *[c.alias(sub) for sub, c in cells.items()])

    return Registry(file=file, **{kind: table(kind) for kind in CHILDREN})


def parse_flat(flat: DataFrame, now: int) -> Registry:
    """Registry tables of a flattened table of texts.

    Missing values get their defaults (status ``pending`` for links, version 1, size 0, times
    ``now``). Children without their needed values, such as blank trailing cells, are skipped. The
    ``file`` table also keeps ``access`` as written, ``private`` by default. Children are stored in the shared folder.
    """
    cells = F.array(*[flat[f"`{c}`"].cast("string") for c in flat.columns])
    return _registry_of(flat.select(cells.alias("cells")), flat.columns, now)


def read_flat_registry(spark: SparkSession, path: str, now: int) -> Registry:
    """``parse_flat`` of a file, or a folder of files with the same header, without a column per child.

    Lines are split by tabs as they are read, so the plan is the same for one child a file and for a hundred thousand.
    """
    lines = spark.read.text(path)
    first = lines.filter("_metadata.file_block_start = 0").first()
    header = first["value"] if first is not None else "\t".join(FILE_COLUMNS)
    cells = lines.filter(F.col("value") != header).select(F.split("value", "\t", -1).alias("cells"))
    return _registry_of(cells, header.split("\t"), now)


def _children_counts(registry: Registry) -> tuple[dict[str, int], int]:
    """The most children of each kind that any file has, and the number of all children: one small aggregation."""
    owners = reduce(
        DataFrame.unionByName,
        [getattr(registry, kind).select(F.lit(kind).alias("kind"), "file") for kind in CHILDREN],
    )
    sizes = owners.groupBy("kind", "file").agg(F.count(F.lit(1)).alias("n"))
    with shuffles_removed(owners.sparkSession):
        found = sizes.groupBy("kind").agg(F.max("n").alias("n"), F.sum("n").alias("total")).collect()
    return {row["kind"]: row["n"] for row in found}, sum(row["total"] for row in found)


def _gathered(registry: Registry) -> DataFrame:
    """Files with their children, without what no flattened row has."""
    return with_children(registry.file, replace(registry, url=registry.url.drop("created_at")))


def flatten(registry: Registry) -> DataFrame:
    """One row per file with children spread over numbered columns; absent ones are null.

    The number of columns per kind is the most children any file has: the format has as many columns as its largest file
    needs. ``flat_lines`` gives the same rows as lines of text, without columns. Children are numbered by their stored
    position or else their values.
    """
    most, _ = _children_counts(registry)
    names, columns = [], []
    for kind in CHILDREN:
        count = most.get(kind, 0)
        for i in range(count):
            child = F.get(F.col(ARRAY_NAMES[kind]), F.lit(i))
            names += [f"{kind}_{i}_{sub}" for sub in SUB_COLUMNS[kind]]
            columns += [child[sub].cast("string") for sub in SUB_COLUMNS[kind]]
    rows = _gathered(registry)
    return rows.select(*FILE_COLUMNS, *[c.alias(n) for n, c in zip(names, columns)])


def flat_lines(registry: Registry) -> tuple[str, DataFrame]:
    """The header line of a flattened registry and its lines as one column ``value``.

    Each kind is one array of padded cells, so expressions do not grow with the number of children. The format knows no
    quoting: tabs and line ends inside values become spaces.
    """
    return _lines(registry, _children_counts(registry)[0])


def _lines(registry: Registry, most: dict[str, int]) -> tuple[str, DataFrame]:
    """``flat_lines`` with room for ``most`` children of each kind."""
    def cell(value: Column) -> Column:
        return F.coalesce(F.translate(value.cast("string"), "\t\r\n\x01", "    "), F.lit(""))

    def child(kind: str, i: Column) -> Column:
        found = F.get(F.col(ARRAY_NAMES[kind]), i)
        return F.concat_ws("\t", *[cell(found[sub]) for sub in SUB_COLUMNS[kind]])

    header, parts = list(FILE_COLUMNS), [cell(F.col(c)) for c in FILE_COLUMNS]
    for kind in CHILDREN:
        count = most.get(kind, 0)
        header += [f"{kind}_{i}_{sub}" for i in range(count) for sub in SUB_COLUMNS[kind]]
        if count:
            places = F.sequence(F.lit(0), F.lit(count - 1))
            parts.append(F.array_join(F.transform(places, partial(child, kind)), "\t"))
    return "\t".join(header), _gathered(registry).select(F.concat_ws("\t", *parts).alias("value"))


def _share(registry: Registry, step: int, steps: int) -> Registry:
    """One of ``steps`` parts of the files, with their children."""
    def part(table: DataFrame, owner: str) -> DataFrame:
        return table.filter(F.pmod(F.xxhash64(owner), F.lit(steps)) == step)

    return Registry(file=part(registry.file, "guid"), **{kind: part(getattr(registry, kind), "file") for kind in CHILDREN})


def write_flat(registry: Registry, path: str, compression: str = "none") -> None:
    """Write ``flat_lines`` as files that each begin with the header.

    Files with many children in all are written share by share, and the shuffle of a share is gone before the next.
    """
    most, total = _children_counts(registry)
    steps = max(1, math.ceil(total / MOVED_ROWS))
    for step in range(steps):
        header, lines = _lines(registry if steps == 1 else _share(registry, step, steps), most)
        with shuffles_removed(lines.sparkSession):
            lines.select(F.col("value").alias(header)).write.mode("append" if step else "errorifexists").csv(
                path, sep="\x01", header=True, quote="", emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False, compression=compression)


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    """Registration rows from CSV or JSON, all texts; see ``registry.check_registrations``."""
    names = ("size", "filename", "uploader", "md5sum", "url", "alias")
    if path.endswith(".json"):
        rows = spark.read.schema(", ".join(f"{n} string" for n in names)).json(path, multiLine=True)
    else:
        rows = spark.read.csv(path, header=True, inferSchema=False)
    return rows.select(
        *[(F.col(n) if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in names]
    )


def read_registry(spark: SparkSession, folder: str) -> Registry:
    """The five registry tables stored as Parquet below a folder."""
    return Registry(**{name: spark.read.parquet(f"{folder}/{name}") for name in ("file", *CHILDREN)})


def write_registry(registry: Registry, folder: str, mode: str = "errorifexists") -> None:
    """Store the tables as a new version; the folder must not be one the tables are read from."""
    for name in ("file", *CHILDREN):
        getattr(registry, name).write.mode(mode).parquet(f"{folder}/{name}")
