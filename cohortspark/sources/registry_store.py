"""A file registry that changes: five tables bucketed by file, and a list of commits that says what belongs to them.

Every table is a Parquet table bucketed by the file it belongs to, so files meet their children, and changes meet the rows
they change, bucket by bucket: no join or aggregation by file moves a table. A change writes only what it changes, as
new files below ``<kind>/commit=<token>``; reading takes the newest row of every key. Afterwards one small file
``_commits/<version>.json`` is published. It names the tokens of all five tables, so a reader sees one version of all of
them, and files of an attempt that was killed belong to none. It also holds the number of the last batch of every stream:
a batch that comes again changes nothing. Two writers cannot publish the same version; the later one gets
``CommitConflict`` and may try again.

``compact`` rewrites what was read as one commit, bucket by bucket, when reading has many commits to merge. Old files stay
until somebody removes them, so readers of older versions are not disturbed.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.operators import registry as reg
from cohortspark.operators.registry import CHILDREN, Registry
from cohortspark.session import shuffles_removed

KINDS = ("file", *CHILDREN)
#: Buckets of a new store, at least: as many tasks can work on a table, and so many files a commit writes per table at most.
BUCKETS = 16
#: Rows of all tables that one bucket of a new store has on average, at most: a task holds them to gather children.
BUCKET_ROWS = 1_000_000
#: Rows of a table that are moved to their buckets at once when a store is made: so much shuffle lies on disk at a time.
MOVED_ROWS = 64_000_000

# Columns of the registry tables, the column they are bucketed by, and what names a row.
COLUMNS = {
    "file": "guid string, filename string, size long, created_at long, updated_at long, status string, baseid string, "
            "rev string, version int, uploader string, acl string",
    "url": "id long, url string, created_at long, status string, uploader string, file string",
    "hash": "id long, hash string, hash_type string, file string",
    "alias": "id long, name string, file string",
    "tag": "id long, field_name string, field_value string, file string",
}
OWNER = {"file": "guid", "url": "file", "hash": "file", "alias": "file", "tag": "file"}
KEYS = {"file": ["guid"], "url": ["file", "url"], "hash": ["file", "hash"], "alias": ["file", "name"], "tag": ["file", "field_name"]}
# Columns that an update may set while the others keep their old value.
UPDATED = {"url": ["status", "uploader"], "tag": ["field_value"]}

#: Tables of one kind in one commit, at most; they are numbered inside it.
_PLACES = 1024
_OWN = "_seq long, _whole boolean, _gone boolean"


def _names(kind: str) -> list[str]:
    return [c.split()[0] for c in COLUMNS[kind].split(", ")]


class CommitConflict(RuntimeError):
    """Another writer has published this version."""


@dataclass(frozen=True)
class State:
    """What a version consists of: tokens of every table, oldest first, and the last batch of every stream."""

    version: int = 0
    buckets: int = BUCKETS
    tokens: Mapping[str, list[str]] = field(default_factory=dict)
    batches: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    # ---------------------------------------------------------------- commits

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def state(self, version: int | None = None) -> State:
        """The newest version, or the one asked for."""
        folder, system = self._files()
        if version is None:
            found = system.listStatus(folder) if system.exists(folder) else []
            names = [f.getPath().getName() for f in found]
            version = max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)
        if not version:
            return State()
        text = self.spark.read.text(f"{self.root}/_commits/{version:020d}.json", wholetext=True).first()
        return State(**json.loads(text["value"]))

    def _publish(self, state: State) -> None:
        """Make a version visible: the file is written under another name and renamed, which fails if it is there."""
        jvm = self.spark.sparkContext._jvm
        folder, system = self._files()
        system.mkdirs(folder)
        draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
        target = jvm.org.apache.hadoop.fs.Path(folder, f"{state.version:020d}.json")
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kinds = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.NONE
        try:
            files.rename(draft, target, options)
        except Exception as error:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {state.version} of {self.root} is taken") from error
            raise

    # ---------------------------------------------------------------- tables

    def _table(self, kind: str, state: State) -> str:
        """The name of a table in the catalogue of this session, with the files of all commits of ``state``."""
        name = f"registry_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_{kind}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS[kind]}, {_OWN}, commit string) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (commit) "
                f"CLUSTERED BY ({OWNER[kind]}) INTO {state.buckets} BUCKETS LOCATION '{self.root}/{kind}'")
        missing = set(state.tokens.get(kind, [])) - {r[0].split("=", 1)[1] for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}
        if missing:
            parts = " ".join(f"PARTITION (commit = '{token}')" for token in sorted(missing))
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        return name

    def _rows(self, kind: str, state: State) -> DataFrame:
        rows = self.spark.table(self._table(kind, state))
        return rows.where(F.col("commit").isin(*state.tokens.get(kind, [])) if state.tokens.get(kind) else F.lit(False))

    def read(self, version: int | None = None) -> Registry:
        """The five tables of one version. Rows of one commit alone need no merging."""
        state = self.state(version)
        return Registry(**{kind: self._merged(kind, state) for kind in KINDS})

    def _merged(self, kind: str, state: State) -> DataFrame:
        rows, names, keys = self._rows(kind, state), _names(kind), KEYS[kind]
        if len(state.tokens.get(kind, [])) <= 1:
            return rows.where("NOT _gone").select(*names)
        fixed = [c for c in names if c not in keys and c not in UPDATED.get(kind, [])]
        updated = UPDATED.get(kind, [])
        newest = rows.groupBy(*keys).agg(
            F.max_by(F.struct("_gone", *updated), "_seq").alias("_new"),
            F.max(F.when(F.col("_gone"), F.col("_seq"))).alias("_gone_at"),
            F.max(F.when(F.col("_whole"), F.col("_seq"))).alias("_whole_at"),
            F.max_by(F.struct(F.lit(1), *fixed), F.when(F.col("_whole"), F.col("_seq"))).alias("_old"))
        kept = F.col("_gone_at").isNull() | (F.col("_whole_at") > F.col("_gone_at"))
        column = lambda c: (
            F.col(c) if c in keys else F.col(f"_new.{c}") if c in updated else F.when(kept, F.col(f"_old.{c}")))
        return newest.where("NOT _new._gone").select(*[column(c).alias(c) for c in names])

    # ---------------------------------------------------------------- changes

    def _write(self, kind: str, rows: DataFrame, state: State, token: str, seq: int, whole: bool, moved: bool = True,
               steps: int = 1) -> None:
        """Write rows of one commit; with ``steps`` in so many shares of the buckets, one after the other."""
        names = _names(kind)
        rows = rows.select(
            *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (n.split() for n in COLUMNS[kind].split(", "))],
            F.lit(seq).cast("long").alias("_seq"), F.lit(whole).alias("_whole"),
            (F.col("_gone") if "_gone" in rows.columns else F.lit(False)).alias("_gone"), F.lit(token).alias("commit"))
        rows = rows.select(*names, "_seq", "_whole", "_gone", "commit")
        bucket = F.pmod(F.hash(OWNER[kind]), F.lit(state.buckets))
        for step in range(steps):
            share = rows if steps == 1 else rows.filter(F.floor(bucket * steps / state.buckets) == step)
            share = share.repartition(state.buckets, OWNER[kind]) if moved else share
            with shuffles_removed(share.sparkSession):
                share.write.mode("append").format("parquet").partitionBy("commit").bucketBy(
                    state.buckets, OWNER[kind]).saveAsTable(self._table(kind, state))

    def commit(self, changes: Mapping[str, list[tuple[DataFrame, bool]]], stream: str | None = None, number: int = 0,
               base: int | None = None) -> int:
        """Publish changed rows as the next version and return it; 0 if ``stream`` has this batch already.

        ``changes`` has, per kind, tables of rows and whether they carry all columns. Rows that do not set only the columns
        of ``UPDATED``; a column ``_gone`` marks rows that leave. Of rows of one key in one commit the later table counts.
        The next version goes on from the newest one, or from ``base``, as after a mistake.
        """
        newest = self.state()
        before = newest if base is None else self.state(base)
        if stream is not None and before.batches.get(stream, -1) >= number:
            return 0
        version = newest.version + 1
        tokens = {kind: list(before.tokens.get(kind, [])) for kind in KINDS}
        for kind, tables in changes.items():
            for place, (rows, whole) in enumerate(tables):
                token = uuid.uuid4().hex
                self._write(kind, rows, before, token, version * _PLACES + place, whole)
                tokens[kind].append(token)
        batches = dict(before.batches) if stream is None else {**before.batches, stream: number}
        self._publish(State(version, before.buckets, tokens, batches))
        return version

    def compact(self) -> None:
        """Rewrite the newest version as one commit; tables stay in their buckets, so nothing is shuffled."""
        before = self.state()
        tokens = {}
        for kind in KINDS:
            tokens[kind] = [uuid.uuid4().hex]
            self._write(kind, self._merged(kind, before), before, tokens[kind][0], (before.version + 1) * _PLACES, True, moved=False)
        self._publish(State(before.version + 1, before.buckets, tokens, before.batches))

    # ---------------------------------------------------------------- batches

    def apply(self, change: Callable[[Registry], Mapping[str, list[tuple[DataFrame, bool]]]], stream: str | None = None,
              number: int = 0, base: int | None = None) -> int:
        """``commit`` what ``change`` makes of the version; a batch that is there already is not computed."""
        if stream is not None and self.state(base).batches.get(stream, -1) >= number:
            return 0
        return self.commit(change(self.read(base)), stream, number, base)

    def follow(self, rows: DataFrame, change: Callable[[Registry, DataFrame], Mapping], stream: str, checkpoint: str):
        """Start a query that applies every micro-batch of the streaming table ``rows``, until its input ends.

        ``checkpoint`` keeps where the stream is. A query that dies between the commit of a batch and its own record of it
        gets that batch again under its old number, and the store leaves it out.
        """
        def batch(found: DataFrame, number: int) -> None:
            self.apply(lambda tables: change(tables, found), stream, number)

        return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def create(spark: SparkSession, root: str, registry: Registry, buckets: int | None = None) -> Store:
    """A new store with the rows of ``registry`` as its first version, by default with buckets for its number of rows."""
    store = Store(spark, root.rstrip("/"))
    if store.state().version:
        raise ValueError(f"{root} holds a registry")
    sizes = {kind: getattr(registry, kind).count() for kind in KINDS}
    buckets = buckets or max(BUCKETS, math.ceil(sum(sizes.values()) / BUCKET_ROWS))
    first = State(buckets=buckets)
    tokens = {kind: [uuid.uuid4().hex] for kind in KINDS}
    for kind in KINDS:
        store._write(kind, getattr(registry, kind), first, tokens[kind][0], 0, True, steps=max(1, math.ceil(sizes[kind] / MOVED_ROWS)))
    store._publish(State(1, buckets, tokens))
    return store


# -------------------------------------------------------------------- changes as rows


def registration_rows(registry: Registry, batch: DataFrame, prefix: str, now: int) -> dict[str, list[tuple[DataFrame, bool]]]:
    """What a registration adds, see ``registry.register``."""
    return {kind: [(rows, True)] for kind, rows in reg.registrations(registry, batch, prefix, now).items()}


def url_rows(registry: Registry, rows: DataFrame, order: str | None = None) -> dict[str, list[tuple[DataFrame, bool]]]:
    """Status and uploader of links by (file, url), see ``registry.upsert_urls``."""
    return {"url": [(reg.last_of_batch(reg.with_url_status(rows), KEYS["url"], registry.file, order), False)]}


def tag_rows(registry: Registry, rows: DataFrame, order: str | None = None) -> dict[str, list[tuple[DataFrame, bool]]]:
    """Values of tags by (file, field_name), see ``registry.upsert_tags``."""
    return {"tag": [(reg.last_of_batch(rows, KEYS["tag"], registry.file, order), False)]}


def deleted_files(registry: Registry, guids: DataFrame) -> dict[str, list[tuple[DataFrame, bool]]]:
    """Files and all their children leave."""
    gone = guids.select("guid").distinct()
    out = {"file": registry.file.join(gone, "guid", "left_semi")}
    for kind in CHILDREN:
        out[kind] = getattr(registry, kind).join(gone.withColumnRenamed("guid", "file"), "file", "left_semi")
    return {kind: [(rows.withColumn("_gone", F.lit(True)), False)] for kind, rows in out.items()}


def deleted_children(registry: Registry, kind: str, keys: DataFrame) -> dict[str, list[tuple[DataFrame, bool]]]:
    """Children that match ``keys``, by whatever columns it has, leave."""
    found = getattr(registry, kind).join(keys.distinct(), keys.columns, "left_semi")
    return {kind: [(found.withColumn("_gone", F.lit(True)), False)]}


def together(*changes: Mapping[str, list[tuple[DataFrame, bool]]]) -> dict[str, list[tuple[DataFrame, bool]]]:
    """Several changes as one commit; of rows of one key the later change counts."""
    return reduce(lambda a, b: {kind: [*a.get(kind, []), *b.get(kind, [])] for kind in {**a, **b}}, changes, {})
