"""The file registry: search, children, statistics, access, links and batch changes.

A registry is five tables: ``file`` (guid, filename, size, created_at, updated_at, status, baseid,
rev, version, uploader, acl) and its children ``url`` (id, url, created_at, status, uploader, file),
``hash`` (id, hash, hash_type, file), ``alias`` (id, name, file) and ``tag`` (id, field_name,
field_value, file). Child tables point to ``file.guid``. Times are epoch milliseconds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.functions import scalars
from cohortspark.operators.paging import page as page_rows
from cohortspark.session import written

CHILDREN = ("url", "hash", "alias", "tag")
# Plural names of the child arrays.
ARRAY_NAMES = {"url": "urls", "hash": "hashes", "alias": "aliases", "tag": "tags"}
# Payload columns of each child table.
CHILD_COLUMNS = {
    "url": ("url", "status", "uploader", "created_at"),
    "hash": ("hash_type", "hash"),
    "alias": ("name",),
    "tag": ("field_name", "field_value"),
}
# Statuses a link may have; any other becomes ``pending``.
URL_STATUSES = ("pending", "processing", "validated", "failed")


@dataclass(frozen=True)
class Registry:
    file: DataFrame
    url: DataFrame
    hash: DataFrame
    alias: DataFrame
    tag: DataFrame


# ---------------------------------------------------------------- search


def search(
    registry: Registry,
    guid: str = "",
    filename: str = "",
    baseid: str = "",
    status: str = "",
    uploader: str = "",
    hash: str = "",
    alias: str = "",
    url: str = "",
    field_name: str = "",
    field_value: str = "",
) -> DataFrame:
    """Files that meet all given conditions; an empty text is no condition.

    ``filename`` matches a part of the name in any case; hash, alias, url and tag ask for a child.
    Child tables are filtered and reduced to their files, which are stored so that the semi join
    knows how few they are and leaves the file table where it is.
    """
    files = registry.file
    for column, value in {"guid": guid, "baseid": baseid, "status": status, "uploader": uploader}.items():
        if value:
            files = files.filter(F.col(column) == value)
    if filename:
        files = files.filter(F.col("filename").ilike("%" + filename.replace("\\", "\\\\") + "%"))
    wanted: list[tuple[DataFrame, Column]] = []
    if hash:
        wanted.append((registry.hash, F.col("hash") == hash))
    if alias:
        wanted.append((registry.alias, F.col("name") == alias))
    if url:
        wanted.append((registry.url, F.col("url") == url))
    if field_name and field_value:
        wanted.append((registry.tag, (F.col("field_name") == field_name) & (F.col("field_value") == field_value)))
    for table, condition in wanted:
        owners = table.filter(condition).select(F.col("file").alias("guid")).distinct()
        files = files.join(written(owners, "owners"), "guid", "left_semi")
    return files


def _may_read(groups: Sequence[str]) -> Column:
    mine = F.array(*[F.lit(g.strip()) for g in groups]).cast("array<string>")
    allowed = F.transform(F.split("acl", ","), lambda g: F.trim(g))
    return F.col("acl").isNull() | F.coalesce(F.arrays_overlap(allowed, mine), F.lit(False))


def visible_to(files: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Public files, and private ones whose access list shares a group with the user."""
    return files.filter(_may_read(groups))


# ---------------------------------------------------------------- children


def _payload(kind: str, table: DataFrame) -> Column:
    head = [c for c in ("id", "position") if c in table.columns]
    return F.struct(*head, *[c for c in CHILD_COLUMNS[kind] if c in table.columns])


def long_children(registry: Registry, kinds: Sequence[str] = CHILDREN) -> DataFrame:
    """Children as rows: guid, kind and one struct column per kind, null but for the row's own kind.

    This is the form for work on all children of files of any size.
    """
    sides = [
        getattr(registry, kind).select(
            F.col("file").alias("guid"), F.lit(kind).alias("kind"), _payload(kind, getattr(registry, kind)).alias(kind))
        for kind in kinds
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)


def with_children(files: DataFrame, registry: Registry, kinds: Sequence[str] = CHILDREN) -> DataFrame:
    """Files with their children as arrays of structs, null where a file has none of a kind.

    Every file is one row, whatever the number of its children: an array holds all children of one file, and nothing
    else. All child tables share one shuffle and one aggregation. For few files reduce the child tables first, as
    ``search_page`` does; ``long_children`` does without arrays.
    """
    out = files if "access" in files.columns else files.withColumn("access", scalars.access_of(F.col("acl")))
    if not kinds:
        return out
    arrays = long_children(registry, kinds).groupBy("guid").agg(
        *[F.sort_array(F.collect_list(kind)).alias(ARRAY_NAMES[kind]) for kind in kinds]
    )
    arrays = arrays.select(
        "guid", *[F.when(F.size(ARRAY_NAMES[k]) > 0, F.col(ARRAY_NAMES[k])).alias(ARRAY_NAMES[k]) for k in kinds]
    )
    return out.join(arrays, "guid", "left")


def search_page(
    registry: Registry,
    number: int | None = None,
    size: int | None = None,
    kinds: Sequence[str] = CHILDREN,
    **conditions: str,
) -> DataFrame:
    """One page of a search with children loaded for the files of that page only.

    The guids of the page are stored first; files and children are then reduced to them by semi joins, whose small side
    has a known size, so a page of any size needs no list of guids on the driver.
    """
    found = page_rows(search(registry, **conditions).select("guid"), [("guid", False)], number, size)
    guids = written(found, "page-guids")
    owners = guids.withColumnRenamed("guid", "file")
    near = {kind: getattr(registry, kind).join(owners, "file", "left_semi") for kind in kinds}
    files = registry.file.join(guids, "guid", "left_semi")
    return with_children(files, replace(registry, **near), kinds)


def by_hash(registry: Registry, digests: DataFrame, column: str = "hash") -> DataFrame:
    """Files of the given digests, with the digest that found them."""
    wanted = digests.select(F.col(column).alias("hash")).distinct()
    hits = registry.hash.join(wanted, "hash", "left_semi").select("hash", F.col("file").alias("guid"))
    return hits.join(registry.file, "guid", "inner")


# ---------------------------------------------------------------- statistics


def statistics(files: DataFrame) -> DataFrame:
    """Total size, file count, distinct base ids and the day of the latest change as a version."""
    return files.agg(
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"),
        F.count("guid").alias("num_of_files"),
        F.count_distinct("baseid").alias("num_of_baseid"),
        F.coalesce(scalars.epoch_day_label(F.max("updated_at")), F.lit("")).alias("version"),
    )


def tag_names(tags: DataFrame) -> DataFrame:
    return tags.select("field_name").distinct()


# ---------------------------------------------------------------- links


def _last_part(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def download_links(
    files: DataFrame,
    urls: DataFrame,
    repos: DataFrame,
    which_repo: str = "node",
    groups: Sequence[str] | None = None,
    hashes: DataFrame | None = None,
    administrator: bool = False,
) -> DataFrame:
    """Download requests for many files at once.

    ``repos`` has one row per repository entry: position, protocol, identity (project or bucket),
    download_url, member_id, shared_id. For each file the first link (lowest id) whose text holds
    the repository name is taken; the first matching entry says how to ask for it. Rows without a
    request carry a ``reason`` instead. A caller without ``groups`` is in none and gets public files only; an
    administrator gets all. With ``hashes`` the answer has the digests of a file as ``type:digest`` texts, and a file
    without any is refused.
    """
    first = (
        urls.filter(F.col("url").contains(which_repo))
        .groupBy(F.col("file").alias("guid"))
        .agg(F.min_by("url", "id").alias("url"))
    )
    # entries name their protocol; plain http has no identity, its first entry serves every link
    entry = ["position", "download_url", "member_id", "shared_id"]
    same = repos.filter(F.col("protocol") == which_repo)
    identity = F.lit("") if which_repo == "http" else F.col("identity")
    chosen = same.groupBy(identity.alias("_identity")).agg(
        F.min_by(F.struct(*entry), "position").alias("_entry")
    )
    link = F.lit("") if which_repo == "http" else scalars.url_identity(F.col("url"))
    # a file without a link has no identity, and null meets nothing, so such files are not gathered by a join key
    rows = files.join(first, "guid", "left").withColumn("_identity", F.when(F.col("url").isNotNull(), link))
    rows = rows.join(chosen, "_identity", "left")
    if hashes is not None:
        digest = F.concat_ws(":", "hash_type", "hash")
        owned = hashes.groupBy(F.col("file").alias("guid")).agg(F.sort_array(F.collect_list(digest)).alias("hashes"))
        rows = rows.join(owned, "guid", "left")

    parts = F.split("url", "/")

    def part(i: int) -> Column:
        return F.get(parts, F.lit(i))

    base = F.rtrim(F.col("_entry.download_url"), F.lit("/"))
    requests = {
        "node": (
            "POST",
            F.col("_entry.download_url"),
            F.array(F.lit("Content-Type: application/x-www-form-urlencoded")),
            F.array(
                F.concat(F.lit("dataNo="), _last_part(F.col("url"))),
                F.concat(F.lit("memberId="), F.col("_entry.member_id")),
            ),
        ),
        "gsa": (
            "GET",
            F.concat_ws("/", base, F.col("_entry.shared_id"), part(3), part(6), part(7)),
            None,
            None,
        ),
        "http": ("GET", F.col("url"), None, None),
    }
    empty = F.array().cast("array<string>")
    method, baseurl, header, data = requests.get(which_repo, (None, F.lit(None).cast("string"), None, None))
    reason = (
        F.when(F.col("url").isNull(), F.lit("not released on this repository"))
        .when(F.col("_entry").isNull(), F.lit("not released"))
        .when(F.lit(which_repo not in requests), F.lit("signing is not supported for this protocol"))
    )
    if hashes is not None:
        reason = F.when(F.col("hashes").isNull(), F.lit("no digest")).otherwise(reason)
    if not administrator:
        reason = F.when(~_may_read(groups or []), F.lit("no permission")).otherwise(reason)
    ok = reason.isNull()
    return rows.select(
        "guid",
        "filename",
        "size",
        F.when(ok, F.lit(method)).alias("method"),
        F.when(ok, baseurl).alias("baseurl"),
        F.when(ok, header if header is not None else empty).alias("header"),
        F.when(ok, data if data is not None else empty).alias("data"),
        *([F.when(ok, F.col("hashes")).alias("hashes")] if hashes is not None else []),
        reason.alias("reason"),
    )


def missing_objects(table: DataFrame, listing: DataFrame, prefixes: Sequence[str] = ("minio://", "s3://")) -> DataFrame:
    """(column, url) of object links anywhere in a table that the store listing lacks.

    One scan gives the links of all text columns, whose prefixes reach it as one pushed condition; the distinct links
    meet the listing once.
    """
    texts = [name for name, kind in table.dtypes if kind == "string"]
    if not texts:
        return table.select(F.lit("").alias("column"), F.lit("").alias("url")).limit(0)

    def starts(text: Column) -> Column:
        return reduce(lambda a, b: a | b, [text.startswith(prefix) for prefix in prefixes])

    linked = table.filter(reduce(lambda a, b: a | b, [starts(F.col(f"`{name}`")) for name in texts]))
    cells = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"`{name}`").alias("url")) for name in texts])
    found = linked.select(F.inline(F.filter(cells, lambda c: F.coalesce(starts(c["url"]), F.lit(False)))))
    found = found.select("column", F.trim("url").alias("url")).distinct()
    return found.join(listing.select("url"), "url", "left_anti").select("column", "url")


# ---------------------------------------------------------------- batch changes


def _first_of(batch: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    best = F.min_by(F.struct(*batch.columns), order)
    return batch.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_row")).select("_row.*")


def _without_known(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the table yet.

    The table is first cut down to the keys of the rows, which are mostly few enough to broadcast;
    a plain anti join would move the whole table.
    """
    known = table.select(*keys).join(rows.select(*keys), list(keys), "left_semi")
    return rows.join(known, list(keys), "left_anti")


def check_registrations(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split registration rows (size, filename, uploader, md5sum, [url, alias]) into good and bad.

    The bad ones carry their ``reason``.
    """
    for optional in ("url", "alias"):
        if optional not in batch.columns:
            batch = batch.withColumn(optional, F.lit(None).cast("string"))
    size = F.col("size").try_cast("long")
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in ("size", "filename", "uploader", "md5sum")]
    checks += [
        F.when(size.isNull() | ~F.col("size").cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.lit("size is not a whole number")),
        F.when(~scalars.is_hash(F.col("md5sum"), "md5"), F.lit("invalid hash value")),
        F.when(F.col("url").isNotNull() & scalars.url_protocol(F.col("url")).isNull(), F.lit("invalid url protocol")),
    ]
    judged = batch.withColumn("reason", F.coalesce(*checks))
    good = judged.filter(F.col("reason").isNull()).drop("reason").withColumn("size", size)
    return good, judged.filter(F.col("reason").isNotNull())


def registrations(registry: Registry, batch: DataFrame, prefix: str, now: int) -> dict[str, DataFrame]:
    """The rows that registration rows add to each table; rows failing the checks are left out.

    Of several rows with one digest the first by file name makes the file; a known digest keeps its file. Links and
    aliases of all good rows go to the file of their digest, and one that is already there or repeated is ignored, see
    ``registration_outcome``. Guids come from the digest, so a batch that runs again after a lost executor gives the same
    rows. The checked batch is stored once with the guid of every row.
    """
    rows = _with_owner(registry, batch, prefix)
    first = F.struct("filename", "size", "uploader")
    fresh = _first_of(rows.filter("fresh"), ["md5sum"], first)
    stamp = F.lit(now).cast("long")
    file = fresh.select(
        "guid",
        "filename",
        "size",
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit("pending").alias("status"),
        scalars.uuid5(F.col("md5sum")).alias("baseid"),
        F.substring(scalars.guid_uuid(F.col("guid")), 1, 8).alias("rev"),
        F.lit(1).alias("version"),
        "uploader",
        F.lit(None).cast("string").alias("acl"),
    )
    digest = fresh.select(
        F.col("md5sum").alias("hash"),
        scalars.hash_type(F.col("md5sum")).alias("hash_type"),
        F.col("guid").alias("file"),
    )
    link = rows.filter(F.col("url").isNotNull()).select(
        "url",
        stamp.alias("created_at"),
        F.lit("pending").alias("status"),
        "uploader",
        F.col("guid").alias("file"),
    )
    alias = rows.filter(F.col("alias").isNotNull()).select(F.col("alias").alias("name"), F.col("guid").alias("file"))
    return {
        "file": file,
        "hash": digest,
        "url": _fresh(registry.url, link, ["url"]),
        "alias": _fresh(registry.alias, alias, ["name"]),
    }


def register(registry: Registry, batch: DataFrame, prefix: str, now: int) -> Registry:
    """Add files, digests, links and aliases from registration rows, see ``registrations``."""
    added = registrations(registry, batch, prefix, now)
    return replace(registry, **{
        kind: getattr(registry, kind).unionByName(rows, allowMissingColumns=True) for kind, rows in added.items()})


def _with_owner(registry: Registry, batch: DataFrame, prefix: str) -> DataFrame:
    """The good rows of a batch, stored, with the guid they belong to and whether it is a new one."""
    good, _ = check_registrations(batch)
    good = written(good, "registrations")
    digests = registry.hash.select(F.col("hash").alias("md5sum"), F.col("file").alias("_known"))
    known = digests.join(good.select("md5sum"), "md5sum", "left_semi")
    known = known.groupBy("md5sum").agg(F.min("_known").alias("_known"))
    uuid = scalars.uuid5(F.concat(F.lit(f"{prefix}/"), F.col("md5sum")))
    rows = good.join(known, "md5sum", "left")
    return written(rows.select(
        *good.columns,
        F.coalesce("_known", scalars.make_guid(prefix, uuid)).alias("guid"),
        F.col("_known").isNull().alias("fresh"),
    ), "registration-owners")


def registration_outcome(registry: Registry, batch: DataFrame, prefix: str) -> DataFrame:
    """What becomes of every row of a batch: its columns, guid, and what is ignored, as a list of reasons.

    A rejected row has its reason and no guid.
    """
    _, bad = check_registrations(batch)
    rows = _with_owner(registry, batch, prefix)

    def taken(column: str, table: DataFrame, key: str) -> DataFrame:
        """Values that are stored already, and the first owner of each in the batch."""
        stored = table.select(F.col(key).alias(column)).join(rows.select(column), column, "left_semi").distinct()
        first = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min("guid").alias(f"_{column}_owner"))
        return first.join(stored.withColumn(f"_{column}_stored", F.lit(True)), column, "left")

    judged = rows.join(taken("url", registry.url, "url"), "url", "left")
    judged = judged.join(taken("alias", registry.alias, "name"), "alias", "left")

    def lost(column: str) -> Column:
        return F.col(f"_{column}_stored").isNotNull() | (F.col(f"_{column}_owner") != F.col("guid"))

    reasons = F.array_compact(F.array(
        F.when(~F.col("fresh"), F.lit("known digest")),
        F.when(lost("url"), F.lit("known link")),
        F.when(lost("alias"), F.lit("known alias")),
    ))
    columns = [c for c in bad.columns if c != "reason"]
    good = judged.select(*[F.col(c).cast("string") for c in columns], "guid", reasons.alias("ignored"))
    return good.unionByName(bad.select(
        *[F.col(c).cast("string") for c in columns], F.lit(None).cast("string").alias("guid"), F.array("reason").alias("ignored")))


def insert_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], files: DataFrame | None = None) -> DataFrame:
    """Append rows whose key is new; the first of equal keys in the batch wins.

    With ``files``, rows of unknown files are left out. New rows get no id until they are stored.
    """
    if files is not None:
        rows = _of_known_files(rows, files)
    return table.unionByName(_fresh(table, rows, keys), allowMissingColumns=True)


def _fresh(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key that is new to the table."""
    rest = sorted(c for c in rows.columns if c not in keys)
    fresh = rows.distinct()
    if rest:
        fresh = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*")
    return _without_known(fresh, table, keys).select(*rows.columns)


def last_of_batch(rows: DataFrame, keys: Sequence[str], files: DataFrame, order: str | None = None) -> DataFrame:
    """The last of the rows of each key, by ``order``, without those of unknown files."""
    rows = _of_known_files(rows, files)
    payload = [c for c in rows.columns if c not in keys and c != order]
    last = F.max(F.struct(*([order] if order else []), *sorted(payload)))
    return rows.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col(f"_row.{c}") for c in payload])


def upsert(
    table: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    files: DataFrame,
    order: str | None = None,
) -> DataFrame:
    """Update rows by key or append them; the last of equal keys in the batch wins.

    ``order`` names the batch column that tells later from earlier rows. Rows of unknown files are
    left out. Columns the batch does not have keep their old value. The table side of the join is
    its outer side: a small batch is broadcast and the table does not move.
    """
    payload = [c for c in rows.columns if c not in keys and c != order]
    # the reduced batch meets the table twice, for updates and for additions
    final = written(last_of_batch(rows, keys, files, order), "upsert-batch")
    new = final.select(
        *[F.col(k).alias(f"_n_{k}") for k in keys],
        *[F.col(c).alias(f"_n_{c}") for c in payload],
        F.lit(True).alias("_new"),
    )
    on = F.lit(True)
    for k in keys:
        on = on & (table[k] == new[f"_n_{k}"])

    def updated(name: str) -> Column:
        if name in payload:
            return F.when(F.col("_new"), F.col(f"_n_{name}")).otherwise(table[name]).alias(name)
        return table[name]

    kept = table.join(new, on, "left").select(*[updated(c) for c in table.columns])
    added = _without_known(final, table, keys).select(*keys, *payload)
    return kept.unionByName(added, allowMissingColumns=True)


def _of_known_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a batch whose file exists; the file table is first cut down to the files of the batch."""
    hits = files.select(F.col("guid").alias("file")).join(rows.select("file"), "file", "left_semi")
    return rows.join(hits, "file", "left_semi")


def of_unknown_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of a batch that name a file the registry does not have."""
    hits = files.select(F.col("guid").alias("file")).join(rows.select("file"), "file", "left_semi")
    return rows.join(hits, "file", "left_anti").select(*rows.columns)


def with_url_status(rows: DataFrame) -> DataFrame:
    """An unknown status becomes ``pending``."""
    return rows.withColumn("status", F.when(F.col("status").isin(*URL_STATUSES), F.col("status")).otherwise(F.lit("pending")))


def upsert_urls(registry: Registry, rows: DataFrame, order: str | None = None) -> Registry:
    """Set status and uploader of links by (file, url); an unknown status becomes ``pending``."""
    return replace(registry, url=upsert(registry.url, with_url_status(rows), ["file", "url"], registry.file, order))


def upsert_tags(registry: Registry, rows: DataFrame, order: str | None = None) -> Registry:
    """Set tag values by (field_name, file)."""
    return replace(registry, tag=upsert(registry.tag, rows, ["field_name", "file"], registry.file, order))


def delete_files(registry: Registry, guids: DataFrame) -> Registry:
    """Remove files together with all their children."""
    gone = guids.select("guid").distinct()
    children = {
        kind: getattr(registry, kind).join(gone.withColumnRenamed("guid", "file"), "file", "left_anti").select(
            *getattr(registry, kind).columns
        )
        for kind in CHILDREN
    }
    return Registry(file=registry.file.join(gone, "guid", "left_anti").select(*registry.file.columns), **children)


def delete_children(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove child rows by whatever columns ``keys`` has: by file, or by file and value."""
    return table.join(keys.distinct(), keys.columns, "left_anti").select(*table.columns)


def duplicates(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def unique_violations(registry: Registry) -> DataFrame:
    """Broken uniqueness rules of the registry tables: (rule, key, count)."""
    rules: Mapping[str, tuple[DataFrame, Sequence[str]]] = {
        "file.guid": (registry.file, ["guid"]),
        "url.url": (registry.url, ["url"]),
        "hash.hash": (registry.hash, ["hash"]),
        "alias.name": (registry.alias, ["name"]),
        "tag.field_name+file": (registry.tag, ["field_name", "file"]),
    }
    keyed = None
    for rule, (table, keys) in rules.items():
        rows = table.select(F.lit(rule).alias("rule"), F.concat_ws(" ", *keys).alias("key"))
        keyed = rows if keyed is None else keyed.unionByName(rows)
    return duplicates(keyed, ["rule", "key"])
