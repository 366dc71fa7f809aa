"""The file registry: search, children, statistics, access, links, batch changes."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohortspark.functions import scalars
from cohortspark.operators import registry as reg
from cohortspark.operators.validation import accepted, check_rows, rejected
from cohortspark.session import scratch_path, written
from cohortspark.sources import registry_store, registry_tsv
from workloads import query
from workloads.tables import (
    ALIAS_SQL,
    FILE_SQL,
    HASH_SQL,
    PREFIX,
    TAG_SQL,
    URL_SQL,
    file_table,
    hash_table,
    load,
    registry,
    stored_registry,
    tag_table,
    url_table,
)

_ALL = ", ".join([FILE_SQL, URL_SQL, HASH_SQL, ALIAS_SQL, TAG_SQL])


@query(f"""WITH {FILE_SQL}
SELECT guid, filename, size, baseid, version FROM file
WHERE status = 'validated' AND uploader = '2-HIGH' AND filename ILIKE '%_1%F.dat%'""")
def registry_search(spark, sf_dir):
    found = reg.search(registry(spark, sf_dir), status="validated", uploader="2-HIGH", filename="_1%F.dat")
    return found.select("guid", "filename", "size", "baseid", "version")


@query(f"""WITH {_ALL}
SELECT guid, filename FROM file f
WHERE EXISTS (SELECT 1 FROM tag t WHERE t.file = f.guid AND t.field_name = 'priority' AND t.field_value = '1-URGENT')
  AND EXISTS (SELECT 1 FROM hash h WHERE h.file = f.guid AND h.hash = md5('file-42'))
UNION ALL
SELECT guid, filename FROM file f WHERE EXISTS (SELECT 1 FROM alias a WHERE a.file = f.guid AND a.name = 'doi://10.1234/77')
UNION ALL
SELECT guid, filename FROM file f
WHERE EXISTS (SELECT 1 FROM tag t WHERE t.file = f.guid AND t.field_name = 'customer' AND t.field_value = 'cust-3')""")
def child_exists(spark, sf_dir):
    import hashlib

    tables = registry(spark, sf_dir)
    both = reg.search(
        tables, hash=hashlib.md5(b"file-42").hexdigest(), field_name="priority", field_value="1-URGENT"
    )
    named = reg.search(tables, alias="doi://10.1234/77")
    tagged = reg.search(tables, field_name="customer", field_value="cust-3")
    return both.unionByName(named).unionByName(tagged).select("guid", "filename")


_CHILDREN = """
  SELECT f.guid, CASE WHEN acl IS NULL THEN 'public' ELSE 'private' END AS access,
         (SELECT string_agg(u.id || '=' || u.url || '=' || u.status, ';' ORDER BY u.id) FROM url u WHERE u.file = f.guid) AS urls,
         (SELECT string_agg(h.hash_type || '=' || h.hash, ';' ORDER BY h.id) FROM hash h WHERE h.file = f.guid) AS hashes,
         (SELECT string_agg(a.name, ';' ORDER BY a.id) FROM alias a WHERE a.file = f.guid) AS aliases,
         (SELECT string_agg(t.field_name || '=' || t.field_value, ';' ORDER BY t.id) FROM tag t WHERE t.file = f.guid) AS tags"""


def _texts(rows):
    def joined(column, *fields):
        text = F.array_join(F.transform(column, lambda c: F.concat_ws("=", *[c[f].cast("string") for f in fields])), ";")
        return F.when(F.col(column).isNotNull(), text).alias(column)

    return rows.select(
        "guid", "access", joined("urls", "id", "url", "status"), joined("hashes", "hash_type", "hash"),
        joined("aliases", "name"), joined("tags", "field_name", "field_value"),
    )


@query(f"WITH {_ALL} {_CHILDREN} FROM file f")
def file_children(spark, sf_dir):
    tables = stored_registry(spark, sf_dir).read(1)
    return _texts(reg.with_children(tables.file, tables))


@query(f"""WITH {URL_SQL}, grown AS (
  SELECT id, url, status, CASE WHEN id % 3 = 0 THEN '{PREFIX}/1' ELSE file END AS file FROM url)
SELECT file AS guid, count(*)::BIGINT AS links, string_agg(url, ';' ORDER BY id) AS urls FROM grown
WHERE file IN (SELECT '{PREFIX}/' || o_orderkey FROM orders) GROUP BY file""")
def file_children_hot(spark, sf_dir):
    """One file owns a third of all links and is still one row."""
    tables = registry(spark, sf_dir)
    grown = tables.url.withColumn("file", F.when(F.col("id") % 3 == 0, f"{PREFIX}/1").otherwise(F.col("file")))
    rows = reg.with_children(tables.file, reg.replace(tables, url=grown), ["url"]).filter(F.col("urls").isNotNull())
    return rows.select(
        "guid", F.size("urls").cast("long").alias("links"), F.array_join(F.transform("urls", lambda c: c["url"]), ";").alias("urls"))


@query(f"""WITH {_ALL}, c AS (
  SELECT file, 'url' AS kind, url AS value FROM url UNION ALL SELECT file, 'hash', hash FROM hash
  UNION ALL SELECT file, 'alias', name FROM alias UNION ALL SELECT file, 'tag', field_value FROM tag)
SELECT file AS guid, kind, value FROM c""")
def file_children_large_files(spark, sf_dir):
    """Children as rows, for files of any size."""
    value = F.coalesce("url.url", "hash.hash", "alias.name", "tag.field_value")
    return reg.long_children(registry(spark, sf_dir)).select("guid", "kind", value.alias("value"))


@query(f"""WITH {_ALL}, page AS (
  SELECT * FROM file WHERE status = 'pending' ORDER BY guid LIMIT 20 OFFSET 40) {_CHILDREN} FROM page f""")
def registry_page(spark, sf_dir):
    return _texts(reg.search_page(registry(spark, sf_dir), 3, 20, status="pending"))


@query(f"""WITH {FILE_SQL}, {HASH_SQL}, wanted AS (SELECT md5('file-' || c_custkey * 5) AS hash FROM customer)
SELECT h.hash, f.guid, f.filename FROM hash h JOIN file f ON h.file = f.guid
WHERE h.hash IN (SELECT hash FROM wanted)""")
def file_by_hash(spark, sf_dir):
    text = F.concat(F.lit("file-"), (F.col("c_custkey") * 5).cast("string"))
    wanted = load(spark, sf_dir, "customer").select(F.md5(text.cast("binary")).alias("hash"))
    return reg.by_hash(registry(spark, sf_dir), wanted).select("hash", "guid", "filename")


@query(f"""WITH {FILE_SQL}
SELECT coalesce(sum(size), 0)::BIGINT AS total_size, count(guid)::BIGINT AS num_of_files,
       count(DISTINCT baseid)::BIGINT AS num_of_baseid,
       coalesce('v' || strftime(DATE '1970-01-01' + (max(updated_at) // 86400000)::INT, '%Y%m%d'), '') AS version
FROM file""")
def file_statistics(spark, sf_dir):
    return reg.statistics(file_table(spark, sf_dir))


@query(f"WITH {TAG_SQL} SELECT DISTINCT field_name FROM tag")
def tag_names(spark, sf_dir):
    return reg.tag_names(tag_table(spark, sf_dir))


@query(f"""WITH {FILE_SQL}
SELECT guid, acl FROM file WHERE acl IS NULL OR list_has_any(string_split(replace(acl, ' ', ''), ','), ['staff', 'ops'])""")
def access_filter(spark, sf_dir):
    return reg.visible_to(file_table(spark, sf_dir), ["staff", " ops"]).select("guid", "acl")


@query(f"WITH {FILE_SQL} SELECT guid, CASE WHEN acl IS NULL THEN 'public' ELSE 'private' END AS access FROM file")
def derived_access(spark, sf_dir):
    return file_table(spark, sf_dir).select("guid", scalars.access_of(F.col("acl")).alias("access"))


_REPOS_SQL = """repos AS (
  SELECT s_suppkey AS position, 'node' AS protocol, 'OEP' || s_suppkey AS identity, 'https://node.example/dl' AS download_url,
         'member-' || s_suppkey AS member_id, NULL::VARCHAR AS shared_id FROM supplier WHERE s_acctbal > 2000
  UNION ALL
  SELECT s_suppkey, 'gsa', 'HRA' || s_suppkey, 'https://gsa.example/', NULL, 'share-' || s_nationkey FROM supplier)"""


def _repos(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    supplier = load(spark, sf_dir, "supplier")
    none = F.lit(None).cast("string")
    node = supplier.filter(F.col("s_acctbal") > 2000).select(
        F.col("s_suppkey").alias("position"), F.lit("node").alias("protocol"), F.concat(F.lit("OEP"), key).alias("identity"),
        F.lit("https://node.example/dl").alias("download_url"), F.concat(F.lit("member-"), key).alias("member_id"),
        none.alias("shared_id"),
    )
    gsa = supplier.select(
        F.col("s_suppkey").alias("position"), F.lit("gsa").alias("protocol"), F.concat(F.lit("HRA"), key).alias("identity"),
        F.lit("https://gsa.example/").alias("download_url"), none.alias("member_id"),
        F.concat(F.lit("share-"), F.col("s_nationkey").cast("string")).alias("shared_id"),
    )
    return node.unionByName(gsa)


def _links(spark, sf_dir, repo, groups=None, administrator=False):
    rows = reg.download_links(
        file_table(spark, sf_dir), url_table(spark, sf_dir), _repos(spark, sf_dir), repo, groups, administrator=administrator)
    return rows.select(
        "guid", "size", "method", "baseurl",
        F.concat_ws("&", "header").alias("header"), F.concat_ws("&", "data").alias("data"), "reason",
    )


@query(f"""WITH {FILE_SQL}, {URL_SQL}, {_REPOS_SQL}, u AS (
  SELECT file, url, row_number() OVER (PARTITION BY file ORDER BY id) AS rn FROM url WHERE contains(url, 'node')),
j AS (
  SELECT f.guid, f.size, f.acl, u.url, r.download_url, r.member_id, r.identity FROM file f
  LEFT JOIN u ON u.file = f.guid AND rn = 1
  LEFT JOIN repos r ON r.protocol = 'node' AND r.identity = split_part(u.url, '/', 4)),
k AS (
  SELECT *, CASE WHEN acl IS NOT NULL AND NOT contains(acl, 'guest') THEN 'no permission'
              WHEN url IS NULL THEN 'not released on this repository'
              WHEN identity IS NULL THEN 'not released' END AS reason FROM j)
SELECT guid, size, CASE WHEN reason IS NULL THEN 'POST' END AS method,
       CASE WHEN reason IS NULL THEN download_url END AS baseurl,
       CASE WHEN reason IS NULL THEN 'Content-Type: application/x-www-form-urlencoded' ELSE '' END AS header,
       CASE WHEN reason IS NULL THEN 'dataNo=' || split_part(url, '/', -1) || '&memberId=' || member_id ELSE '' END AS data,
       reason FROM k""")
def link_resolution(spark, sf_dir):
    return _links(spark, sf_dir, "node", ["guest"])


@query(f"""WITH {FILE_SQL}, {URL_SQL}, {_REPOS_SQL}, u AS (
  SELECT file, url, row_number() OVER (PARTITION BY file ORDER BY id) AS rn FROM url WHERE contains(url, 'gsa')),
j AS (
  SELECT f.guid, f.size, u.url, r.download_url, r.shared_id, r.identity FROM file f
  LEFT JOIN u ON u.file = f.guid AND rn = 1
  LEFT JOIN repos r ON r.protocol = 'gsa' AND r.identity = split_part(u.url, '/', 4))
SELECT guid, size, CASE WHEN url IS NOT NULL THEN 'GET' END AS method,
       CASE WHEN url IS NOT NULL THEN 'https://gsa.example/' || shared_id || '/' || split_part(url, '/', 4) || '/'
            || split_part(url, '/', 7) || '/' || split_part(url, '/', 8) END AS baseurl,
       '' AS header, '' AS data,
       CASE WHEN url IS NULL THEN 'not released on this repository' END AS reason FROM j""")
def link_resolution_gsa(spark, sf_dir):
    return _links(spark, sf_dir, "gsa", administrator=True)


@query(f"""WITH {FILE_SQL}, {URL_SQL}, {HASH_SQL}, {_REPOS_SQL}, u AS (
  SELECT file, url, row_number() OVER (PARTITION BY file ORDER BY id) AS rn FROM url WHERE contains(url, 'gsa')),
h AS (SELECT file, string_agg(hash_type || ':' || hash, ';' ORDER BY hash_type || ':' || hash) AS hashes FROM hash
  WHERE hash_type = 'md5' OR hash LIKE 'a%' GROUP BY file)
SELECT f.guid, CASE WHEN f.acl IS NULL AND u.url IS NOT NULL THEN h.hashes END AS hashes,
  CASE WHEN f.acl IS NOT NULL THEN 'no permission' WHEN h.hashes IS NULL THEN 'no digest'
       WHEN u.url IS NULL THEN 'not released on this repository' END AS reason
FROM file f LEFT JOIN u ON u.file = f.guid AND rn = 1 LEFT JOIN h ON h.file = f.guid""")
def link_resolution_anonymous(spark, sf_dir):
    """A caller without groups gets public files only, with their digests."""
    hashes = hash_table(spark, sf_dir).filter((F.col("hash_type") == "md5") | F.col("hash").like("a%"))
    rows = reg.download_links(
        file_table(spark, sf_dir), url_table(spark, sf_dir), _repos(spark, sf_dir), "gsa", hashes=hashes)
    return rows.select("guid", F.when(F.col("hashes").isNotNull(), F.array_join("hashes", ";")).alias("hashes"), "reason")


@query(f"""WITH {URL_SQL}, listing AS (
  SELECT url FROM url JOIN orders ON file = '{PREFIX}/' || o_orderkey WHERE o_orderstatus <> 'P')
SELECT DISTINCT 'url' AS "column", url FROM url u
WHERE url LIKE 's3://%' AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.url = u.url)""")
def missing_objects(spark, sf_dir):
    urls, files = url_table(spark, sf_dir), file_table(spark, sf_dir)
    stored = files.filter(F.col("status") != "processing").select(F.col("guid").alias("file"))
    listing = urls.join(stored, "file", "left_semi").select("url")
    return reg.missing_objects(urls.select("url", "status", "uploader"), listing)


# ------------------------------------------------------------------ batch changes

_BATCH_SQL = """batch AS (
  SELECT CASE WHEN c_acctbal < 0 THEN 'n/a' ELSE c_custkey * 10 || '' END AS size, c_name AS filename,
         CASE WHEN c_nationkey = 4 THEN NULL ELSE c_mktsegment END AS uploader,
         CASE WHEN c_nationkey = 5 THEN 'bad' ELSE md5('file-' || c_custkey * 100) END AS md5sum,
         CASE WHEN c_nationkey = 6 THEN 'ftp://x/' ELSE 's3://new/' END || c_custkey AS url,
         'doi://10.1234/' || c_custkey * 3 AS alias
  FROM customer)"""


def _batch(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    name = F.concat(F.lit("file-"), (key * 100).cast("string"))
    return load(spark, sf_dir, "customer").select(
        F.when(F.col("c_acctbal") < 0, "n/a").otherwise((key * 10).cast("string")).alias("size"),
        F.col("c_name").alias("filename"),
        F.when(nation != 4, F.col("c_mktsegment")).alias("uploader"),
        F.when(nation == 5, "bad").otherwise(F.md5(name.cast("binary"))).alias("md5sum"),
        F.concat(F.when(nation == 6, "ftp://x/").otherwise("s3://new/"), key.cast("string")).alias("url"),
        F.concat(F.lit("doi://10.1234/"), (key * 3).cast("string")).alias("alias"),
    )


_JUDGED_SQL = f"""{_BATCH_SQL}, judged AS (
  SELECT *, CASE WHEN uploader IS NULL THEN 'uploader is missing'
                 WHEN TRY_CAST(size AS BIGINT) IS NULL THEN 'size is not a whole number'
                 WHEN NOT regexp_full_match(md5sum, '[0-9a-f]{{32}}') THEN 'invalid hash value'
                 WHEN NOT url LIKE 's3://%/%' THEN 'invalid url protocol' END AS reason FROM batch)"""


@query(f"WITH {_JUDGED_SQL} SELECT filename, size, md5sum, reason FROM judged WHERE reason IS NOT NULL")
def registration_rejects(spark, sf_dir):
    _, bad = reg.check_registrations(_batch(spark, sf_dir))
    return bad.select("filename", "size", "md5sum", "reason")


_RESENT_SQL = f"""{_JUDGED_SQL}, good AS (
  SELECT filename, size::BIGINT AS size, uploader, md5sum, url, alias FROM judged WHERE reason IS NULL
  UNION ALL SELECT 'z' || filename, size::BIGINT, uploader, md5sum, url || '/copy', alias || '/copy' FROM judged
  WHERE reason IS NULL),
owned AS (
  SELECT g.*, coalesce(h.file, 'new/' || g.md5sum) AS owner, h.file IS NULL AS fresh
  FROM good g LEFT JOIN hash h ON h.hash = g.md5sum)"""


def _resent(spark, sf_dir):
    """The batch, and every row of it once more with another file name, link and alias."""
    batch = _batch(spark, sf_dir)
    copy = batch.select(
        "size", F.concat(F.lit("z"), "filename").alias("filename"), "uploader", "md5sum",
        F.concat("url", F.lit("/copy")).alias("url"), F.concat("alias", F.lit("/copy")).alias("alias"))
    good, _ = reg.check_registrations(batch)
    copies, _ = reg.check_registrations(copy)
    return good.unionByName(copies)


@query(f"""WITH {_ALL}, {_RESENT_SQL}
SELECT 'file' AS kind, 'new/' || md5sum AS owner, min(filename) || '=' || min(size) AS value FROM owned WHERE fresh GROUP BY md5sum
UNION ALL SELECT DISTINCT 'hash', 'new/' || md5sum, md5sum || '=md5' FROM owned WHERE fresh
UNION ALL SELECT 'url', min(owner), url FROM owned WHERE url NOT IN (SELECT url FROM url) GROUP BY url
UNION ALL SELECT 'alias', min(owner), alias FROM owned WHERE alias NOT IN (SELECT name FROM alias) GROUP BY alias""")
def register_files(spark, sf_dir):
    """Everything that a registration adds, with repeated digests and new links of known ones."""
    before = registry(spark, sf_dir)
    after = reg.register(before, _resent(spark, sf_dir), PREFIX, 1_700_000_000_000)
    files = after.file.join(before.file.select("guid"), "guid", "left_anti")
    digest = after.hash.filter(F.col("id").isNull())
    owner = digest.select(F.col("file").alias("_guid"), F.concat(F.lit("new/"), "hash").alias("_owner"))
    rows = files.select(F.lit("file").alias("kind"), F.col("guid").alias("file"),
                        F.concat_ws("=", "filename", F.col("size").cast("string")).alias("value"))
    rows = rows.unionByName(digest.select(F.lit("hash").alias("kind"), "file", F.concat_ws("=", "hash", "hash_type").alias("value")))
    for kind, column in (("url", "url"), ("alias", "name")):
        added = getattr(after, kind).filter(F.col("id").isNull())
        rows = rows.unionByName(added.select(F.lit(kind).alias("kind"), "file", F.col(column).alias("value")))
    named = rows.join(owner, F.col("file") == F.col("_guid"), "left")
    return named.select("kind", F.coalesce("_owner", "file").alias("owner"), "value")


@query(f"""WITH {_ALL}, {_RESENT_SQL}, first_url AS (SELECT url, min(owner) AS o FROM owned GROUP BY url),
first_alias AS (SELECT alias, min(owner) AS o FROM owned GROUP BY alias)
SELECT filename, md5sum, concat_ws(';', CASE WHEN NOT fresh THEN 'known digest' END,
  CASE WHEN w.url IN (SELECT url FROM url) OR u.o <> owner THEN 'known link' END,
  CASE WHEN w.alias IN (SELECT name FROM alias) OR a.o <> owner THEN 'known alias' END) AS ignored
FROM owned w JOIN first_url u ON w.url = u.url JOIN first_alias a ON w.alias = a.alias""")
def registration_outcome(spark, sf_dir):
    rows = reg.registration_outcome(registry(spark, sf_dir), _resent(spark, sf_dir), PREFIX)
    return rows.select("filename", "md5sum", F.concat_ws(";", "ignored").alias("ignored"))


@query(f"""WITH {FILE_SQL}, {ALIAS_SQL}, rows AS (
  SELECT 'doi://10.1234/' || (c_custkey * 2) AS name, '{PREFIX}/' || c_custkey * 11 AS file FROM customer),
fresh AS (SELECT name, min(file) AS file FROM rows WHERE file IN (SELECT guid FROM file) GROUP BY name)
SELECT name, file FROM alias UNION ALL SELECT name, file FROM fresh WHERE name NOT IN (SELECT name FROM alias)""")
def insert_ignore(spark, sf_dir):
    tables, key = registry(spark, sf_dir), F.col("c_custkey")
    rows = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("doi://10.1234/"), (key * 2).cast("string")).alias("name"),
        F.concat(F.lit(f"{PREFIX}/"), (key * 11).cast("string")).alias("file"),
    )
    return reg.insert_ignore(tables.alias, rows, ["name"], tables.file).select("name", "file")


_URL_CHANGES_SQL = f"""changes AS (
  SELECT url, file, CASE status WHEN 'pending' THEN 'failed' ELSE 'lost' END AS status, 'new-uploader' AS uploader FROM url
  UNION ALL SELECT 's3://extra/' || c_custkey, '{PREFIX}/' || c_custkey * 20, 'processing', c_name FROM customer)"""


@query(f"""WITH {FILE_SQL}, {URL_SQL}, {_URL_CHANGES_SQL}, ok AS (
  SELECT url, file, CASE WHEN status IN ('pending', 'processing', 'validated', 'failed') THEN status ELSE 'pending' END
         AS status, uploader FROM changes WHERE file IN (SELECT guid FROM file))
SELECT coalesce(u.file, o.file) AS file, coalesce(u.url, o.url) AS url, coalesce(o.status, u.status) AS status,
       coalesce(o.uploader, u.uploader) AS uploader
FROM url u FULL JOIN ok o ON u.file = o.file AND u.url = o.url""")
def upsert_urls(spark, sf_dir):
    store, key = stored_registry(spark, sf_dir), F.col("c_custkey")
    known = url_table(spark, sf_dir).select(
        "url", "file", F.when(F.col("status") == "pending", "failed").otherwise("lost").alias("status"),
        F.lit("new-uploader").alias("uploader"))
    extra = load(spark, sf_dir, "customer").select(
        F.concat(F.lit("s3://extra/"), key.cast("string")).alias("url"),
        F.concat(F.lit(f"{PREFIX}/"), (key * 20).cast("string")).alias("file"),
        F.lit("processing").alias("status"), F.col("c_name").alias("uploader"),
    )
    version = store.apply(lambda tables: registry_store.url_rows(tables, known.unionByName(extra)), base=1)
    return store.read(version).url.select("file", "url", "status", "uploader")


@query(f"""WITH {FILE_SQL}, {TAG_SQL}, rows AS (
  SELECT '{PREFIX}/' || l_orderkey AS file, 'customer' AS field_name, 'line-' || l_linenumber AS field_value,
         l_shipdate AS changed FROM lineitem
  UNION ALL SELECT '{PREFIX}/' || (l_orderkey + 1), 'shipped', l_returnflag, l_shipdate FROM lineitem),
last AS (
  SELECT file, field_name, field_value FROM (
    SELECT *, row_number() OVER (PARTITION BY file, field_name ORDER BY changed DESC, field_value DESC) AS rn FROM rows)
  WHERE rn = 1 AND file IN (SELECT guid FROM file))
SELECT coalesce(t.file, l.file) AS file, coalesce(t.field_name, l.field_name) AS field_name,
       coalesce(l.field_value, t.field_value) AS field_value
FROM tag t FULL JOIN last l ON t.file = l.file AND t.field_name = l.field_name""")
def upsert_tags(spark, sf_dir):
    store = stored_registry(spark, sf_dir)
    lines, key = load(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    rows = lines.select(
        F.concat(F.lit(f"{PREFIX}/"), key.cast("string")).alias("file"), F.lit("customer").alias("field_name"),
        F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")).alias("field_value"), F.col("l_shipdate").alias("changed"),
    ).unionByName(
        lines.select(
            F.concat(F.lit(f"{PREFIX}/"), (key + 1).cast("string")).alias("file"), F.lit("shipped").alias("field_name"),
            F.col("l_returnflag").alias("field_value"), F.col("l_shipdate").alias("changed"),
        )
    )
    version = store.apply(lambda tables: registry_store.tag_rows(tables, rows, order="changed"), base=1)
    return store.read(version).tag.select("file", "field_name", "field_value")


def _in_rounds(spark, rows, name):
    """A folder of files, written in the order of ``round``, as a stream of small batches."""
    folder = scratch_path(spark, name)
    for number in range(3):
        rows.where(F.col("round") == number).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(folder)


def _order_guid(key):
    digest = F.md5(F.concat(F.lit("file-"), key.cast("string")).cast("binary"))
    return scalars.make_guid(PREFIX, scalars.uuid5(F.concat(F.lit(f"{PREFIX}/"), digest)))


@query("""WITH r AS (
  SELECT o_orderkey AS k, md5('file-' || o_orderkey) AS digest, 'order_' || o_orderkey AS filename, floor(o_totalprice)::BIGINT AS size,
    'doi://10.1234/' || o_orderkey AS alias, 's3://bucket/' || o_orderkey AS url FROM orders),
t AS (
  SELECT l_orderkey AS k, max(l_linenumber) AS n, l_linenumber % 3 AS round FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 3
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3 DESC) = 1)
SELECT 'file' AS kind, digest, filename || '=' || size AS value FROM r
UNION ALL SELECT 'url', digest, url || '=' || CASE WHEN k % 2 = 0 THEN 'validated' ELSE 'pending' END FROM r WHERE k % 3 > 0
UNION ALL SELECT 'alias', digest, alias FROM r
UNION ALL SELECT 'tag', digest, 'line=' || n FROM r JOIN t USING (k)""")
def registry_stream(spark, sf_dir):
    """A registry filled by streams: registrations in several batches, of which one is killed after its commit and so comes
    again, then tags of which the last round counts, a change of links and a deletion, then all of it compacted."""
    empty = spark.createDataFrame([], "x string")
    none = {kind: empty.select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")])
            for kind, columns in registry_store.COLUMNS.items()}
    store = registry_store.create(spark, scratch_path(spark, "streamed-registry"), reg.Registry(**none))
    key = F.col("o_orderkey")
    text = key.cast("string")
    orders = load(spark, sf_dir, "orders").select(
        F.floor("o_totalprice").cast("string").alias("size"), F.concat(F.lit("order_"), text).alias("filename"),
        F.lit("stream").alias("uploader"), F.md5(F.concat(F.lit("file-"), text).cast("binary")).alias("md5sum"),
        F.concat(F.lit("s3://bucket/"), text).alias("url"), F.concat(F.lit("doi://10.1234/"), text).alias("alias"),
        (key % 3).cast("int").alias("round"))
    stream, checkpoint = _in_rounds(spark, orders, "orders-stream"), scratch_path(spark, "orders-checkpoint")
    killed = []

    def register(tables, batch):
        return registry_store.registration_rows(tables, batch.drop("round"), PREFIX, 1_700_000_000_000)

    def dies_once(batch, number):
        store.apply(lambda tables: register(tables, batch), "orders", number)
        if number and not killed:
            killed.append(number)
            raise InterruptedError("killed between the commit of a batch and the stream's record of it")

    try:
        stream.writeStream.foreachBatch(dies_once).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    except StreamingQueryException:
        if not killed:
            raise
    store.follow(stream, register, "orders", checkpoint).awaitTermination()
    lines = load(spark, sf_dir, "lineitem")
    tags = lines.groupBy("l_orderkey", (F.col("l_linenumber") % 3).cast("int").alias("round")).agg(F.max("l_linenumber").alias("n"))
    tags = tags.select(_order_guid(F.col("l_orderkey")).alias("file"), F.lit("line").alias("field_name"),
                       F.col("n").cast("string").alias("field_value"), "round")
    store.follow(_in_rounds(spark, tags, "tags-stream"), lambda tables, batch: registry_store.tag_rows(tables, batch, "round"), "tags",
                 scratch_path(spark, "tags-checkpoint")).awaitTermination()
    even = load(spark, sf_dir, "orders").where(key % 2 == 0).select(
        F.concat(F.lit("s3://bucket/"), text).alias("url"), _order_guid(key).alias("file"), F.lit("validated").alias("status"))
    gone = load(spark, sf_dir, "orders").where(key % 3 == 0).select(F.concat(F.lit("s3://bucket/"), text).alias("url"), _order_guid(key).alias("file"))
    store.apply(lambda tables: registry_store.together(
        registry_store.url_rows(tables, even.withColumn("uploader", F.lit("checker"))),
        registry_store.deleted_children(tables, "url", gone)), "checks", 0)
    store.compact()
    tables = store.read()
    digest = tables.hash.select("file", F.col("hash").alias("digest"))
    file = tables.file.select(F.col("guid").alias("file"), F.lit("file").alias("kind"), F.concat_ws("=", "filename", F.col("size").cast("string")).alias("value"))
    url = tables.url.select("file", F.lit("url").alias("kind"), F.concat_ws("=", "url", "status").alias("value"))
    alias = tables.alias.select("file", F.lit("alias").alias("kind"), F.col("name").alias("value"))
    tag = tables.tag.select("file", F.lit("tag").alias("kind"), F.concat_ws("=", "field_name", "field_value").alias("value"))
    return file.unionByName(url).unionByName(alias).unionByName(tag).join(digest, "file").select("kind", "digest", "value")


@query(f"""WITH {_ALL}, gone AS (SELECT '{PREFIX}/' || c_custkey * 4 AS guid FROM customer)
SELECT kind, count(*)::BIGINT AS rows, sum(n)::BIGINT AS letters FROM (
  SELECT 'file' AS kind, guid AS file, length(filename) AS n FROM file
  UNION ALL SELECT 'url', file, length(url) FROM url UNION ALL SELECT 'hash', file, length(hash) FROM hash
  UNION ALL SELECT 'alias', file, length(name) FROM alias UNION ALL SELECT 'tag', file, length(field_value) FROM tag)
WHERE file NOT IN (SELECT guid FROM gone) GROUP BY kind""")
def delete_files(spark, sf_dir):
    gone = load(spark, sf_dir, "customer").select(
        F.concat(F.lit(f"{PREFIX}/"), (F.col("c_custkey") * 4).cast("string")).alias("guid")
    )
    left = reg.delete_files(registry(spark, sf_dir), gone)
    sides = [
        getattr(left, kind).select(F.lit(kind).alias("kind"), F.length(column).alias("n"))
        for kind, column in (("file", "filename"), ("url", "url"), ("hash", "hash"), ("alias", "name"), ("tag", "field_value"))
    ]
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.unionByName(side)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("letters"))


@query(f"""WITH {TAG_SQL}
SELECT file, field_name, field_value FROM tag t
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE '{PREFIX}/' || c_custkey * 3 = t.file AND field_name = 'priority')""")
def delete_children(spark, sf_dir):
    keys = load(spark, sf_dir, "customer").select(
        F.concat(F.lit(f"{PREFIX}/"), (F.col("c_custkey") * 3).cast("string")).alias("file"),
        F.lit("priority").alias("field_name"),
    )
    return reg.delete_children(tag_table(spark, sf_dir), keys).select("file", "field_name", "field_value")


@query("""SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def uniqueness(spark, sf_dir):
    return reg.duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {FILE_SQL}, {URL_SQL}, {HASH_SQL}, k AS (
  SELECT 'tag.field_name+file' AS rule, 'flag ' || file AS key FROM url
  UNION ALL SELECT 'alias.name', uploader FROM url UNION ALL SELECT 'url.url', url FROM url
  UNION ALL SELECT 'hash.hash', hash FROM hash UNION ALL SELECT 'file.guid', guid FROM file)
SELECT rule, key, count(*)::BIGINT AS count FROM k GROUP BY 1, 2 HAVING count(*) > 1""")
def registry_uniqueness(spark, sf_dir):
    """A registry with aliases and tags made from links, so that those rules break."""
    urls = url_table(spark, sf_dir)
    return reg.unique_violations(reg.Registry(
        file=file_table(spark, sf_dir), url=urls, hash=hash_table(spark, sf_dir),
        alias=urls.select(F.col("uploader").alias("name"), "file"),
        tag=urls.select(F.lit("flag").alias("field_name"), F.col("status").alias("field_value"), "file"),
    ))


_EVENT_RULES_SQL = """r AS (
  SELECT event_id, concat_ws(';', CASE WHEN NOT value > 1 THEN 'value too small' END,
         CASE WHEN event_type = 'error' THEN 'unknown type' END,
         CASE WHEN NOT regexp_full_match(props, '\\{"k": [0-9]{2}\\}') THEN 'bad props' END) AS reasons FROM events)"""


def _checked_events(spark, sf_dir):
    return check_rows(load(spark, sf_dir, "events"), {
        "value too small": F.col("value") > 1,
        "unknown type": F.col("event_type") != "error",
        "bad props": F.col("props").rlike(r'^\{"k": [0-9]{2}\}$'),
    })


@query(f"WITH {_EVENT_RULES_SQL} SELECT event_id, reasons FROM r WHERE reasons <> ''")
def row_validation(spark, sf_dir):
    return rejected(_checked_events(spark, sf_dir)).select("event_id", F.concat_ws(";", "reasons").alias("reasons"))


@query(f"WITH {_EVENT_RULES_SQL} SELECT event_id FROM r WHERE reasons = ''")
def row_validation_accepted(spark, sf_dir):
    return accepted(_checked_events(spark, sf_dir)).select("event_id")


# ------------------------------------------------------------------ flattened form

_FLAT_SQL = f"""{_ALL}, n AS (
  SELECT file, url, status, row_number() OVER (PARTITION BY file ORDER BY id, url) - 1 AS i FROM url)"""


@query(f"""WITH {_FLAT_SQL}
SELECT guid, filename, acl, (SELECT url FROM n WHERE file = guid AND i = 0) AS url_0_url,
       (SELECT status FROM n WHERE file = guid AND i = 2) AS url_2_status, md5('file-' || split_part(guid, '/', 2)) AS hash_0_hash,
       'sha256' AS hash_1_hash_type, (SELECT name FROM alias WHERE file = guid) AS alias_0_name,
       (SELECT field_value FROM tag WHERE file = guid AND field_name = 'priority') AS tag_0_field_value,
       'customer' AS tag_1_field_name
FROM file""")
def registry_flatten(spark, sf_dir):
    flat = registry_tsv.flatten(stored_registry(spark, sf_dir).read(1))
    return flat.select(
        "guid", "filename", "acl", "url_0_url", "url_2_status", "hash_0_hash", "hash_1_hash_type", "alias_0_name",
        "tag_0_field_value", "tag_1_field_name",
    )


@query(f"""WITH {_FLAT_SQL}
SELECT file, 'url' AS kind, url || '=' || status AS value FROM url
UNION ALL SELECT file, 'hash', hash_type || '=' || hash FROM hash
UNION ALL SELECT file, 'alias', name FROM alias UNION ALL SELECT file, 'tag', field_name || '=' || field_value FROM tag
UNION ALL SELECT guid, 'file', size || '=' || updated_at || '=' || version FROM file""")
def registry_unflatten(spark, sf_dir):
    """A flattened file, written and parsed back into registry tables."""
    path = scratch_path(spark, "flat-registry")
    registry_tsv.write_flat(registry(spark, sf_dir), path, compression="gzip")
    tables = registry_tsv.read_flat_registry(spark, path, 0)
    rows = tables.file.select(
        F.col("guid").alias("file"), F.lit("file").alias("kind"),
        F.concat_ws("=", F.col("size").cast("string"), F.col("updated_at").cast("string"), F.col("version").cast("string")).alias("value"),
    )
    for kind, columns in (("url", ["url", "status"]), ("hash", ["hash_type", "hash"]), ("alias", ["name"]), ("tag", ["field_name", "field_value"])):
        rows = rows.unionByName(
            getattr(tables, kind).select("file", F.lit(kind).alias("kind"), F.concat_ws("=", *columns).alias("value"))
        )
    return rows
