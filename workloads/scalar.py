"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import scalars
from workloads import query
from workloads.tables import FILE_SQL, PREFIX, URL_SQL, file_table, load, registry, url_table
from cohortspark.operators import registry as reg

_TOKENS_SQL = "('NA', 'N/A', '', ' ', 'null', 'NULL', '[Not Available]', 'Na', '[Not Applicable]', '[Discrepancy]')"

_DIRTY_SQL = """dirty AS (
  SELECT p_partkey, CASE WHEN p_size < 3 THEN 'NA' WHEN p_size < 5 THEN '[Not Available]' WHEN p_size < 7 THEN ' '
         WHEN p_size < 9 THEN 'na' ELSE p_brand END AS brand FROM part)"""


@query(f"WITH {_DIRTY_SQL} SELECT p_partkey, CASE WHEN brand NOT IN {_TOKENS_SQL} THEN brand END AS brand FROM dirty")
def missing_to_null(spark, sf_dir):
    size = F.col("p_size")
    dirty = (
        F.when(size < 3, "NA").when(size < 5, "[Not Available]").when(size < 7, " ").when(size < 9, "na").otherwise(F.col("p_brand"))
    )
    return load(spark, sf_dir, "part").select("p_partkey", scalars.missing_to_null(dirty).alias("brand"))


_DIGEST_SQL = """d AS (
  SELECT doc_id, CASE length(text) % 6 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text)
         WHEN 3 THEN substr(md5(text), 1, 8) WHEN 4 THEN md5(text) || '-3' ELSE substr(md5(text), 1, 16) END AS digest
  FROM documents)"""


@query(f"""WITH {_DIGEST_SQL}
SELECT doc_id, digest, CASE
  WHEN regexp_full_match(digest, '[0-9a-f]{{32}}') THEN 'md5' WHEN regexp_full_match(digest, '[0-9a-f]{{40}}') THEN 'sha1'
  WHEN regexp_full_match(digest, '[0-9a-f]{{64}}') THEN 'sha256' WHEN regexp_full_match(digest, '[0-9a-f]{{128}}') THEN 'sha512'
  WHEN regexp_full_match(digest, '[0-9a-f]{{8}}') THEN 'crc32' WHEN regexp_full_match(digest, '[0-9a-f]{{32}}(-\\d+)?') THEN 'etag'
  WHEN regexp_full_match(digest, '[0-9a-f]{{16}}') THEN 'crc64' END AS kind FROM d""")
def hash_type(spark, sf_dir):
    text = F.col("text").cast("binary")
    md5, n = F.md5(text), F.length("text") % 6
    digest = (
        F.when(n == 0, md5).when(n == 1, F.sha1(text)).when(n == 2, F.sha2(text, 256))
        .when(n == 3, F.substring(md5, 1, 8)).when(n == 4, F.concat(md5, F.lit("-3"))).otherwise(F.substring(md5, 1, 16))
    )
    rows = load(spark, sf_dir, "documents").select("doc_id", digest.alias("digest"))
    return rows.withColumn("kind", scalars.hash_type(F.col("digest")))


@query(f"""WITH {URL_SQL}, all_urls AS (SELECT url FROM url UNION ALL SELECT url FROM pages)
SELECT url, CASE
  WHEN regexp_full_match(url, 'node://([a-zA-Z0-9@\\-_.]+)/(OEP[0-9]+)/(OEX[0-9]+)/(OES[0-9]+)/(OER[0-9]+)/(OED[0-9]+)') THEN 'node'
  WHEN regexp_matches(url, '^(oss|s3|minio)://([a-zA-Z0-9@\\-_.]+)/') THEN split_part(url, ':', 1)
  WHEN regexp_full_match(url, 'gsa://([a-zA-Z0-9@\\-_.]+)/(HRA[0-9]+)/(HRS[0-9]+)/(HRX[0-9]+)/(HRR[0-9]+)/(HRR[0-9]+.*)') THEN 'gsa'
  END AS protocol FROM all_urls""")
def url_protocol(spark, sf_dir):
    urls = url_table(spark, sf_dir).select("url").unionByName(load(spark, sf_dir, "pages").select("url"))
    return urls.withColumn("protocol", scalars.url_protocol(F.col("url")))


@query(f"""WITH {URL_SQL}, all_urls AS (SELECT url FROM url UNION ALL SELECT url FROM pages)
SELECT url, CASE WHEN split_part(url, '/', 1) IN ('node:', 'gsa:') THEN split_part(url, '/', 4)
                 WHEN split_part(url, '/', 1) IN ('s3:', 'oss:', 'minio:') THEN split_part(url, '/', 3) ELSE '' END AS identity
FROM all_urls""")
def url_identity(spark, sf_dir):
    urls = url_table(spark, sf_dir).select("url").unionByName(load(spark, sf_dir, "pages").select("url"))
    return urls.withColumn("identity", scalars.url_identity(F.col("url")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS from_text,
       CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS from_flag, CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS from_number
FROM lineitem""")
def event_code(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").withColumns({
        "text": F.when(F.col("l_returnflag") == "R", "1:DECEASED").otherwise("0:LIVING"),
        "flag": F.col("l_linestatus") == "F",
    })

    def code(column):
        return scalars.event_code(F.col(column), rows.schema[column].dataType)

    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", code("text").alias("from_text"), code("flag").alias("from_flag"),
        code("l_linenumber").alias("from_number"),
    )


@query(f"""WITH {FILE_SQL} SELECT guid, split_part(guid, '/', 1) AS prefix, split_part(guid, '/', 2) AS id,
       'other.reg/' || split_part(guid, '/', 2) AS moved FROM file""")
def guid_parts(spark, sf_dir):
    guid = F.col("guid")
    return file_table(spark, sf_dir).select(
        "guid", scalars.guid_prefix(guid).alias("prefix"), scalars.guid_uuid(guid).alias("id"),
        scalars.make_guid("other.reg", scalars.guid_uuid(guid)).alias("moved"),
    )


def _uuid5_sql(name: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name}))"
    digit = f"substr('89ab89ab89ab89ab', ('0x' || substr({h}, 17, 1))::INT + 1, 1)"
    return f"""substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {digit}
      || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"""


@query(f"""SELECT doc_id, '{PREFIX}/' || {_uuid5_sql('sha1(text)')} AS guid, {_uuid5_sql('md5(text)')} AS baseid
FROM documents""")
def deterministic_guid(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "documents").select(
        "doc_id", scalars.content_guid(text, PREFIX).alias("guid"), scalars.content_baseid(text).alias("baseid")
    )


@query("SELECT page_id, md5(html) AS md5, sha1(html) AS sha1, sha256(html) AS sha256, 128::INT AS sha512_digits FROM pages")
def fingerprint(spark, sf_dir):
    rows = load(spark, sf_dir, "pages").select("page_id", scalars.fingerprints(F.col("html")).alias("f"))
    return rows.select("page_id", "f.md5", "f.sha1", "f.sha256", F.length("f.sha512").alias("sha512_digits"))


@query("""SELECT o_orderkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR
       ELSE regexp_replace(printf('%.2f', v), '\\.?0+$', '') END AS shown
FROM (SELECT o_orderkey, o_totalprice / 3 AS v FROM orders)""")
def number_display(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", scalars.display_number(F.col("o_totalprice") / 3).alias("shown"))


@query(f"WITH {FILE_SQL} SELECT guid, md5('file-' || split_part(guid, '/', 2)) AS md5 FROM file")
def md5_of_file(spark, sf_dir):
    tables = registry(spark, sf_dir)
    rows = reg.with_children(tables.file, tables, ["hash"])
    return rows.select("guid", F.array_join(scalars.hash_of_kind(F.col("hashes"), "md5"), ",").alias("md5"))


@query(f"""WITH {FILE_SQL}, {URL_SQL}
SELECT guid, (SELECT min_by(url, id) FROM url WHERE file = guid AND NOT starts_with(url, 'node')) AS url FROM file""")
def preferred_url(spark, sf_dir):
    tables = registry(spark, sf_dir)
    rows = reg.with_children(tables.file, tables, ["url"])
    return rows.select("guid", scalars.preferred_url(F.col("urls"))["url"].alias("url"))


@query("""SELECT event_id, (props::JSON ->> '$.k')::INT AS k, event_type = '' AS typed FROM events""")
def json_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    parsed, plain = scalars.json_text(F.col("props")), scalars.json_text(F.col("event_type"))
    return rows.select("event_id", F.try_variant_get(parsed, "$.k", "int").alias("k"), plain.isNotNull().alias("typed"))


@query("""SELECT c_custkey, CASE WHEN t IN ('True', 'true', '1') THEN true WHEN t IN ('False', 'false', '0') THEN false END AS flag
FROM (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN 'yes' END AS t
      FROM customer)""")
def boolean_value(spark, sf_dir):
    n = F.col("c_nationkey") % 5
    text = F.when(n == 0, "True").when(n == 1, "false").when(n == 2, "1").when(n == 3, "yes")
    return load(spark, sf_dir, "customer").select("c_custkey", scalars.boolean_value(text).alias("flag"))


@query("""SELECT DISTINCT l_shipdate, 'v' || strftime(l_shipdate, '%Y%m%d') AS label FROM lineitem""")
def day_label(spark, sf_dir):
    millis = F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 86400000 + 3600000
    return load(spark, sf_dir, "lineitem").select("l_shipdate", scalars.epoch_day_label(millis).alias("label")).distinct()
