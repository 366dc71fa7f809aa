"""Inputs of the queries: the driver tables, and cohort and registry tables derived from them.

Every derived table has its SQL next to it, as a WITH part for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.operators import text_index
from cohortspark.operators.registry import Registry
from cohortspark.session import scratch_path
from cohortspark.sources import registry_store

PREFIX = "reg.demo"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str):
    return F.unix_date(F.col(column).cast("date")).cast("long") * 86400000


def _sql_millis(column: str) -> str:
    return f"(date_diff('day', DATE '1970-01-01', CAST({column} AS DATE)) * 86400000)::BIGINT"


FILE_SQL = f"""file AS (
  SELECT '{PREFIX}/' || o_orderkey AS guid,
         'order_' || o_orderkey || '_' || lower(o_orderstatus) || '.dat' AS filename,
         floor(o_totalprice)::BIGINT AS size,
         {_sql_millis('o_orderdate')} AS created_at,
         {_sql_millis('o_orderdate')} + floor(o_totalprice)::BIGINT AS updated_at,
         CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'validated' ELSE 'processing' END AS status,
         'base-' || o_custkey AS baseid,
         substr(md5('file-' || o_orderkey), 1, 8) AS rev,
         (o_orderkey % 7 + 1)::INTEGER AS version,
         o_orderpriority AS uploader,
         CASE o_orderstatus WHEN 'F' THEN 'admin, staff' WHEN 'P' THEN 'guest' END AS acl
  FROM orders)"""


def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    size = F.floor("o_totalprice").cast("long")
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit(f"{PREFIX}/"), key).alias("guid"),
        F.concat(F.lit("order_"), key, F.lit("_"), F.lower(status), F.lit(".dat")).alias("filename"),
        size.alias("size"),
        _millis("o_orderdate").alias("created_at"),
        (_millis("o_orderdate") + size).alias("updated_at"),
        F.when(status == "O", "pending").when(status == "F", "validated").otherwise("processing").alias("status"),
        F.concat(F.lit("base-"), F.col("o_custkey").cast("string")).alias("baseid"),
        F.substring(F.md5(F.concat(F.lit("file-"), key).cast("binary")), 1, 8).alias("rev"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("version"),
        F.col("o_orderpriority").alias("uploader"),
        F.when(status == "F", "admin, staff").when(status == "P", "guest").alias("acl"),
    )


# part, line number and price in cents tell the lines of an order apart
URL_ID_SQL = "((l_partkey * 10 + l_linenumber) * 100000000 + round(l_extendedprice * 100)::BIGINT)"
_CENTS_SQL = "round(l_extendedprice * 100)::BIGINT"


def url_id():
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return (F.col("l_partkey") * 10 + F.col("l_linenumber")) * 100000000 + cents


URL_SQL = f"""url AS (
  SELECT {URL_ID_SQL} AS id,
         CASE l_returnflag
           WHEN 'A' THEN 'node://lab@x.org/OEP' || l_suppkey || '/OEX' || l_partkey || '/OES' || l_linenumber
                         || '/OER' || l_orderkey || '/OED' || l_orderkey || l_linenumber || {_CENTS_SQL}
           WHEN 'N' THEN 's3://bucket-' || (l_suppkey % 5) || '/' || l_orderkey || '/' || l_partkey || '-'
                         || l_suppkey || '-' || l_linenumber || '-' || {_CENTS_SQL}
           ELSE 'gsa://lab@x.org/HRA' || l_suppkey || '/HRS' || l_partkey || '/HRX' || l_linenumber
                || '/HRR' || l_orderkey || '/HRR' || l_orderkey || '_f' || l_linenumber || '-' || {_CENTS_SQL} || '.gz'
         END AS url,
         {_sql_millis('l_shipdate')} AS created_at,
         CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'validated' END AS status,
         'sup-' || l_suppkey AS uploader,
         '{PREFIX}/' || l_orderkey AS file
  FROM lineitem)"""


def url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem")
    lines = lines.withColumn("l_cents", F.round(F.col("l_extendedprice") * 100).cast("long"))

    def text(*parts):
        return F.concat(*[F.lit(p) if not p.startswith("l_") else F.col(p).cast("string") for p in parts])

    flag = F.col("l_returnflag")
    node = text(
        "node://lab@x.org/OEP", "l_suppkey", "/OEX", "l_partkey", "/OES", "l_linenumber", "/OER", "l_orderkey",
        "/OED", "l_orderkey", "l_linenumber", "l_cents",
    )
    s3 = F.concat(
        F.lit("s3://bucket-"),
        (F.col("l_suppkey") % 5).cast("string"),
        text("/", "l_orderkey", "/", "l_partkey", "-", "l_suppkey", "-", "l_linenumber", "-", "l_cents"),
    )
    gsa = text(
        "gsa://lab@x.org/HRA", "l_suppkey", "/HRS", "l_partkey", "/HRX", "l_linenumber", "/HRR", "l_orderkey",
        "/HRR", "l_orderkey", "_f", "l_linenumber", "-", "l_cents", ".gz",
    )
    return lines.select(
        url_id().alias("id"),
        F.when(flag == "A", node).when(flag == "N", s3).otherwise(gsa).alias("url"),
        _millis("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "O", "pending").otherwise("validated").alias("status"),
        text("sup-", "l_suppkey").alias("uploader"),
        text(f"{PREFIX}/", "l_orderkey").alias("file"),
    )


HASH_SQL = f"""hash AS (
  SELECT o_orderkey * 2 AS id, md5('file-' || o_orderkey) AS hash, 'md5' AS hash_type,
         '{PREFIX}/' || o_orderkey AS file FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, sha256('file-' || o_orderkey), 'sha256', '{PREFIX}/' || o_orderkey FROM orders)"""


def hash_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("file-"), F.col("o_orderkey").cast("string")).cast("binary")
    both = F.array(
        F.struct((F.col("o_orderkey") * 2).alias("id"), F.md5(content).alias("hash"), F.lit("md5").alias("hash_type")),
        F.struct(
            (F.col("o_orderkey") * 2 + 1).alias("id"),
            F.sha2(content, 256).alias("hash"),
            F.lit("sha256").alias("hash_type"),
        ),
    )
    file = F.concat(F.lit(f"{PREFIX}/"), F.col("o_orderkey").cast("string")).alias("file")
    return load(spark, sf_dir, "orders").select(F.inline(both), file)


ALIAS_SQL = f"""alias AS (
  SELECT o_orderkey AS id, 'doi://10.1234/' || o_orderkey AS name, '{PREFIX}/' || o_orderkey AS file
  FROM orders WHERE o_orderstatus = 'F')"""


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return (
        load(spark, sf_dir, "orders")
        .filter(F.col("o_orderstatus") == "F")
        .select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("doi://10.1234/"), key).alias("name"),
            F.concat(F.lit(f"{PREFIX}/"), key).alias("file"),
        )
    )


TAG_SQL = f"""tag AS (
  SELECT o_orderkey * 2 AS id, 'priority' AS field_name, o_orderpriority AS field_value,
         '{PREFIX}/' || o_orderkey AS file FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, 'customer', 'cust-' || o_custkey, '{PREFIX}/' || o_orderkey FROM orders)"""


def tag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.array(
        F.struct(
            (F.col("o_orderkey") * 2).alias("id"),
            F.lit("priority").alias("field_name"),
            F.col("o_orderpriority").alias("field_value"),
        ),
        F.struct(
            (F.col("o_orderkey") * 2 + 1).alias("id"),
            F.lit("customer").alias("field_name"),
            F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("field_value"),
        ),
    )
    file = F.concat(F.lit(f"{PREFIX}/"), F.col("o_orderkey").cast("string")).alias("file")
    return load(spark, sf_dir, "orders").select(F.inline(both), file)


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    return Registry(
        file=file_table(spark, sf_dir),
        url=url_table(spark, sf_dir),
        hash=hash_table(spark, sf_dir),
        alias=alias_table(spark, sf_dir),
        tag=tag_table(spark, sf_dir),
    )


_STORES: dict[tuple[str, str], registry_store.Store] = {}


def stored_registry(spark: SparkSession, sf_dir: str) -> registry_store.Store:
    """The registry as a store of co-located tables, written once per application; its version 1 is ``registry``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = registry_store.create(spark, scratch_path(spark, "registry-store"), registry(spark, sf_dir))
    return _STORES[key]


_INDEXES: dict[tuple[str, str, str], text_index.TextIndex] = {}


def indexed(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> dict[str, tuple[str, text_index.TextIndex]]:
    """The trigram index of a text column by its field, written once per application."""
    name = (spark.sparkContext.applicationId, sf_dir, f"{table}.{text}")
    if name not in _INDEXES:
        _INDEXES[name] = text_index.build(load(spark, sf_dir, table), key, text, scratch_path(spark, f"index-{table}"))
    return {text: (key, _INDEXES[name])}


CATALOG_SQL = """catalog AS (
  SELECT lower(replace(p_brand, '#', '_')) AS key,
         'v0.' || p_size || '.' || (p_partkey % 12) AS version,
         min(p_brand || ' ' || p_type) AS name,
         count(*)::BIGINT AS total,
         min(p_type) AS disease, min(split_part(p_name, ' ', 1)) AS organ
  FROM part GROUP BY 1, 2)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets from parts; those with one part only carry no tags."""
    version = F.concat(
        F.lit("v0."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string")
    )
    grouped = (
        load(spark, sf_dir, "part")
        .groupBy(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("key"), version.alias("version"))
        .agg(
            F.min(F.concat_ws(" ", "p_brand", "p_type")).alias("name"),
            F.count(F.lit(1)).alias("total"),
            F.min("p_type").alias("disease"),
            F.min(F.substring_index("p_name", " ", 1)).alias("organ"),
        )
    )
    tags = F.array(
        F.concat(F.lit("disease:"), F.col("disease")), F.concat(F.lit("organ:"), F.col("organ")), F.lit("org:demo")
    )
    return grouped.withColumn(
        "tags", F.when(F.col("total") > 1, tags).otherwise(F.array().cast("array<string>"))
    )


SAMPLES_SQL = """samples AS (
  SELECT c_custkey AS sample_id, c_name AS name, n_name AS nation, c_mktsegment AS segment,
         c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("sample_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


SURVIVAL_SQL = """surv AS (
  SELECT l_quantity AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev,
         l_linestatus AS grp, l_extendedprice AS price, l_discount AS discount FROM lineitem)"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = F.col("l_returnflag") == "R"
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("os_months"),
        F.when(dead, "1:DECEASED").otherwise("0:LIVING").alias("os_status"),
        F.round(F.col("l_tax") * 100).alias("dfs_months"),
        (F.col("l_linestatus") == "F").alias("dfs_status"),
        F.col("l_linestatus").alias("arm"),
        F.col("l_discount").alias("dose"),
        F.col("l_extendedprice").alias("price"),
    )
