"""Dataset versions and file histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import versions
from workloads import query
from workloads.tables import CATALOG_SQL, FILE_SQL, catalog, file_table, load

_ORDER = """split_part(version, '.', 2)::INT DESC, split_part(version, '.', 3)::INT DESC"""


@query(f"""WITH {CATALOG_SQL}
SELECT key, version, name, total FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY {_ORDER}) AS rn FROM catalog)
WHERE rn = 1""")
def latest_version(spark, sf_dir):
    return versions.latest(catalog(spark, sf_dir)).select("key", "version", "name", "total")


@query(f"""WITH {CATALOG_SQL}, asked AS (
  SELECT DISTINCT 'brand_' || (s_suppkey % 30) AS key, 'v0.' || (s_suppkey % 60) || '.' || (s_suppkey % 12) AS requested
  FROM supplier)
SELECT key, requested, version, total FROM (
  SELECT c.key, a.requested, c.version, c.total, row_number() OVER (
    PARTITION BY c.key, a.requested
    ORDER BY CASE WHEN c.version = a.requested THEN 0 ELSE 1 END, {_ORDER}) AS rn
  FROM catalog c JOIN asked a ON c.key = a.key)
WHERE rn = 1""")
def resolve_version(spark, sf_dir):
    n = F.col("s_suppkey")
    requests = load(spark, sf_dir, "supplier").select(
        F.concat(F.lit("brand_"), (n % 30).cast("string")).alias("key"),
        F.concat(F.lit("v0."), (n % 60).cast("string"), F.lit("."), (n % 12).cast("string")).alias("version"),
    )
    return versions.resolve(catalog(spark, sf_dir), requests).select("key", "requested", "version", "total")


_HISTORY = f"""WITH {FILE_SQL}
SELECT guid, baseid, version, recency::BIGINT AS recency, recency = 1 AS is_latest FROM (
  SELECT *, row_number() OVER (PARTITION BY baseid ORDER BY version DESC, updated_at DESC, guid) AS recency FROM file)"""


@query(_HISTORY)
def file_history(spark, sf_dir):
    files = file_table(spark, sf_dir).select("guid", "baseid", "version", "updated_at")
    return versions.history(files).drop("updated_at")


@query(_HISTORY)
def file_history_large_groups(spark, sf_dir):
    """The same, with each history cut into ranges."""
    files = file_table(spark, sf_dir).select("guid", "baseid", "version", "updated_at")
    return versions.history(files, group_rows=0, ranges=4).drop("updated_at")
