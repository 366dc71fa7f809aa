"""Merging metadata with measurements, statistics, histograms, survival curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.operators import merge as merging
from cohortspark.operators import stats, summaries, survival as km
from cohortspark.session import written
from workloads import query
from workloads.tables import CATALOG_SQL, SAMPLES_SQL, SURVIVAL_SQL, catalog, load, samples, survival

# ------------------------------------------------------------------ merging

_SIDES = """WITH l AS (
  SELECT nullif(c_custkey, 7) AS id, c_mktsegment AS note, c_nationkey AS nation FROM customer),
r AS (
  SELECT nullif(o_custkey, 7) AS cust, o_orderpriority AS note, o_orderkey AS orderkey FROM orders
  UNION ALL SELECT -1 - s_suppkey, s_name, NULL FROM supplier)"""

_MERGED = """SELECT l.id, {note} AS note, l.nation, r.cust, r.orderkey
FROM l {how} JOIN r ON l.id IS NOT DISTINCT FROM r.cust"""


def _sides(spark, sf_dir):
    left = load(spark, sf_dir, "customer").select(
        F.nullif("c_custkey", F.lit(7)).alias("id"), F.col("c_mktsegment").alias("note"), F.col("c_nationkey").alias("nation")
    )
    orders = load(spark, sf_dir, "orders").select(
        F.nullif("o_custkey", F.lit(7)).alias("cust"), F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("orderkey")
    )
    others = load(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("cust"), F.col("s_name").alias("note"), F.lit(None).cast("long").alias("orderkey")
    )
    return left, orders.unionByName(others)


@query(f"{_SIDES} {_MERGED.format(how='', note='r.note')}")
def merge_inner(spark, sf_dir):
    return merging.merge(*_sides(spark, sf_dir), "id", "cust", "inner")


@query(f"{_SIDES} {_MERGED.format(how='LEFT', note='coalesce(r.note, l.note)')}")
def merge_left(spark, sf_dir):
    return merging.merge(*_sides(spark, sf_dir), "id", "cust", "left")


@query(f"{_SIDES} {_MERGED.format(how='RIGHT', note='r.note')}")
def merge_right(spark, sf_dir):
    return merging.merge(*_sides(spark, sf_dir), "id", "cust", "right")


@query(f"{_SIDES} {_MERGED.format(how='FULL', note='coalesce(r.note, l.note)')}")
def merge_outer(spark, sf_dir):
    return merging.merge(*_sides(spark, sf_dir), "id", "cust", "outer")


def _orders(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query(f"""WITH {SAMPLES_SQL}
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, sample_id, name, nation, segment, balance
FROM orders LEFT JOIN samples ON o_custkey = sample_id""")
def datafile_with_metadata(spark, sf_dir):
    return merging.with_metadata(_orders(spark, sf_dir), samples(spark, sf_dir), "o_custkey")


@query(f"""WITH {SAMPLES_SQL}
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
WHERE o_custkey IN (SELECT sample_id FROM samples WHERE segment = 'MACHINERY' AND balance > 1000)""")
def datafile_of_samples(spark, sf_dir):
    chosen = samples(spark, sf_dir).filter((F.col("segment") == "MACHINERY") & (F.col("balance") > 1000))
    return merging.of_samples(_orders(spark, sf_dir), chosen, "o_custkey")


@query(f"""WITH {SAMPLES_SQL}, picked AS (
  SELECT o_totalprice, nation FROM orders JOIN samples ON o_custkey = sample_id
  WHERE sample_id IN (SELECT sample_id FROM samples WHERE segment <> 'BUILDING'))
SELECT nation AS "group", count(*)::BIGINT AS count, round(avg(o_totalprice), 6) AS mean,
       round(median(o_totalprice), 6) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max,
       round(stddev_pop(o_totalprice), 6) AS std
FROM picked GROUP BY nation""")
def cohort_stats(spark, sf_dir):
    people = samples(spark, sf_dir)
    rows = merging.of_samples(_orders(spark, sf_dir), people.filter(F.col("segment") != "BUILDING"), "o_custkey")
    return _rounded(stats.grouped_stats(merging.with_metadata(rows, people, "o_custkey"), "nation", "o_totalprice"))


@query("""
SELECT o_orderkey AS sample_id, o_custkey AS patient_id, o_orderstatus AS status, c_name AS name,
       c_mktsegment AS segment
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def clinical_merge(spark, sf_dir):
    patients = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.lit("unused").alias("status"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    )
    rows = load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("status")
    )
    return merging.merge_clinical(rows, patients)


@query("""
SELECT p_partkey, concat_ws(';', 'disease:' || n_name, 'organ:' || r_name, 'org:Demo') AS tags
FROM part LEFT JOIN nation ON upper('nation_' || p_size) = upper(n_name) LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_enrichment(spark, sf_dir):
    studies = load(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("nation_"), F.col("p_size").cast("string")).alias("type_of_cancer")
    )
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    lookup = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.upper("n_name").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("tissue")
    )
    tagged = merging.enrich_tags(studies, lookup, organization="Demo")
    return tagged.select("p_partkey", F.concat_ws(";", "tags").alias("tags"))


# ------------------------------------------------------------------ statistics


def _rounded(df, digits=6):
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _percent_sql(table: str) -> str:
    """Two decimals of the exact value; printf rounds true ties, exact eighths, to even instead of up."""
    share = f"(count(*)::DOUBLE / (SELECT count(*) FROM {table}) * 100)"
    return f"CASE WHEN {share} * 8 = floor({share} * 8) THEN round({share}, 2) ELSE printf('%.2f', {share})::DOUBLE END"


@query(f"""
WITH v AS (SELECT CASE WHEN p_brand = 'Brand#3' OR p_brand = '' THEN 'NA' ELSE p_brand END AS value FROM part)
SELECT value, count(*)::BIGINT AS count, {_percent_sql("part")} AS percent
FROM v GROUP BY value""")
def frequency(spark, sf_dir):
    brand = F.col("p_brand")
    rows = load(spark, sf_dir, "part").select(
        F.when(brand == "Brand#3", F.when(F.col("p_size") > 20, "")).otherwise(brand).alias("brand")
    )
    return stats.frequency(rows, "brand")


@query(f"""
WITH v AS (SELECT CASE WHEN l_discount IS NULL THEN 'NA' ELSE
             regexp_replace(printf('%.2f', l_discount), '\\.?0+$', '') END AS value FROM lineitem)
SELECT value, count(*)::BIGINT AS count, {_percent_sql("lineitem")} AS percent
FROM v GROUP BY value""")
def frequency_numbers(spark, sf_dir):
    return stats.frequency(load(spark, sf_dir, "lineitem"), "l_discount")


@query("""SELECT (count(DISTINCT v) + max(CASE WHEN v IS NULL THEN 1 ELSE 0 END))::BIGINT AS "values"
FROM (SELECT nullif(o_custkey, 11) AS v FROM orders)""")
def distinct_values(spark, sf_dir):
    return stats.value_count(load(spark, sf_dir, "orders").select(F.nullif("o_custkey", F.lit(11)).alias("v")), "v")


@query(f"""SELECT count(*)::BIGINT AS loaded, (SELECT count(*) FROM orders)::BIGINT AS total,
       {_percent_sql("orders")} AS percent
FROM orders WHERE o_orderstatus = 'F'""")
def coverage(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return stats.coverage(orders.filter(F.col("o_orderstatus") == "F"), orders)


_GROUPED = """SELECT l_returnflag AS "group", count(*)::BIGINT AS count, round(avg(l_extendedprice), 6) AS mean,
       round(median(l_extendedprice), 6) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       round(stddev_pop(l_extendedprice), 6) AS std
FROM lineitem GROUP BY 1"""


@query(_GROUPED)
def grouped_stats(spark, sf_dir):
    return _rounded(stats.grouped_stats(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"))


@query(_GROUPED)
def grouped_stats_large_groups(spark, sf_dir):
    """The same, on the way that large groups take."""
    rows = load(spark, sf_dir, "lineitem")
    return _rounded(stats.grouped_stats(rows, "l_returnflag", "l_extendedprice", group_values=0, accuracy=500))


@query("""SELECT CASE WHEN l_quantity <= 40 THEN 0 ELSE l_quantity END AS "group", count(*)::BIGINT AS count,
       round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median, min(l_extendedprice) AS min,
       max(l_extendedprice) AS max, round(stddev_pop(l_extendedprice), 6) AS std
FROM lineitem GROUP BY 1""")
def grouped_stats_mixed_groups(spark, sf_dir):
    """One group with most of the rows beside ten small ones: only the large one is cut into brackets."""
    quantity = F.when(F.col("l_quantity") <= 40, 0.0).otherwise(F.col("l_quantity"))
    rows = load(spark, sf_dir, "lineitem").withColumn("band", quantity)
    limit = rows.count() // 5
    return _rounded(stats.grouped_stats(rows, "band", "l_extendedprice", group_values=limit, accuracy=500))


@query("""SELECT event_type AS "group", round(avg(value), 6) AS mean,
       round(stddev_samp(value) / sqrt(count(value)), 6) AS error
FROM events GROUP BY 1""")
def grouped_mean_error(spark, sf_dir):
    return _rounded(stats.grouped_mean_error(load(spark, sf_dir, "events"), "event_type", "value"))


@query("SELECT c_mktsegment, count(*)::BIGINT AS count FROM customer GROUP BY 1")
def category_counts(spark, sf_dir):
    return stats.category_counts(load(spark, sf_dir, "customer"), "c_mktsegment")


@query("""SELECT o_orderstatus, o_orderpriority, count(*)::BIGINT AS count FROM orders
WHERE o_orderstatus <> '' GROUP BY 1, 2""")
def category_pair_counts(spark, sf_dir):
    return stats.category_counts(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT c_custkey, c_acctbal, segment FROM (
  SELECT c_custkey, nullif(c_acctbal, 0) AS c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN ''
         WHEN 'MACHINERY' THEN NULL ELSE c_mktsegment END AS segment FROM customer)
WHERE segment IS NOT NULL AND segment <> '' AND c_acctbal IS NOT NULL""")
def drop_missing_pairs(spark, sf_dir):
    segment = F.col("c_mktsegment")
    rows = load(spark, sf_dir, "customer").select(
        "c_custkey", F.nullif("c_acctbal", F.lit(0.0)).alias("c_acctbal"),
        F.when(segment == "BUILDING", "").when(segment != "MACHINERY", segment).alias("segment"),
    )
    return stats.drop_missing(rows, "segment", "c_acctbal")


@query("SELECT (floor(o_totalprice / 10) * 10)::DOUBLE AS bin, count(*)::BIGINT AS count FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return stats.histogram(load(spark, sf_dir, "orders"), "o_totalprice")


@query("""SELECT l_linestatus AS "group", (floor(l_quantity / 10) * 10)::DOUBLE AS bin, count(*)::BIGINT AS count
FROM lineitem GROUP BY 1, 2""")
def histogram_grouped(spark, sf_dir):
    return stats.histogram(load(spark, sf_dir, "lineitem"), "l_quantity", "l_linestatus")


_QUARTILES = {
    "linear": """q AS (
  SELECT event_type AS "group", quantile_cont(value, 0.25) AS q1, median(value) AS median,
         quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)""",
    "hazen": """s AS (
  SELECT event_type AS "group", value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
         count(*) OVER (PARTITION BY event_type) AS n FROM events),
h AS (
  SELECT DISTINCT "group", p, greatest(least(n * p - 0.5, n - 1), 0) AS h FROM s, (VALUES (0.25), (0.5), (0.75)) t(p)),
v AS (
  SELECT h."group", h.p, max(CASE WHEN s.i = floor(h.h) THEN value END) AS lo,
         max(CASE WHEN s.i = ceil(h.h) THEN value END) AS hi, max(h.h - floor(h.h)) AS part
  FROM h JOIN s ON s."group" = h."group" GROUP BY 1, 2),
q AS (
  SELECT "group", max(CASE WHEN p = 0.25 THEN lo + (hi - lo) * part END) AS q1,
         max(CASE WHEN p = 0.5 THEN lo + (hi - lo) * part END) AS median,
         max(CASE WHEN p = 0.75 THEN lo + (hi - lo) * part END) AS q3 FROM v GROUP BY 1)""",
}

_BOX = """WITH {quartiles}, f AS (
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT "group", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, count(*)::BIGINT AS count,
       round(avg(value), 6) AS mean,
       min(CASE WHEN value BETWEEN lower_fence AND upper_fence THEN value END) AS lower_whisker,
       max(CASE WHEN value BETWEEN lower_fence AND upper_fence THEN value END) AS upper_whisker,
       count(CASE WHEN value NOT BETWEEN lower_fence AND upper_fence THEN 1 END)::BIGINT AS outliers
FROM events JOIN f ON event_type = "group"
GROUP BY "group", q1, median, q3, lower_fence, upper_fence"""


@query(_BOX.format(quartiles=_QUARTILES["linear"]))
def box_stats(spark, sf_dir):
    return _rounded(stats.box_stats(load(spark, sf_dir, "events"), "event_type", "value"))


@query(_BOX.format(quartiles=_QUARTILES["linear"]))
def box_stats_large_groups(spark, sf_dir):
    rows = load(spark, sf_dir, "events")
    return _rounded(stats.box_stats(rows, "event_type", "value", group_values=0, accuracy=500))


@query(_BOX.format(quartiles=_QUARTILES["hazen"]))
def box_stats_midpoint_rule(spark, sf_dir):
    return _rounded(stats.box_stats(load(spark, sf_dir, "events"), "event_type", "value", rule="hazen"))


@query(f"""WITH {_QUARTILES['linear']}
SELECT event_id, event_type, value FROM events JOIN q ON event_type = "group"
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def box_outliers(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return stats.box_outliers(rows, "event_type", "value")


@query("SELECT round(sum(floor(o_totalprice)::BIGINT) / 1024.0 ^ 3, 3)::DOUBLE AS gigabytes FROM orders WHERE o_orderstatus = 'F'")
def selected_size(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F")
    return stats.selected_size(rows.select(F.floor("o_totalprice").alias("size")))


@query(f"""WITH {CATALOG_SQL}, t AS (
  SELECT key, version, unnest(CASE WHEN total > 1 THEN ['disease:' || disease, 'organ:' || organ, 'org:demo']
                              ELSE ['No tags'] END) AS tag FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY split_part(version, '.', 2)::INT DESC,
                                 split_part(version, '.', 3)::INT DESC) AS rn FROM catalog) WHERE rn = 1)
SELECT tag, count(*)::BIGINT AS datasets,
       CASE WHEN tag = 'No tags' THEN 'none' WHEN split_part(tag, ':', 1) IN ('disease', 'organ')
            THEN split_part(tag, ':', 1) ELSE 'org' END AS namespace
FROM t GROUP BY tag""")
def tag_facets(spark, sf_dir):
    return stats.tag_facets(catalog(spark, sf_dir))


_SWEEP_STATS = """count(*)::BIGINT AS count, coalesce(round(avg(y), 6), 0) AS mean, coalesce(min(y), 0) AS min,
  coalesce(max(y), 0) AS max, coalesce(round(stddev_pop(y), 6), 0) AS std, coalesce(round(median(y), 6), 0) AS median"""
_SWEEP_ROWS = """c AS (SELECT *, CASE WHEN c_custkey % 5 > 0 AND c_nationkey <> 3 THEN c_acctbal END AS y FROM customer)"""


@query(f"""WITH {_SWEEP_ROWS}
SELECT 'c_mktsegment' AS field, c_mktsegment AS value, {_SWEEP_STATS} FROM c GROUP BY c_mktsegment
UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, {_SWEEP_STATS} FROM c GROUP BY c_nationkey
UNION ALL SELECT 'n_name', n_name, {_SWEEP_STATS} FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def facet_sweep(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    rows = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    number = (F.col("c_custkey") % 5 > 0) & (F.col("c_nationkey") != 3)
    rows = rows.withColumn("y", F.when(number, F.col("c_acctbal")))
    return _rounded(stats.facet_sweep(rows, ["c_mktsegment", "c_nationkey", "n_name"], "y"))


# ------------------------------------------------------------------ survival


def _km_sql(group: str, rows: str) -> str:
    by = f"PARTITION BY {group}" if group else ""
    key = f"{group} AS \"group\", " if group else ""
    grouping = f"{group}, time" if group else "time"
    start = (
        f"SELECT {group}, 0.0::DOUBLE, 1.0::DOUBLE, 0::BIGINT, count(*)::BIGINT FROM {rows} GROUP BY {group}"
        if group
        else f"SELECT 0.0::DOUBLE, 1.0::DOUBLE, 0::BIGINT, count(*)::BIGINT FROM {rows}"
    )
    return f"""a AS (
  SELECT {group + ',' if group else ''} time, sum(ev)::BIGINT AS events, count(*)::BIGINT AS n FROM {rows} GROUP BY {grouping}),
b AS (SELECT *, sum(n) OVER ({by} ORDER BY time DESC)::BIGINT AS before FROM a)
SELECT {key}time, round(product(1 - events / before::DOUBLE) OVER ({by} ORDER BY time), 6) AS survival, events,
       (before - n)::BIGINT AS at_risk FROM b
UNION ALL {start}"""


@query(f"WITH {SURVIVAL_SQL}, {_km_sql('', 'surv')}")
def kaplan_meier(spark, sf_dir):
    return _rounded(km.kaplan_meier(survival(spark, sf_dir), "os_months", "os_status"))


@query(f"WITH {SURVIVAL_SQL}, {_km_sql('grp', 'surv')}")
def kaplan_meier_grouped(spark, sf_dir):
    return _rounded(km.kaplan_meier_by(survival(spark, sf_dir), "os_months", "os_status", "arm"))


# continuous times: every sale price is a time of its own
_PRICES_SQL = """surv AS (
  SELECT l_extendedprice AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev, l_linestatus AS grp
  FROM lineitem)"""


@query(f"WITH {_PRICES_SQL}, {_km_sql('grp', 'surv')}")
def kaplan_meier_continuous(spark, sf_dir):
    return _rounded(km.kaplan_meier_by(survival(spark, sf_dir), "price", "os_status", "arm"))


@query(f"WITH {_PRICES_SQL}, {_km_sql('grp', 'surv')}")
def kaplan_meier_large_groups(spark, sf_dir):
    """The same, with the time axis of each group cut into ranges."""
    rows = survival(spark, sf_dir)
    return _rounded(km.kaplan_meier_by(rows, "price", "os_status", "arm", group_times=0, ranges=16))


_BANDS_SQL = """surv AS (
  SELECT l_extendedprice AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev,
         CASE WHEN l_quantity <= 40 THEN 'most' ELSE l_quantity::BIGINT::VARCHAR END AS grp FROM lineitem)"""


@query(f"WITH {_BANDS_SQL}, {_km_sql('grp', 'surv')}")
def kaplan_meier_mixed_groups(spark, sf_dir):
    """One group with most of the times beside ten small ones: only the large one is cut into ranges."""
    band = F.when(F.col("l_quantity") <= 40, "most").otherwise(F.col("l_quantity").cast("long").cast("string"))
    event = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("price"), event.alias("dead"), band.alias("band"))
    return _rounded(km.kaplan_meier_by(rows, "price", "dead", "band", group_times=rows.count() // 5, ranges=16))


@query(f"""WITH {SURVIVAL_SQL}, o AS (
  SELECT discount, row_number() OVER (ORDER BY discount) - 1 AS i, count(*) OVER () AS n FROM surv),
m AS (SELECT max(CASE WHEN i = n // 2 THEN discount END) AS middle FROM o),
split AS (
  SELECT time, ev, CASE WHEN discount <= middle THEN '<= median (' ELSE '> median (' END
         || printf('%.2f', middle) || ')' AS side FROM surv, m),
{_km_sql('side', 'split')}""")
def kaplan_meier_median_split(spark, sf_dir):
    return _rounded(km.kaplan_meier_by(survival(spark, sf_dir), "os_months", "os_status", "dose"))


@query(f"""WITH split AS (
  SELECT 'os' AS endpoint, l_quantity AS time, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS ev FROM lineitem
  UNION ALL SELECT 'dfs', round(l_tax * 100), CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END FROM lineitem),
{_km_sql('endpoint', 'split').replace('AS "group"', 'AS endpoint')}""")
def kaplan_meier_endpoints(spark, sf_dir):
    return _rounded(km.kaplan_meier_endpoints(survival(spark, sf_dir)))


@query("""
WITH long AS (
  SELECT 'o_custkey' AS field, o_custkey::VARCHAR AS text, o_custkey::DOUBLE AS number FROM orders
  UNION ALL SELECT 'o_totalprice', o_totalprice::VARCHAR, o_totalprice FROM orders
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL FROM orders)
SELECT field, count(*)::BIGINT AS rows, (count(*) - count(text))::BIGINT AS missing, min(number) AS low, max(number) AS high,
       round(avg(number), 6) AS mean, round(stddev_pop(number), 6) AS std, true AS distinct_close, true AS median_close
FROM long GROUP BY field""")
def merged_summaries(spark, sf_dir):
    """Summaries per year, stored and merged; sketched figures are held against exact ones of the rows: distinct values
    within 5 % (three standard errors), the rank of the median within 2 %."""
    fields = ["o_custkey", "o_totalprice", "o_orderpriority"]
    orders = load(spark, sf_dir, "orders")
    yearly = written(summaries.summarise(orders.withColumn("year", F.year("o_orderdate")), fields, ["year"]), "yearly-summaries")
    found = written(summaries.figures(summaries.merge(yearly)), "merged-summaries")
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text"),
                      F.col(f).try_cast("double").alias("number")) for f in fields]
    rows = orders.select(F.inline(F.array(*cells))).join(found.select("field", "median"), "field")
    exact = rows.groupBy("field").agg(
        F.count_distinct("text").alias("_values"), F.avg((F.col("number") < F.col("median")).cast("int")).alias("_below"),
        F.avg((F.col("number") <= F.col("median")).cast("int")).alias("_up_to"))
    median = F.col("median").isNull() | ((F.col("_below") <= 0.52) & (F.col("_up_to") >= 0.48))
    close = F.abs(F.col("distinct") - F.col("_values")) <= 0.05 * F.col("_values")
    out = found.join(exact, "field").select(
        "field", "rows", "missing", "low", "high", "mean", "std", close.alias("distinct_close"), median.alias("median_close"))
    return _rounded(out)
