"""Query descriptions, filters, paging, similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import names
from cohortspark.operators.inequality import compared
from cohortspark.operators.paging import page
from cohortspark.operators.predicates import apply_filter
from cohortspark.operators.ranking import rank_by_filter, rank_by_similarity, search_catalog
from cohortspark.plans import query as plan
from workloads import query
from workloads.tables import CATALOG_SQL, catalog, indexed, load


def _fields(*columns):
    return [{"type": "field", "value": c} for c in columns]


def _agg(func, field, alias):
    return {"type": "agg_func", "func": func, "field": field, "alias": alias}


def _leaf(field, operator, value):
    return {"field": field, "operator": operator, "value": value}


def _run(spark, sf_dir, description):
    tables = [description["table"], *[j["table"] for j in description.get("joins", [])]]
    return plan.run({t: load(spark, sf_dir, t) for t in tables}, description)


def _on(left, left_field, right, right_field):
    return {
        "type": "expr", "left_table": left, "left_field": left_field,
        "right_table": right, "right_field": right_field,
    }


@query("SELECT r_regionkey, r_name FROM region")
def table_scan(spark, sf_dir):
    return _run(spark, sf_dir, {"table": "region"})


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def select_fields(spark, sf_dir):
    return _run(spark, sf_dir, {"table": "lineitem", "selects": _fields("l_orderkey", "l_linenumber", "l_shipdate")})


@query("""
SELECT c_custkey, n_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def select_qualified(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "customer",
        "joins": [
            {"table": "nation", "on": _on("customer", "c_nationkey", "nation", "n_nationkey")},
            {"table": "region", "on": _on("nation", "n_regionkey", "region", "r_regionkey")},
        ],
        "selects": _fields("c_custkey", "n_name", "r_name"),
        "field_table_map": {"c_custkey": "customer", "n_name": "nation", "r_name": "region"},
    })


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity >= 30 AND (l_returnflag = 'R' OR (l_discount < 0.03 AND l_linestatus <> 'O'))
  AND l_tax <= 0.05
""")
def filter_tree(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "lineitem",
        "selects": _fields("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"),
        "filters": {"operator": "and", "items": [
            _leaf("l_quantity", ">=", 30),
            {"operator": "or", "items": [
                _leaf("l_returnflag", "=", "R"),
                {"operator": "and", "items": [_leaf("l_discount", "<", 0.03), _leaf("l_linestatus", "<>", "O")]},
            ]},
            _leaf("l_tax", "<=", 0.05),
        ]},
    })


@query("""
SELECT p_partkey, p_name, p_type FROM part
WHERE p_name LIKE '%ol%' AND p_name NOT LIKE 'red%' AND p_type ILIKE 'me%'
""")
def filter_like(spark, sf_dir):
    tree = {"operator": "and", "items": [
        _leaf("p_name", "like", "%ol%"), _leaf("p_name", "not like", "red%"), _leaf("p_type", "ilike", "me%"),
    ]}
    return apply_filter(load(spark, sf_dir, "part"), tree).select("p_partkey", "p_name", "p_type")


@query("""
SELECT p_partkey, p_size, p_brand FROM part
WHERE p_size IN (1, 5, 9) OR (p_brand IN ('Brand#1', 'Brand#2') AND p_size NOT IN (20, 30))
   OR p_retailprice IN (900.0, 950.5)
""")
def filter_in(spark, sf_dir):
    tree = {"operator": "or", "items": [
        _leaf("p_size", "in", [1, 5, 9]),
        {"operator": "and", "items": [
            _leaf("p_brand", "in", ["Brand#1", "Brand#2"]), _leaf("p_size", "not in", [20, 30]),
        ]},
        _leaf("p_retailprice", "in", [900.0, 950.5]),
    ]}
    return apply_filter(load(spark, sf_dir, "part"), tree).select("p_partkey", "p_size", "p_brand")


@query("""
WITH c AS (SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment,
                  nullif(c_nationkey, 3) AS nation FROM customer)
SELECT c_custkey, segment, nation FROM c
WHERE segment IS NULL OR (nation IS NOT NULL AND c_acctbal < 0)
""")
def filter_null(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.nullif("c_nationkey", F.lit(3)).alias("nation"),
    )
    tree = {"operator": "or", "items": [
        _leaf("segment", "is", None),
        {"operator": "and", "items": [_leaf("nation", "is not", None), _leaf("c_acctbal", "<", 0)]},
    ]}
    return apply_filter(rows, tree).select("c_custkey", "segment", "nation")


@query("""
SELECT o_orderkey, flagged FROM (
  SELECT o_orderkey, o_orderstatus = 'F' AS flagged, o_totalprice FROM orders)
WHERE flagged = true AND o_totalprice <> 0 AND o_orderkey < 100000000000
""")
def filter_bool(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("flagged", F.col("o_orderstatus") == "F")
    tree = {"operator": "and", "items": [
        _leaf("flagged", "=", True), _leaf("o_totalprice", "!=", 0), _leaf("o_orderkey", "<", 100000000000.0),
    ]}
    return apply_filter(rows, tree).select("o_orderkey", "flagged")


@query("""
SELECT n_name, count(*)::BIGINT AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean_price,
       max(o_totalprice) AS highest
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P' AND c_acctbal > 0
GROUP BY n_name HAVING count(*) > 10 AND max(o_totalprice) > 1000
ORDER BY revenue DESC LIMIT 10
""")
def plan_join_group_having(spark, sf_dir):
    out = _run(spark, sf_dir, {
        "table": "nation",
        "joins": [
            {"table": "customer", "on": _on("nation", "n_nationkey", "customer", "c_nationkey")},
            {"table": "orders", "on": _on("customer", "c_custkey", "orders", "o_custkey")},
        ],
        "selects": [
            *_fields("n_name"), _agg("count", "*", "n_orders"), _agg("sum", "o_totalprice", "revenue"),
            _agg("avg", "o_totalprice", "mean_price"), _agg("max", "o_totalprice", "highest"),
        ],
        "filters": {"operator": "and", "items": [_leaf("o_orderstatus", "!=", "P"), _leaf("c_acctbal", ">", 0)]},
        "group_by": ["n_name"],
        "having": {"type": "group", "operator": "AND", "items": [
            {"type": "expr", "value": {"left": {"type": "alias", "value": "n_orders"}, "operator": ">", "value": 10}},
            {"type": "expr", "value": {
                "left": {"type": "function", "func": "max", "field": "o_totalprice"}, "operator": ">", "value": 1000}},
        ]},
        "order_by": [["revenue", True]],
        "limit": 10,
    })
    return out.withColumn("revenue", F.round("revenue", 2)).withColumn("mean_price", F.round("mean_price", 6))


@query("""
SELECT count(*)::BIGINT AS rows, round(avg(l_quantity), 6) AS mean_quantity, min(l_shipdate) AS first_ship,
       max(l_shipdate) AS last_ship, count(l_tax)::BIGINT AS taxed
FROM lineitem
""")
def plan_global_aggregate(spark, sf_dir):
    out = _run(spark, sf_dir, {
        "table": "lineitem",
        "selects": [
            _agg("count", "*", "rows"), _agg("avg", "l_quantity", "mean_quantity"), _agg("min", "l_shipdate", "first_ship"),
            _agg("max", "l_shipdate", "last_ship"), _agg("count", "l_tax", "taxed"),
        ],
    })
    return out.withColumn("mean_quantity", F.round("mean_quantity", 6))


@query("""
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity) AS quantity, min(l_discount) AS low,
       max(l_discount) AS high
FROM lineitem GROUP BY l_returnflag, l_linestatus
HAVING count(*) > 100 OR sum(l_quantity) >= 0
""")
def plan_group_by(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "lineitem",
        "selects": [
            *_fields("l_returnflag", "l_linestatus"), _agg("count", "*", "n"), _agg("sum", "l_quantity", "quantity"),
            _agg("min", "l_discount", "low"), _agg("max", "l_discount", "high"),
        ],
        "group_by": ["l_returnflag", "l_linestatus"],
        "having": {"type": "group", "operator": "or", "items": [
            {"type": "expr", "value": {"left": {"type": "function", "func": "count", "field": "*"}, "operator": ">", "value": 100}},
            {"type": "expr", "value": {"left": {"type": "alias", "value": "quantity"}, "operator": ">=", "value": 0}},
        ]},
    })


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem ORDER BY 1 DESC, 2, 3 LIMIT 40 OFFSET 15")
def plan_distinct_page(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "lineitem",
        "selects": _fields("l_returnflag", "l_linestatus", "l_quantity"),
        "order_by": [["l_returnflag", True], ["l_linestatus", False], ["l_quantity", False]],
        "limit": 40, "offset": 15, "distinct": True,
    })


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def plan_distinct(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "lineitem", "selects": _fields("l_returnflag", "l_linestatus"), "distinct": True,
    })


@query("SELECT count(*)::BIGINT AS total FROM (SELECT DISTINCT l_partkey, l_quantity FROM lineitem WHERE l_discount >= 0.05)")
def plan_count(spark, sf_dir):
    return plan.total({"lineitem": load(spark, sf_dir, "lineitem")}, {
        "table": "lineitem", "selects": _fields("l_partkey", "l_quantity"),
        "filters": _leaf("l_discount", ">=", 0.05), "distinct": True,
        "order_by": [["l_quantity", True]], "limit": 5, "offset": 2,
    })


@query("""
SELECT s_suppkey, c_custkey FROM supplier JOIN customer
  ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal
""")
def theta_join(spark, sf_dir):
    return _run(spark, sf_dir, {
        "table": "supplier",
        "joins": [{"table": "customer", "on": {
            "type": "raw",
            "value": "supplier.s_nationkey = customer.c_nationkey AND supplier.s_acctbal > customer.c_acctbal"}}],
        "selects": _fields("s_suppkey", "c_custkey"),
    })


@query("""
SELECT c_custkey, count(s_suppkey)::BIGINT AS suppliers, sum(round(s_acctbal * 100)::BIGINT)::BIGINT AS cents,
       min(s_name) AS first_name, max(s_acctbal) AS richest
FROM customer LEFT JOIN supplier ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal GROUP BY c_custkey
""")
def theta_join_totals(spark, sf_dir):
    """The pairs of ``theta_join`` counted and summed per customer, without producing them."""
    customers = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    suppliers = load(spark, sf_dir, "supplier").withColumn("cents", F.round(F.col("s_acctbal") * 100).cast("long"))
    found = compared(customers, suppliers, {"c_nationkey": "s_nationkey"}, ("c_acctbal", "<", "s_acctbal"), {
        "suppliers": ("count", None), "cents": ("sum", "cents"), "first_name": ("min", "s_name"), "richest": ("max", "s_acctbal")})
    return found.drop("c_nationkey", "c_acctbal")


@query("""
WITH d AS (SELECT o_orderdate, count(*) AS n, min(o_totalprice) AS cheapest FROM orders GROUP BY 1),
r AS (SELECT o_orderdate, sum(n) OVER w AS n, min(cheapest) OVER w AS cheapest FROM d
      WINDOW w AS (ORDER BY o_orderdate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT o_orderkey, r.n::BIGINT AS so_far, r.cheapest FROM orders JOIN r USING (o_orderdate)
""")
def orders_so_far(spark, sf_dir):
    """Per order how many orders there were up to its date, and the cheapest: one group of all rows, cut into ranges."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    found = compared(orders, orders, {}, ("o_orderdate", ">=", "o_orderdate"), {
        "so_far": ("count", None), "cheapest": ("min", "o_totalprice")}, group_rows=200)
    return found.select("o_orderkey", "so_far", "cheapest")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def order_page(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return page(orders, [("o_totalprice", True), ("o_orderkey", False)], 3, 25)


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 30 OFFSET 3000
""")
def order_deep_page(spark, sf_dir):
    from cohortspark.operators.paging import page_of

    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = [("l_extendedprice", True), ("l_orderkey", False), ("l_partkey", False), ("l_suppkey", False), ("l_linenumber", False)]
    return page_of(rows, order, 3000, 30, heap_rows=1000)


@query("""
SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders
ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40 OFFSET (SELECT count(*) * 2 // 5 FROM orders)
""")
def status_deep_page(spark, sf_dir):
    """A deep page inside a status that about half of all rows have."""
    from cohortspark.operators.paging import page_of

    rows = load(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    return page_of(rows, [("o_orderstatus", False), ("o_totalprice", True), ("o_orderkey", False)], rows.count() * 2 // 5, 40, heap_rows=500)


@query("""
SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey OFFSET (SELECT count(*) // 3 FROM orders)
""")
def offset_only(spark, sf_dir):
    """All rows but the first third."""
    from cohortspark.operators.paging import page_of

    rows = load(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return page_of(rows, [("o_orderstatus", True), ("o_orderkey", False)], rows.count() // 3, heap_rows=500)


@query(f"""WITH {CATALOG_SQL}
SELECT key, version, name, total FROM catalog
WHERE contains(lower(name), 'brand#1') AND total > 1 AND 'organ:' || organ = 'organ:blue'
ORDER BY total DESC, key, version
""")
def catalog_search(spark, sf_dir):
    found = search_catalog(catalog(spark, sf_dir), "BRAND#1", "organ:blue", "total", True)
    return found.select("key", "version", "name", "total")


@query(f"WITH {CATALOG_SQL} SELECT key, version, name, total FROM catalog ORDER BY name, key, version")
def catalog_order(spark, sf_dir):
    return search_catalog(catalog(spark, sf_dir), order_by="name").select("key", "version", "name", "total")


def _trigram_sql(text: str) -> str:
    return f"""list_distinct(flatten(list_transform(
      list_distinct(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')),
      lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def _similarity_sql(text: str, wanted: str) -> str:
    a, b = _trigram_sql(text), _trigram_sql(wanted)
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared} / (len({a}) + len({b}) - {shared})::DOUBLE)"


_SIMILAR_SQL = f"SELECT p_partkey, p_name FROM part WHERE {_similarity_sql('p_name', chr(39) + 'blue bolts' + chr(39))} >= 0.3"


@query(_SIMILAR_SQL)
def filter_similar(spark, sf_dir):
    found = apply_filter(load(spark, sf_dir, "part"), _leaf("p_name", "%", "blue bolts"), indexed(spark, sf_dir, "part", "p_partkey", "p_name"))
    return found.select("p_partkey", "p_name")


@query(_SIMILAR_SQL)
def filter_similar_scan(spark, sf_dir):
    """The same without an index."""
    return apply_filter(load(spark, sf_dir, "part"), _leaf("p_name", "%", "blue bolts")).select("p_partkey", "p_name")


_WANTED = "the thereon of and inen erbles ouerth"
_TOPK_SQL = f"""
SELECT doc_id, round(s, 6) AS score FROM (
  SELECT doc_id, {_similarity_sql('text', chr(39) + _WANTED + chr(39))} AS s FROM documents)
ORDER BY s DESC, doc_id LIMIT 20
"""


def _most_similar(spark, sf_dir, indexes):
    rows = rank_by_similarity(
        load(spark, sf_dir, "documents").select("doc_id", "text"), [("text", f" ~{_WANTED}. ")], limit=20, tie=["doc_id"], indexes=indexes)
    return rows.select("doc_id", F.round("similarity_0", 6).alias("score"))


@query(_TOPK_SQL)
def similarity_topk(spark, sf_dir):
    return _most_similar(spark, sf_dir, indexed(spark, sf_dir, "documents", "doc_id", "text"))


@query(_TOPK_SQL)
def similarity_topk_scan(spark, sf_dir):
    """The same without an index."""
    return _most_similar(spark, sf_dir, None)


@query(f"""WITH g AS (SELECT doc_id, {_trigram_sql('text')} AS grams FROM documents),
p AS (SELECT doc_id, len(grams) AS size, unnest(grams) AS gram FROM g)
SELECT gram, count(*)::BIGINT AS texts, sum(size)::BIGINT AS sizes, sum(doc_id)::BIGINT AS keys FROM p GROUP BY gram""")
def trigram_postings(spark, sf_dir):
    """The index itself: texts of every trigram, their sizes and keys."""
    _, index = indexed(spark, sf_dir, "documents", "doc_id", "text")["text"]
    return index.all_postings().groupBy("gram").agg(
        F.count("key").alias("texts"), F.sum("size").alias("sizes"), F.sum("key").alias("keys"))


@query(f"""
SELECT p_partkey, p_name, p_type FROM part
ORDER BY {_similarity_sql('p_name', "'green gear'")} DESC, {_similarity_sql('p_type', "'promo'")} DESC, p_partkey LIMIT 30
""")
def similarity_filter_order(spark, sf_dir):
    tree = {"operator": "or", "items": [
        _leaf("p_name", "%", "green gear"), _leaf("p_type", "ilike", "promo%"), _leaf("p_brand", "=", "Brand#9"),
    ]}
    ranked = rank_by_filter(load(spark, sf_dir, "part"), tree, first_pairs=2, limit=30, tie=["p_partkey"],
                            indexes=indexed(spark, sf_dir, "part", "p_partkey", "p_name"))
    return ranked.select("p_partkey", "p_name", "p_type")


@query("SELECT c_custkey AS c_custkey, c_name AS _2c_name, c_nationkey AS c_nation_key_ FROM customer")
def normalize_names(spark, sf_dir):
    rows = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" C_CustKey "),
        F.col("c_name").alias("2C-Name"),
        F.col("c_nationkey").alias("C.Nation-Key!"),
    )
    return names.normalize_columns(rows)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def drop_duplicate_columns(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("id")
    )
    return names.drop_duplicate_columns(rows)


@query("SELECT s_suppkey, s_acctbal FROM supplier")
def keep_expected(spark, sf_dir):
    return names.keep_expected(load(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey", "s_phone"])
