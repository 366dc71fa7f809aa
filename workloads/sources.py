"""File formats: whole driver tables written in a format and read back by the readers of the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.session import scratch_path
from cohortspark.operators import reshape, validation
from cohortspark.sources import bundle, convert, registry_tsv, sinks, study
from cohortspark.sources.file_digests import file_digests
from cohortspark.operators.predicates import apply_filter
from cohortspark.operators.ordered import row_numbers
from cohortspark.operators.paging import page_of
from workloads import query
from workloads.tables import load


def _lines(rows: DataFrame, head: list[str], path: str) -> None:
    """Text rows, and some lines of a head in a file of their own, below one folder."""
    top = rows.sparkSession.createDataFrame([(i, line) for i, line in enumerate(head)], "at int, value string")
    top.coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    rows.select("value").write.mode("append").text(path)


@query("""SELECT 'k' || n_regionkey AS key, n_name AS name, 'v1.' || n_nationkey AS version, count(c_custkey)::BIGINT AS total,
  'region-' || n_regionkey AS tag FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def catalog_round_trip(spark, sf_dir):
    """One dataset record per nation, collected into ``index.json`` and read back from it."""
    base, counted = scratch_path(spark, "catalog"), load(spark, sf_dir, "nation").join(
        load(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).groupBy("n_regionkey", "n_nationkey", "n_name").agg(F.count("c_custkey").alias("total"))
    key = F.concat(F.lit("k"), F.col("n_regionkey").cast("string"))
    version = F.concat(F.lit("v1."), F.col("n_nationkey").cast("string"))
    records = counted.select(key.alias("key"), version.alias("version"), F.to_json(F.struct(
        key.alias("key"), F.col("n_name").alias("name"), version.alias("version"), "total",
        F.array(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string"))).alias("tags"))).alias("value"))
    bundle.write_datasets(records, base)
    bundle.build_catalog(spark, base, f"{base}-index")
    return bundle.read_catalog(spark, f"{base}-index").select("key", "name", "version", "total", F.col("tags")[0].alias("tag"))


@query("""SELECT c_custkey::VARCHAR AS patient_id, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS group_name,
  c_nationkey::DOUBLE AS nation FROM customer""")
def annotated_scan(spark, sf_dir):
    """Customers as an annotated clinical table."""
    path = f"{scratch_path(spark, 'annotated')}.txt"
    group = F.when(F.col("c_custkey") % 7 > 0, F.col("c_mktsegment")).otherwise("NA")
    rows = load(spark, sf_dir, "customer").select(F.concat_ws(
        "\t", F.col("c_custkey").cast("string"), group, F.col("c_nationkey").cast("string")).alias("value"))
    _lines(rows, ["#Patient\tGroup\tNation", "#Id\tSegment\tKey", "#STRING\tSTRING\tNUMBER", "#1\t1\t1",
                  "PATIENT_ID\tGROUP_NAME\tNATION"], path)
    data, _ = study.convert_annotated(spark, path)
    return data.select(F.col("patient_id").cast("string").alias("patient_id"), "group_name", F.col("nation").cast("double").alias("nation"))


@query("""SELECT l_orderkey::VARCHAR AS Order_Key, l_linenumber::VARCHAR AS Line, l_shipdate::DATE::VARCHAR AS Day,
  CASE WHEN l_linenumber <> 2 THEN l_returnflag END AS Flag FROM lineitem""")
def event_scan(spark, sf_dir):
    """Line items as a tab-separated event table; empty cells are null."""
    path = f"{scratch_path(spark, 'events')}.tsv"
    load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("Order_Key"), F.col("l_linenumber").alias("Line"),
        F.col("l_shipdate").cast("date").cast("string").alias("Day"),
        F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("Flag"),
    ).write.csv(path, sep="\t", header=True)
    return study.read_matrix(spark, path).select("Order_Key", "Line", "Day", "Flag")


@query("""SELECT 'csv' AS form, p_partkey::VARCHAR AS id, p_name AS name FROM part UNION ALL
SELECT 'tsv', p_partkey::VARCHAR, p_name FROM part UNION ALL SELECT 'txt', p_partkey::VARCHAR, p_brand FROM part""")
def delimited_scan(spark, sf_dir):
    """Parts by comma, tab and blank, as their extension says."""
    part, out = load(spark, sf_dir, "part"), None
    for form, name in (("csv", "p_name"), ("tsv", "p_name"), ("txt", "p_brand")):
        path = f"{scratch_path(spark, 'parts')}.{form}"
        part.select(F.col("p_partkey").alias("id"), F.col(name).alias("name")).write.csv(
            path, sep=registry_tsv.separator(path), header=True)
        rows = registry_tsv.read_delimited(spark, path).select(F.lit(form).alias("form"), "id", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""SELECT n_nationkey, count(*)::BIGINT AS rows, sum(length(s_name))::BIGINT AS letters
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def file_contents(spark, sf_dir):
    """Suppliers as one text file per nation; files are listed, then their contents read as bytes."""
    path = scratch_path(spark, "texts")
    load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("value")).repartition(
        "nation").write.partitionBy("nation").text(path)
    listed = bundle.list_files(spark, f"{path}/nation=*/*.txt").select("path", "length")
    read = spark.read.format("binaryFile").load(f"{path}/nation=*/*.txt").select("path", "content")
    rows = read.join(listed, "path").filter(F.length("content") == F.col("length"))
    names = F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda line: line != "")
    flat = rows.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("n_nationkey"), F.explode(names).alias("name"))
    return flat.groupBy("n_nationkey").agg(F.count("*").alias("rows"), F.sum(F.length("name")).cast("long").alias("letters"))


@query("""SELECT form, floor(o_totalprice)::BIGINT || '' AS size, 'order_' || o_orderkey AS filename, o_orderpriority AS uploader,
  md5('file-' || o_orderkey) AS md5sum, CASE WHEN o_orderkey % 3 = 0 THEN 's3://b/' || o_orderkey END AS url
FROM orders, (VALUES ('csv'), ('json')) f(form)""")
def registration_scan(spark, sf_dir):
    """Registration rows from both forms of a batch file."""
    key = F.col("o_orderkey").cast("string")
    rows = load(spark, sf_dir, "orders").select(
        F.floor("o_totalprice").cast("long").cast("string").alias("size"), F.concat(F.lit("order_"), key).alias("filename"),
        F.col("o_orderpriority").alias("uploader"), F.md5(F.concat(F.lit("file-"), key).cast("binary")).alias("md5sum"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("s3://b/"), key)).alias("url"))
    folder, out = scratch_path(spark, "registrations"), None
    rows.write.csv(f"{folder}/batch.csv", header=True)
    sinks.write_json_array(rows, f"{folder}/batch.json")
    for form in ("csv", "json"):
        read = registry_tsv.read_registrations(spark, f"{folder}/batch.{form}")
        part = read.select(F.lit(form).alias("form"), "size", "filename", "uploader", "md5sum", "url")
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ the same result at every size


@query("SELECT 'c_name' AS key, c_name AS value FROM customer")
def dictionary_many_values(spark, sf_dir):
    """A dictionary lists all values of a field, however many: written as JSON of many rows and read back."""
    folder = scratch_path(spark, "names")
    load(spark, sf_dir, "customer").select("c_name").write.parquet(f"{folder}/names.parquet")
    sinks.write_dictionary(spark.read.parquet(f"{folder}/names.parquet"), f"{folder}/names_dictionary.json", per_row=100)
    return bundle.read_allowed_values(spark, f"{folder}/names_dictionary.json").select("key", "value")


_LISTED = [*range(1, 1500), 2.5]


@query("""SELECT c_custkey FROM customer WHERE (c_custkey < 1500 OR c_acctbal > 9000)
  AND NOT (c_nationkey IN (SELECT range FROM range(3, 1503))) AND c_custkey::VARCHAR IN (SELECT range::VARCHAR FROM range(1, 1500))""")
def filter_in_long(spark, sf_dir):
    """Long lists below ``or``, as ``not in``, and with mixed numbers on a text column."""
    customer = load(spark, sf_dir, "customer").withColumn("text_key", F.col("c_custkey").cast("string"))
    tree = {"operator": "and", "items": [
        {"operator": "or", "items": [
            {"field": "c_custkey", "operator": "in", "value": _LISTED}, {"field": "c_acctbal", "operator": ">", "value": 9000}]},
        {"field": "c_nationkey", "operator": "not in", "value": list(range(3, 1503))},
        {"field": "text_key", "operator": "in", "value": _LISTED},
    ]}
    return apply_filter(customer, tree).select("c_custkey")


@query("""WITH v AS (SELECT event_id, user_id % 3 AS g, CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE WHEN event_id % 13 > 0 THEN value END
  AS v FROM events)
SELECT event_id, row_number() OVER (PARTITION BY g ORDER BY v DESC NULLS LAST, event_id) AS place FROM v""")
def row_numbers_nan(spark, sf_dir):
    """Large groups with NaN and null, numbered from the highest."""
    nan = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 > 0, F.col("value"))
    rows = load(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).alias("g"), nan.alias("v"))
    return row_numbers(rows, ["g"], [("v", True), ("event_id", False)], "place", group_rows=100).select("event_id", "place")


@query("""WITH RECURSIVE nodes AS (SELECT c_custkey AS code, c_custkey - 1 AS parent FROM customer),
walk AS (SELECT code, 0::BIGINT AS depth FROM nodes WHERE code % 80 = 0
  UNION ALL SELECT n.code, depth + 1 FROM walk w JOIN nodes n ON n.parent = w.code WHERE n.code % 80 > 0)
SELECT code, depth FROM walk""")
def deep_tree(spark, sf_dir):
    """All customers in chains of 80, each the parent of the next."""
    keys = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    chain = keys.filter(F.col("code") % 80 > 0).withColumn("parent", F.col("code") - 1)
    return reshape.flatten_edges(chain, keys.filter(F.col("code") % 80 == 0)).select("code", F.col("depth").cast("long").alias("depth"))


@query("""SELECT c_nationkey AS nation, sum(strlen(c_name) + 1)::BIGINT AS size, md5(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS md5,
  sha1(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha1, sha256(string_agg(c_name || chr(10), '' ORDER BY c_name)) AS sha256
FROM customer GROUP BY c_nationkey""")
def digests_of_files(spark, sf_dir):
    """Customers as one file per nation, digested in blocks of a thousand bytes."""
    path = scratch_path(spark, "digested")
    names = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value"))
    names.repartition("nation").sortWithinPartitions("nation", "value").write.partitionBy("nation").text(path)
    found = file_digests(spark, f"{path}/nation=*/*.txt", block_bytes="1000", task_bytes="100000")
    return found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "size", "md5", "sha1", "sha256")


@query("""SELECT 'sample' AS kind, 'S' || o_orderkey AS id, 'P' || o_custkey || '|' || c_mktsegment || '|' || round(o_totalprice * 100)::BIGINT AS detail
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'event', 'S' || l_orderkey, count(*) || '|' || sum(l_quantity)::BIGINT FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'field', key, kind FROM (VALUES ('PATIENT_ID', 'STRING'), ('SAMPLE_ID', 'STRING'), ('PRICE', 'NUMBER'), ('SEGMENT', 'STRING'),
  ('Sample_Id', 'STRING'), ('Quantity', 'NUMBER')) t(k, kind), (SELECT 1), LATERAL (SELECT CASE WHEN k = 'Sample_Id' OR k = 'Quantity' THEN 'sv:' || k
  ELSE 'metadata:' || lower(k) END AS key)
UNION ALL SELECT 'value', 'metadata:segment', c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
UNION ALL SELECT 'dataset', 'demo/v0.0.3', count(*)::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey""")
def study_bundle(spark, sf_dir):
    """A whole study of customers (patients), orders (samples) and line items (events) to a bundle, its tables and dictionaries
    read back, and what the checks of bundles find in it (nothing)."""
    raw, out = f"{scratch_path(spark, 'study')}/demo", scratch_path(spark, "bundles")
    customer, orders, lines = (load(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    text = lambda *cells: F.concat_ws("\t", *[c if isinstance(c, Column) else F.col(c).cast("string") for c in cells]).alias("value")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nothing = spark.createDataFrame([], "value string")
    _lines(nothing, ["cancer_study_identifier: demo", "name: Orders: a study", "groups: a;b"], f"{raw}/meta_study.txt")
    _lines(customer.select(text(key("P", "c_custkey"), "c_mktsegment")),
           ["#Patient\tSegment", "#Id\tMarket", "#STRING\tSTRING", "#1\t1", "PATIENT_ID\tSEGMENT"], f"{raw}/data_clinical_patient.txt")
    samples = orders.join(customer.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    _lines(samples.select(text(key("P", "o_custkey"), key("S", "o_orderkey"), "o_totalprice")),
           ["#Patient\tSample\tPrice", "#Id\tId\tTotal", "#STRING\tSTRING\tNUMBER", "#1\t1\t2", "PATIENT_ID\tSAMPLE_ID\tPRICE"],
           f"{raw}/data_clinical_sample.txt")
    lines.select(key("S", "l_orderkey").alias("Sample_Id"), F.col("l_quantity").alias("Quantity")).write.csv(
        f"{raw}/data_sv.txt", sep="\t", header=True)
    _lines(nothing, ["stable_id: sv", "genetic_alteration_type: STRUCTURAL_VARIANT", "profile_description: lines"], f"{raw}/meta_sv.txt")
    path = convert.convert_study(spark, raw, out, "v0.0.3", uploader="u")
    data = bundle.Dataset(spark, out, "demo", "v0.0.3")
    row = lambda kind, name, detail: (F.lit(kind).alias("kind"), name.alias("id"), detail.alias("detail"))
    cents = F.round(F.col("price") * 100).cast("long").cast("string")
    rows = data.metadata().data.select(*row("sample", F.col("sample_id"), F.concat_ws("|", "patient_id", "segment", cents)))
    events = data.table("sv").data.groupBy("Sample_Id").agg(F.count("*").alias("n"), F.sum("Quantity").cast("long").alias("q"))
    rows = rows.unionByName(events.select(*row("event", F.col("Sample_Id"), F.concat_ws("|", F.col("n").cast("string"), F.col("q").cast("string")))))
    patterns = {f"{path}/*_dictionary.json": 1, f"{path}/datafiles/*_dictionary.json": 2}
    fields = reduce(DataFrame.unionByName, [bundle.read_dictionaries(spark, p, depth) for p, depth in patterns.items()])
    name = F.concat_ws(":", "table", "key")
    rows = rows.unionByName(fields.select(*row("field", name, F.col("data_type"))))
    values = bundle.read_allowed_values(spark, f"{path}/metadata_dictionary.json").filter("key = 'segment'")
    rows = rows.unionByName(values.select(*row("value", name, F.col("value"))))
    datasets = bundle.scan_datasets(spark, out)
    rows = rows.unionByName(datasets.select(*row("dataset", F.col("bundle"), F.col("total").cast("string"))))
    listing = bundle.bundle_listing(spark, out)
    files = listing.select("bundle", F.regexp_replace("file", r"(\.parquet|\.json|\.tsv)/[^/]+$", "$1").alias("file")).distinct()
    tables = fields.select("bundle", F.regexp_replace("table", "^metadata$", "metadata_table").alias("table")).distinct()
    columns = bundle.parquet_columns(
        bundle.list_files(spark, f"{path}/datafiles/sv.parquet").withColumn("bundle", F.lit("sv"))).groupBy("bundle").agg(F.collect_list("column").alias("columns"))
    described = tables.filter("table = 'sv'").join(columns, F.col("table") == columns["bundle"], "left").select(
        tables["bundle"], "table", F.lit("Sample_Id").alias("id_column"), "columns")
    own = fields.filter("table = 'sv'")
    flat = registry_tsv.read_flat(spark, f"{path}/datafile.tsv").withColumn("bundle", F.lit("demo/v0.0.3"))
    problems = [
        validation.incomplete_bundles(files, datasets).select("bundle", "problem"),
        validation.table_problems(described, own).select("bundle", "problem"),
        validation.unreadable_datafiles(flat).select("bundle", "problem"),
        validation.missing_columns(own.select(F.col("table").alias("bundle"), "key"), bundle.parquet_columns(
            bundle.list_files(spark, f"{path}/datafiles/sv.parquet").withColumn("bundle", F.lit("sv")))).select("bundle", F.col("key").alias("problem")),
    ]
    for found in problems:
        rows = rows.unionByName(found.select(*row("problem", F.col("bundle"), F.col("problem"))))
    return rows


@query("""SELECT 'reg.demo/' || lpad(o_orderkey::VARCHAR, 12, '0') AS guid FROM orders
ORDER BY guid LIMIT 40 OFFSET (SELECT count(*) * 3 // 4 FROM orders)""")
def guid_deep_page(spark, sf_dir):
    """A deep page over texts with a long common beginning."""
    orders = load(spark, sf_dir, "orders")
    guids = orders.select(F.concat(F.lit("reg.demo/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("guid"))
    return page_of(guids, [("guid", False)], orders.count() * 3 // 4, 40, heap_rows=10)
