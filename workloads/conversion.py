"""Type inference, dictionaries, matrices, discovery and bundle checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.functions import names
from cohortspark.operators import profile, reshape, validation
from cohortspark.operators.ordered import row_numbers
from cohortspark.session import scratch_path
from cohortspark.sources import bundle, sinks, study
from cohortspark.sources.lines import numbered_lines
from workloads import query
from workloads.tables import load

_NUMBER = "'\\s*[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?)\\s*'"

_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "flag", "empty", "dose")

_TEXTS_SQL = """texts AS (
  SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal,
         c_mktsegment, CASE c_nationkey % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'false' END AS flag, NULL::VARCHAR AS empty,
         CASE WHEN c_nationkey = 1 THEN '1d' ELSE c_nationkey || '.5' END AS dose
  FROM customer)"""

_CELLS_SQL = _TEXTS_SQL + ", cells AS (\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS key, {c} AS value FROM texts" for c in _COLUMNS
) + ")"

_TYPES_SQL = f"""{_CELLS_SQL}, types AS (
  SELECT key, CASE WHEN count(value) = 0 THEN 'STRING'
    WHEN bool_and(regexp_full_match(value, {_NUMBER})) THEN 'NUMBER'
    WHEN bool_and(value IN ('True', 'False', 'true', 'false', '0', '1')) THEN 'BOOLEAN' ELSE 'STRING' END AS data_type
  FROM cells GROUP BY key)"""


def _texts(spark, sf_dir):
    nation = F.col("c_nationkey")
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", nation.cast("string").alias("c_nationkey"),
        F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment",
        F.when(nation % 3 == 0, "True").when(nation % 3 == 1, "false").alias("flag"),
        F.lit(None).cast("string").alias("empty"),
        F.when(nation == 1, "1d").otherwise(F.concat(nation.cast("string"), F.lit(".5"))).alias("dose"),
    )


@query(f"WITH {_TYPES_SQL} SELECT key, data_type FROM types")
def infer_types(spark, sf_dir):
    return profile.infer_types(_texts(spark, sf_dir))


@query(f"""WITH {_TEXTS_SQL}
SELECT c_custkey::DOUBLE AS c_custkey, c_acctbal::DOUBLE AS c_acctbal, CASE flag WHEN 'True' THEN true WHEN 'false' THEN false
       END AS flag, empty, dose FROM texts""")
def typed_cast(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("c_custkey", "c_acctbal", "flag", "empty", "dose")
    return profile.cast_to(rows, profile.types_of(rows))


@query(f"""WITH {_TYPES_SQL}, declared AS (
  SELECT * FROM (VALUES ('c_custkey', 'STRING'), ('dose', 'NUMBER'), ('flag', 'BOOLEAN'), ('c_name', 'STRING')) t(key, declared))
SELECT key, declared, data_type AS inferred FROM types JOIN declared USING (key) WHERE declared <> data_type""")
def type_conflicts(spark, sf_dir):
    declared = spark.createDataFrame(
        [("c_custkey", "STRING"), ("dose", "NUMBER"), ("flag", "BOOLEAN"), ("c_name", "STRING")], "key string, data_type string"
    )
    return profile.type_conflicts(_texts(spark, sf_dir), declared)


_DICTIONARY_SQL = f"""{_TYPES_SQL}, v AS (
  SELECT key, value FROM cells WHERE value IS NOT NULL GROUP BY 1, 2),
d AS (
  SELECT key, count(*)::BIGINT AS value_count, min(TRY_CAST(value AS DOUBLE)) AS lo, max(TRY_CAST(value AS DOUBLE)) AS hi,
         string_agg(value, ';' ORDER BY value) AS listed FROM v GROUP BY key)"""


@query(f"""WITH {_DICTIONARY_SQL}
SELECT key, data_type, coalesce(value_count, 0)::BIGINT AS value_count, CASE WHEN data_type = 'NUMBER' THEN lo END AS minimum,
       CASE WHEN data_type = 'NUMBER' THEN hi END AS maximum, allowed_values, nullif(part, 0)::INTEGER AS part
FROM types LEFT JOIN d USING (key) LEFT JOIN (
  SELECT key, (place - 1) // 10000 AS part, string_agg(value, ';' ORDER BY place) AS allowed_values
  FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS place FROM v JOIN types USING (key) WHERE data_type <> 'NUMBER')
  GROUP BY 1, 2) lists USING (key)""")
def dictionary(spark, sf_dir):
    """Fields with all their allowed values, however many: a field of more than 10 000 goes on in rows with a ``part``."""
    rows = _texts(spark, sf_dir)
    fields = profile.dictionary(rows)
    lists = profile.value_lists(profile.dictionary_values(rows, fields))
    return fields.join(lists, F.col("key") == F.col("_key"), "left").select(
        "key", "data_type", "value_count", "minimum", "maximum", F.array_join("values", ";").alias("allowed_values"), "part")


@query(f"""WITH {_DICTIONARY_SQL}
SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS place FROM v JOIN types USING (key) WHERE data_type <> 'NUMBER'""")
def dictionary_values(spark, sf_dir):
    """The allowed values of all fields as ordered rows."""
    rows = _texts(spark, sf_dir)
    return profile.dictionary_values(rows, profile.dictionary(rows)).select("key", "value", "place")


@query(f"WITH {_CELLS_SQL} SELECT key, value, count(*)::BIGINT AS count FROM cells WHERE value IS NOT NULL GROUP BY 1, 2")
def field_values(spark, sf_dir):
    return profile.field_values(_texts(spark, sf_dir))


@query(f"""WITH {_DICTIONARY_SQL}, n AS (SELECT count(*) AS total FROM customer)
SELECT key, data_type, CASE
  WHEN data_type = 'BOOLEAN' THEN 'pie'
  WHEN data_type = 'STRING' AND c <= 6 THEN 'pie' WHEN data_type = 'STRING' AND c <= 25 THEN 'bar'
  WHEN data_type = 'STRING' AND c / total <= 0.8 AND c <= 500 THEN 'table'
  WHEN data_type = 'STRING' AND c / total > 0.8 AND c > 100 THEN 'id'
  WHEN data_type = 'NUMBER' AND c <= 50 THEN 'linechart' WHEN data_type = 'NUMBER' THEN 'histogram' ELSE 'unsupported' END AS view
FROM (SELECT key, data_type, coalesce(value_count, 0) AS c, total FROM types LEFT JOIN d USING (key), n)""")
def view_recommendation(spark, sf_dir):
    rows = _texts(spark, sf_dir)
    total = rows.agg(F.count(F.lit(1))).scalar()
    return profile.recommend_view(profile.dictionary(rows), total).select("key", "data_type", "view")


@query(f"""WITH {_TYPES_SQL}
SELECT x.key AS x, y.key AS y, CASE
  WHEN x.data_type = 'STRING' AND y.data_type = 'NUMBER' THEN 'box' WHEN x.data_type = 'NUMBER' AND y.data_type = 'NUMBER' THEN 'scatter'
  WHEN x.data_type = 'STRING' AND y.data_type = 'STRING' THEN 'summary' ELSE 'unsupported' END AS view
FROM types x JOIN types y ON y.key = 'c_acctbal' OR y.key = 'c_name'""")
def grouped_view_recommendation(spark, sf_dir):
    types = profile.infer_types(_texts(spark, sf_dir))
    x = types.select(F.col("key").alias("x"), F.col("data_type").alias("x_type"), F.explode(F.array(F.lit("c_acctbal"), F.lit("c_name"))).alias("y"))
    y = types.select(F.col("key").alias("y"), F.col("data_type").alias("y_type"))
    return x.join(y, "y").select("x", "y", profile.recommend_grouped_view(F.col("x_type"), F.col("y_type")).alias("view"))


@query("""WITH cells AS (
  SELECT 'c_acctbal' AS key, 'NUMBER' AS data_type, '[' || min(c_acctbal) || ',' || max(c_acctbal) || ']' AS allowed_values FROM customer
  UNION ALL SELECT 'c_mktsegment', 'STRING', '["' || string_agg(DISTINCT c_mktsegment, '","' ORDER BY c_mktsegment) || '"]' FROM customer
  UNION ALL SELECT 'nation', 'STRING', '["' || string_agg(DISTINCT n_name, '","' ORDER BY n_name) || '"]'
            FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT key, data_type, allowed_values, (SELECT count(*) FROM customer)::BIGINT AS stored FROM cells""")
def table_bundle(spark, sf_dir):
    """A table written as a bundle; its dictionary and row count as read back."""
    nation = load(spark, sf_dir, "nation")
    table = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_acctbal", "c_mktsegment", F.col("n_name").alias("nation")
    )
    about = spark.createDataFrame([("T", "", "", "", "sample_id")], bundle.TABLE_SCHEMA)
    folder = scratch_path(spark, "bundle")
    sinks.write_table_bundle(table, about, folder, "customers")
    fields = spark.read.schema(bundle.FIELD_SCHEMA).json(f"{folder}/customers_dictionary.json", multiLine=True)
    stored = spark.read.parquet(f"{folder}/customers.parquet").agg(F.count(F.lit(1))).scalar()
    return fields.select("key", "data_type", "allowed_values").withColumn("stored", stored)


@query(f"""WITH {_TYPES_SQL}, placed AS (
  SELECT key, row_number() OVER (ORDER BY sum(length(value)) DESC NULLS LAST, key) - 1 AS position, count(value) AS present
  FROM cells GROUP BY key)
SELECT key FROM placed WHERE CASE WHEN present > 0 THEN position ELSE 9 END <= 5 ORDER BY position LIMIT 6""")
def default_projection(spark, sf_dir):
    """Fields in the order of how much text they hold; those without a value come last in the dictionary's order."""
    cells = profile.field_values(_texts(spark, sf_dir))
    sizes = cells.groupBy("key").agg(F.sum(F.length("value") * F.col("count")).alias("size"))
    known = spark.createDataFrame([(c,) for c in _COLUMNS], "key string").join(sizes, "key", "left")
    fields = row_numbers(known.withColumn("all", F.lit(1)), ["all"], [("size", True), ("key", False)], "position").withColumn(
        "position", F.col("position") - 1).withColumn("order", F.when(F.col("size").isNotNull(), F.col("position")).otherwise(9))
    return names.default_columns(fields, limit=6)


# ------------------------------------------------------------------ matrices

_TYPES = ("click", "error", "purchase", "signup", "view")


def _matrix(spark, sf_dir):
    """Users as genes, event types as samples; the first event of a user and type is its cell."""
    rows = load(spark, sf_dir, "events").select(
        F.concat(F.lit("G"), (F.col("user_id") % 40).cast("string")).alias("Hugo_Symbol"),
        F.col("user_id").alias("Entrez_Gene_Id"),
        F.col("event_id").alias("row"),
        *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in _TYPES],
    )
    return rows.withColumn("Hugo_Symbol", F.nullif("Hugo_Symbol", F.lit("G7")))


_MATRIX_SQL = f"""m AS (
  SELECT nullif('G' || (user_id % 40), 'G7') AS gene, event_id, event_type, value FROM events),
f AS (SELECT gene, min(event_id) AS event_id FROM m WHERE gene IS NOT NULL GROUP BY gene),
long AS (
  SELECT t.s AS sample_id, f.gene AS gene_symbol, CASE WHEN m.event_type = t.s THEN m.value END AS value
  FROM f JOIN m USING (event_id), (VALUES {', '.join(f"('{t}')" for t in _TYPES)}) t(s))"""


@query(f"WITH {_MATRIX_SQL} SELECT sample_id, gene_symbol, value FROM long")
def matrix_long(spark, sf_dir):
    return reshape.matrix_long(_matrix(spark, sf_dir), "row", value_type="double")


@query(f"""WITH {_MATRIX_SQL}
SELECT sample_id, max(CASE WHEN gene_symbol = 'G1' THEN value END) AS "G1", max(CASE WHEN gene_symbol = 'G2' THEN value END) AS "G2",
       max(CASE WHEN gene_symbol = 'G39' THEN value END) AS "G39" FROM long GROUP BY sample_id""")
def matrix_wide(spark, sf_dir):
    long = reshape.matrix_long(_matrix(spark, sf_dir), "row", value_type="double")
    return reshape.matrix_wide(long, ["G1", "G2", "G39"])


@query("""SELECT event_type AS sample_id, 'U' || user_id AS gene_symbol, round(sum(value), 6) AS value FROM events GROUP BY 1, 2""")
def matrix_sums(spark, sf_dir):
    """Measurements summed per sample and gene, the long form kept for large matrices."""
    return load(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("sample_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("gene_symbol")
    ).agg(F.round(F.sum("value"), 6).alias("value"))


@query("""
SELECT upper(n_name) AS code, n_name AS name, r_name AS tissue FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'C' || c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def hierarchy_flatten(spark, sf_dir):
    """One tree per customer: a region without tissue, its nation, the customer."""
    nation, region = load(spark, sf_dir, "nation"), load(spark, sf_dir, "region")
    rows = (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )

    def node(code, name, tissue, children):
        return F.struct(code.alias("code"), name.alias("name"), tissue.alias("tissue"), children.alias("children"))

    code = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    leaf = node(code, F.col("c_name"), F.col("n_name"), F.lit(None).cast("map<string,string>"))
    inner = node(F.upper("n_name"), F.col("n_name"), F.col("r_name"), F.create_map(code, leaf))
    root = node(F.upper("r_name"), F.col("r_name"), F.lit(""), F.create_map(F.upper("n_name"), inner))
    return reshape.flatten_hierarchy(rows.select(F.to_json(root).alias("value")))


@query("""
SELECT 'R' || r_regionkey AS code, 0 AS depth FROM region
UNION ALL SELECT 'N' || n_nationkey, 1 FROM nation UNION ALL SELECT 'C' || c_custkey, 2 FROM customer""")
def hierarchy_walk(spark, sf_dir):
    def text(letter, column):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    nation, customer = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer")
    nodes = nation.select(text("N", "n_nationkey").alias("code"), text("R", "n_regionkey").alias("parent")).unionByName(
        customer.select(text("C", "c_custkey").alias("code"), text("N", "c_nationkey").alias("parent"))
    )
    return reshape.flatten_edges(nodes, load(spark, sf_dir, "region").select(text("R", "r_regionkey").alias("code")))


# ------------------------------------------------------------------ discovery and checks

_FILES_SQL = """listing AS (
  SELECT '/data/b' || (p_size) || '/datafiles/t' || (p_partkey % 50) ||
         CASE p_type WHEN 'MEDIUM' THEN '.parquet' WHEN 'SMALL' THEN '.parquet' WHEN 'LARGE' THEN '_dictionary.json'
              WHEN 'PROMO' THEN '_metadata.json' ELSE '.tsv' END AS path FROM part)"""


def _listing(spark, sf_dir):
    kind = F.col("p_type")
    ending = (
        F.when(kind.isin("MEDIUM", "SMALL"), ".parquet").when(kind == "LARGE", "_dictionary.json")
        .when(kind == "PROMO", "_metadata.json").otherwise(".tsv")
    )
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("/data/b"), F.col("p_size").cast("string"), F.lit("/datafiles/t"), (F.col("p_partkey") % 50).cast("string"), ending).alias("path")
    )


@query(f"""WITH {_FILES_SQL}, parts AS (
  SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder,
         regexp_extract(path, '/([^/]+?)(\\.parquet|_dictionary\\.json|_metadata\\.json)$', 1) AS prefix,
         regexp_extract(path, '/([^/]+?)(\\.parquet|_dictionary\\.json|_metadata\\.json)$', 2) AS suffix FROM listing)
SELECT folder, prefix, folder || '/' || prefix || '.parquet' AS parquet, folder || '/' || prefix || '_dictionary.json' AS dictionary,
       folder || '/' || prefix || '_metadata.json' AS metadata
FROM parts WHERE suffix <> '' GROUP BY 1, 2 HAVING count(DISTINCT suffix) = 3""")
def file_groups(spark, sf_dir):
    return bundle.file_groups(_listing(spark, sf_dir))


_OMICS_SQL = """listing AS (
  SELECT '/raw/s' || p_size || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'data_' ELSE 'meta_' END ||
         CASE p_type WHEN 'MEDIUM' THEN 'cna' WHEN 'SMALL' THEN 'mutations' WHEN 'LARGE' THEN 'mrna_seq_v2'
              WHEN 'PROMO' THEN 'clinical' ELSE 'sv' END || '.txt' AS path FROM part)"""


@query(f"""WITH {_OMICS_SQL}, n AS (
  SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]+$', 1) AS folder,
         regexp_extract(path, '/(data|meta)_((cna|mutation|mrna_seq|sv|methylation)[^/]*)\\.txt$', 1) AS kind,
         regexp_extract(path, '/(data|meta)_((cna|mutation|mrna_seq|sv|methylation)[^/]*)\\.txt$', 2) AS prefix FROM listing)
SELECT d.folder, d.prefix, d.path AS data_path, m.path AS meta_path FROM n d JOIN n m
  ON d.folder = m.folder AND d.prefix = m.prefix AND d.kind = 'data' AND m.kind = 'meta'""")
def omics_pairs(spark, sf_dir):
    kind = F.col("p_type")
    name = (
        F.when(kind == "MEDIUM", "cna").when(kind == "SMALL", "mutations").when(kind == "LARGE", "mrna_seq_v2")
        .when(kind == "PROMO", "clinical").otherwise("sv")
    )
    head = F.when(F.col("p_partkey") % 2 == 0, "data_").otherwise("meta_")
    listing = load(spark, sf_dir, "part").select(
        F.concat(F.lit("/raw/s"), F.col("p_size").cast("string"), F.lit("/"), head, name, F.lit(".txt")).alias("path")
    )
    return study.omics_pairs(listing.distinct())


@query("""WITH lines AS (
  SELECT page_id, unnest(string_split(html, '<')) AS value, generate_subscripts(string_split(html, '<'), 1) AS line
  FROM pages),
pairs AS (
  SELECT page_id, trim(split_part(trim(value, ' '), ':', 1), ' ') AS key, line,
         trim(substr(trim(value, ' '), strpos(trim(value, ' '), ':') + 1), ' ') AS value
  FROM lines WHERE contains(value, ':'))
SELECT page_id AS file, key, max_by(value, line) AS value FROM pairs GROUP BY 1, 2""")
def key_values(spark, sf_dir):
    """The pieces of all pages that have a colon, as key: value pairs."""
    lines = load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file"), F.posexplode(F.split("html", "<")).alias("line", "value")
    )
    return study.key_values(lines)


_DICT_SQL = """fields AS (
  SELECT 'bundle_' || p_size AS bundle, CASE WHEN p_partkey % 90 = 0 THEN 'sample_id' WHEN p_retailprice > 1050 THEN p_name
         ELSE lower(p_type) END AS key, CASE p_brand WHEN 'Brand#1' THEN 'INTEGER' ELSE 'STRING' END AS data_type FROM part)"""


def _fields(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 90 == 0, "sample_id").when(F.col("p_retailprice") > 1050, F.col("p_name")).otherwise(F.lower("p_type"))
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("bundle_"), F.col("p_size").cast("string")).alias("bundle"), key.alias("key"),
        F.when(F.col("p_brand") == "Brand#1", "INTEGER").otherwise("STRING").alias("data_type"),
    )


@query(f"""WITH {_DICT_SQL}
SELECT b.bundle, r.key FROM (SELECT DISTINCT bundle FROM fields) b, (VALUES ('sample_id'), ('promo'), ('economy')) r(key)
WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.bundle = b.bundle AND f.key = r.key)""")
def required_fields(spark, sf_dir):
    return validation.missing_fields(_fields(spark, sf_dir), ["sample_id", "promo", "economy"])


@query(f"""WITH {_DICT_SQL}, cols AS (SELECT 'bundle_' || p_size AS bundle, lower(p_type) AS col FROM part WHERE p_retailprice < 1000)
SELECT DISTINCT bundle, key FROM fields f WHERE NOT EXISTS (SELECT 1 FROM cols c WHERE c.bundle = f.bundle AND c.col = f.key)""")
def dictionary_columns(spark, sf_dir):
    columns = load(spark, sf_dir, "part").filter(F.col("p_retailprice") < 1000).select(
        F.concat(F.lit("bundle_"), F.col("p_size").cast("string")).alias("bundle"), F.lower("p_type").alias("column")
    )
    return validation.missing_columns(_fields(spark, sf_dir), columns)


@query(f"""WITH {_DICT_SQL}
SELECT bundle, key, data_type, CASE WHEN NOT regexp_full_match(key, '[a-z][a-z0-9_]*') THEN 'invalid key' ELSE 'invalid data_type' END AS problem
FROM fields WHERE NOT regexp_full_match(key, '[a-z][a-z0-9_]*') OR data_type NOT IN ('STRING', 'NUMBER', 'BOOLEAN')""")
def dictionary_rules(spark, sf_dir):
    return validation.rule_violations(_fields(spark, sf_dir))


_BUNDLE_SQL = """files AS (
  SELECT DISTINCT lower(replace(p_brand, '#', '_')) || '/v' || p_size AS bundle,
         CASE p_type WHEN 'MEDIUM' THEN 'metadata_table.parquet' WHEN 'SMALL' THEN 'metadata_dictionary.json' WHEN 'LARGE' THEN 'dataset.json'
              WHEN 'PROMO' THEN 'datafile.tsv' ELSE 'datafiles/x.parquet' END AS file FROM part),
keys AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) || '/v' || p_size AS bundle,
         CASE WHEN p_size = 3 THEN 'other' ELSE lower(replace(p_brand, '#', '_')) END AS key FROM part)"""


@query(f"""WITH {_BUNDLE_SQL}
SELECT b.bundle, 'missing ' || e.file AS problem FROM (SELECT DISTINCT bundle FROM files) b,
  (VALUES ('metadata_table.parquet'), ('metadata_dictionary.json'), ('dataset.json'), ('datafile.tsv')) e(file)
WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.bundle = b.bundle AND f.file = e.file)
UNION ALL SELECT DISTINCT bundle, 'no datafile table' FROM files
WHERE bundle NOT IN (SELECT bundle FROM files WHERE file LIKE 'datafiles/%.parquet')
UNION ALL SELECT bundle, 'key does not match directory' FROM keys WHERE key <> split_part(bundle, '/', 1)""")
def bundle_completeness(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    key = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    name = F.concat(key, F.lit("/v"), F.col("p_size").cast("string")).alias("bundle")
    kind = F.col("p_type")
    file = (
        F.when(kind == "MEDIUM", "metadata_table.parquet").when(kind == "SMALL", "metadata_dictionary.json")
        .when(kind == "LARGE", "dataset.json").when(kind == "PROMO", "datafile.tsv").otherwise("datafiles/x.parquet")
    )
    keys = part.select(name, F.when(F.col("p_size") == 3, "other").otherwise(key).alias("key")).distinct()
    return validation.incomplete_bundles(part.select(name, file.alias("file")), keys)


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' ||
  CASE WHEN n_regionkey = 2 THEN 'null' ELSE n_regionkey::VARCHAR END || '}' AS json FROM nation""")
def rows_as_json(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").withColumn("n_regionkey", F.nullif("n_regionkey", F.lit(2)))
    return sinks.rows_as_json(rows)


@query("""
WITH n AS (
  SELECT c_custkey, c_acctbal, (c_custkey - 1) // 1000 AS band, c_custkey % 97 = 0 AS broken,
         row_number() OVER (PARTITION BY (c_custkey - 1) // 1000 ORDER BY c_custkey) AS line FROM customer)
SELECT band::INTEGER AS band, line::BIGINT AS line,
       CASE WHEN broken THEN 'cannot be parsed;balance below zero' ELSE 'balance below zero' END AS reasons
FROM n WHERE broken OR c_acctbal < 0""")
def line_rejects(spark, sf_dir):
    """Customers as delimited files of a thousand each, read back with line numbers; every bad line with its reasons."""
    customers = load(spark, sf_dir, "customer").withColumn("band", F.expr("(c_custkey - 1) div 1000"))
    balance = F.when(F.col("c_custkey") % 97 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    path = scratch_path(spark, "customer-lines")
    customers.select("band", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), balance).alias("value")) \
        .repartition("band").sortWithinPartitions("band", "c_custkey").drop("c_custkey").write.partitionBy("band").text(path)
    lines = numbered_lines(spark, f"{path}/*/*.txt")
    found = validation.check_lines(lines, "c_custkey long, c_acctbal double", {"balance below zero": F.col("c_acctbal") >= 0}, header=False)
    band = F.regexp_extract("file", r"/band=(\d+)/", 1).cast("int").alias("band")
    return found.select(band, "line", F.concat_ws(";", "reasons").alias("reasons"))
