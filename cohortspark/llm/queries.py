"""The registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import (
    chat, hard_negatives, minhash, mixing, neighbour_search, neighbours, packing, prefix_trie, quality, recompress, sharding,
    simhash, suffix, warc,
)
from cohortspark.llm.common import table, text_or_empty, words_of  # noqa: F401
from cohortspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def tokenizer_path() -> str:
    """The vocabulary that the packing query takes; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(2 * length(text) - length(replace(replace(replace(text, '\\', ''), '<', ''), '#', ''))
       + length(role) + 14) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
""")
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, then read everything back from the formatted text and its loss spans."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chat(rows.withColumn("parts", chat.text_part(F.col("text"))))
    turns = done.withColumn("_turns", chat.read_turns(F.col("formatted"))).withColumn(
        "_loss", F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), ""))
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p GROUP BY d)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(p.d, CAST(i * 5 + 1 AS INT), 5) AS INT) >> s) & 31) + 1,
      1)), 'string_agg', '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f ON p.d = f.d
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archives, then read them back; length and digest of responses come from the payloads read."""
    warc.register(spark)
    folder = scratch_path(spark, "warc")
    warc.crawl_records(table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    read = spark.read.format("warc").load(folder).where(F.col("record_type").isin("response", "revisit"))
    response = F.col("record_type") == "response"
    return read.select(
        warc.key_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, warc.base32_of_hex(F.sha1("payload")))
        .otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        warc.key_of(F.col("refers_to")).alias("refers_to"),
    )


@query()
def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents meet the next one once, with its text and fingerprint; a document without an id has no next one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    starts = neighbours.range_starts(docs, "doc_id")
    known = docs.withColumn("fp", minhash.fingerprint(F.col("text")))
    met = neighbours.with_next(known, "doc_id", {"text": "next_text", "fp": "next_fp"}, starts)
    alone = known.where("doc_id IS NULL").withColumns({
        "next_text": F.lit(None).cast("string"), "next_fp": F.lit(None).cast("array<bigint>")})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    rows = met.unionByName(alone).select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    rows = rows.select("*", minhash.fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        minhash.as_text(F.col("fp")).alias("fingerprint"),
        minhash.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        minhash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        minhash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


@query("""
WITH RECURSIVE units AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
totals AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS total, count(*) AS units FROM units GROUP BY source),
shares AS (SELECT list_sort(list(total / (SELECT sum(total) FROM totals))) AS ps FROM totals WHERE total > 0),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1,
    CASE WHEN list_max(list_transform(ps, lambda p: pow(p, (low + high) / 2 - 1)))
      <= 1.25 * list_min(list_transform(ps, lambda p: pow(p, (low + high) / 2 - 1))) THEN low ELSE (low + high) / 2 END,
    CASE WHEN list_max(list_transform(ps, lambda p: pow(p, (low + high) / 2 - 1)))
      <= 1.25 * list_min(list_transform(ps, lambda p: pow(p, (low + high) / 2 - 1))) THEN (low + high) / 2 ELSE high END
  FROM bisect, shares WHERE i < 50),
found AS (SELECT round(max_by(high, i), 9) AS a FROM bisect),
whole AS (
  SELECT a, (SELECT sum(total) FROM totals) AS everything, list_sum(list_transform(ps, lambda p: pow(p, a))) AS s,
    list_min(list_transform(ps, lambda p: pow(p, a - 1))) AS least FROM found, shares),
quotas AS (
  SELECT source, total, units, everything * s / least AS size,
    round(pow(total / everything, a) / s, 12) * (everything * s / least) AS quota FROM totals, whole),
plans AS (
  SELECT source, CAST(total AS BIGINT) AS total, size,
    CAST(CASE WHEN abs(quota / total - round(quota / total)) < 1e-9 THEN round(quota / total) * total
      ELSE floor(quota) END AS BIGINT) AS quota FROM quotas),
epochs AS (
  SELECT doc_id, u.source, tokens, total, quota, size, unnest(range(0, CAST(ceil(quota / total) AS BIGINT))) AS epoch
  FROM units u JOIN plans p ON u.source = p.source),
ordered AS (
  SELECT *, CAST('0x' || substr(md5('0:' || epoch || ':' || doc_id), 1, 15) AS BIGINT) AS o FROM epochs),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch ORDER BY o, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM ordered),
placed AS (
  SELECT *, least(greatest(1, ceil(size / 1000000)) - 1,
    floor((epoch * total + e - tokens) * greatest(1, ceil(size / 1000000)) / quota)) AS block
  FROM summed WHERE epoch < quota // total OR e <= quota - (quota // total) * total)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block,
  row_number() OVER (PARTITION BY block ORDER BY o, doc_id, epoch) - 1 AS place FROM placed
""")
def op2_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "tokens", F.col("epoch").cast("long").alias("epoch"), "block", "place")


@query()
def op4_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


@query()
def op3_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


@query()
def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(table(spark, sf_dir, "documents"))


@query("""
WITH r AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, vec_id, F.col("embedding"), moved)


@query("""
WITH RECURSIVE bits AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
rows_ AS MATERIALIZED (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, md5(coalesce(text, '')) AS g,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, bits),
groups_ AS MATERIALIZED (SELECT g, CAST(sum(size) AS BIGINT) AS s, min(doc_id) AS first FROM rows_ GROUP BY g),
queue AS MATERIALIZED (SELECT s, row_number() OVER (ORDER BY s DESC, first) AS n FROM groups_),
dealing AS (
  SELECT 0::BIGINT AS n, 0::BIGINT AS s, 0::BIGINT AS shard, list_transform(range(40), lambda i: 0::BIGINT) AS loads
  UNION ALL
  SELECT q.n, q.s, list_position(loads, list_min(loads)) - 1,
    list_transform(loads, lambda l, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN l + q.s ELSE l END)
  FROM dealing d JOIN queue q ON q.n = d.n + 1),
dealt AS (SELECT s, shard, row_number() OVER (PARTITION BY s ORDER BY shard) AS k FROM dealing WHERE n > 0),
placed AS (SELECT g, s, row_number() OVER (PARTITION BY s ORDER BY first) AS k FROM groups_)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law,
  CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM rows_ JOIN placed USING (g) JOIN dealt USING (s, k)
""")
def op12_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("""
WITH own AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''),
      lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, n, role, text FROM ids i JOIN own o ON o.conv_id = i.base AND n <= h
  UNION ALL SELECT i.conv_id, 1, n, role, text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND n > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d, role, text FROM rebuilt),
paths AS MATERIALIZED (
  SELECT conv_id, d, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM turns
  UNION ALL SELECT conv_id, 0, [] FROM ids),
sizes AS (SELECT conv_id, max(d) AS size FROM paths GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT path, min(p.conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (d = size), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN min(d) = 0 THEN 0 ELSE len(regexp_extract_all(path[-1].t, '[^\x20\x09-\x0D]+')) END AS saved
  FROM paths p JOIN sizes s ON p.conv_id = s.conv_id GROUP BY path),
children AS (SELECT path[:-2] AS above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS MATERIALIZED (SELECT v.*, coalesce(c.n, 0) AS n_children FROM nodes v LEFT JOIN children c ON c.above = v.path)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, any_value(p.conv_id) AS parent_conv_id, any_value(v.n_convs) AS n_convs,
  CAST(any_value(v.n_children) AS BIGINT) AS n_children, count(*) FILTER (u.n_children = 0) AS n_leaves,
  CAST(sum(u.saved) AS BIGINT) AS saved_tokens, any_value(v.ends_sha256) AS ends_sha256
FROM known v JOIN known u ON u.depth >= v.depth AND u.path[:v.depth] = v.path
  LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.path = v.path[:-2]
GROUP BY v.conv_id, v.depth
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
