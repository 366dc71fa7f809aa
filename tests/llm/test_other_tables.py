"""Nearest neighbours, chat formatting and archives."""

import base64
import gzip
import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import chat, neighbour_search, queries, warc

# ---- 4 ----


def brute_neighbours(rows, queries_, k=10):
    out = {}
    for q in queries_:
        x = np.array(rows[q])
        scored = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = scored[:k]
    return out


def test_neighbours_reach_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((8, 32))
    vectors = {i: (centres[i % 8] + 0.4 * rng.standard_normal(32)).astype(np.float32).astype(float).tolist() for i in range(4000)}
    vectors.update({i: vectors[17] for i in range(4000, 5200)})  # one very common vector
    table = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    asked = [i for i in vectors if i % 100 == 0]
    got = {}
    for r in neighbour_search.search(table, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = brute_neighbours(vectors, asked)
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        hits += len({r[2] for r in rows} & {i for _, i in want[q]})
    assert hits / (10 * len(asked)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (100, [1.0, 0.0]), (200, [])]
    table = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, id string")
    got = [tuple(r) for r in neighbour_search.search(table, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect()]
    far = float(np.sqrt(5.0))
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, far), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, far)]
    assert neighbour_search.search(table.limit(0), F.col("id") % 100 == 0).collect() == []


def test_chi_square_quantile():
    assert abs(neighbour_search.chi_square_quantile(0.95, 8) - 15.507313) < 1e-5


# ---- 9 ----

CONTROL = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    said = [CONTROL, "", None, "a\\b\\\\l\\h <image:1.1> ###\n</turn>\n### x: y", "é" * 3000, "\\", "#", "<", "\\n\\c:"]
    rows = [(c, t, r, said[(c + t) % len(said)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", None, "as:s\n"])]
    rows += [(None, 0, "assistant", "no id"), (3, None, "user", "no turn"), (3, 2, "assistant", "tied")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("z"))
    done = chat.format_chat(table.withColumn("parts", chat.text_part(F.col("text"))))
    got = {r.conv_id: r for r in done.select("conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
                                             chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [r[2:] for r in own]
        assert got[conv].loss == [r[3] for r in own if r[2] == "assistant"]
        assert got[conv].formatted.count("</turn>") == len(own) == got[conv].formatted.count("### ")


def test_chat_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,units:double>>"
    rows = [(1, 0, "user", [("text", "see <this>", None, None), ("image", None, "s3://a/1", 4.0), ("audio", None, "b", 2.5)]),
            (1, 1, "assistant", [(None, "ok", None, None), ("document", None, "c", None)]), (1, 2, "user", None)]
    row = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")).first()
    assert row.formatted == "### user: see \\lthis><image:1.2><audio:1.3></turn>\n### assistant: ok<document:2.2></turn>\n### user: </turn>\n"
    assert [tuple(a) for a in row.attachments] == [("image", "s3://a/1", 1024, 1, 2), ("audio", "b", 63, 1, 3), ("document", "c", 700, 2, 2)]
    assert row.expanded_tokens == 2 + 1024 + 63 + 1 + 700
    start, length = row.loss_spans[0]
    assert row.formatted[start:start + length] == "ok<document:2.2>"


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(empty.withColumn("parts", chat.text_part(F.col("text")))).collect() == []


# ---- 10 ----


@pytest.fixture
def pages(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/\r\nx", "same"), (9, None, "same"), (1, "http://c/", None), (2, "http://d/", ""),
            (4, "é", "ünï" * 50_000), (7, "http://e/", "WARC/1.1\r\n\r\n\x1f\x8b"), (3, "http://b/\r\nx", "same"), (None, "n", "same")]
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, payload string, date string")


def archived(spark, pages, path, **options):
    warc.register(spark)
    warc.crawl_records(pages).repartition(3).write.format("warc").options(**options).mode("append").save(path)
    return spark.read.format("warc").load(path)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 28])
def test_warc_round_trip(spark, pages, tmp_path, archive_bytes):
    read = archived(spark, pages, f"{tmp_path}/w", archive_bytes=archive_bytes)
    rows = read.collect()
    assert len(rows) == 9
    key = lambda urn: int(urn[len("<urn:x-page:"):-1]) if urn else None
    source = {r.page_id: r.html or "" for r in pages.collect()}
    for r in rows:
        page = key(r.record_id)
        data = source[page].encode()
        assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload_bytes == len(data) and (r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data)
    revisits = sorted((key(r.record_id), key(r.refers_to)) for r in rows if r.record_type == "revisit")
    assert revisits == [(2, 1), (5, 3), (9, 3)]
    assert [r.record_type for r in rows if r.record_id is None] == ["response"]
    assert {r.target_uri for r in rows if r.record_id and key(r.record_id) == 3} == {"http://b/%0D%0Ax"}


def test_warc_predicates_and_skipping(spark, pages, tmp_path, monkeypatch):
    archived(spark, pages, f"{tmp_path}/w")
    read = spark.read.format("warc").option("payload", "false").load(f"{tmp_path}/w")
    assert read.where("record_type = 'revisit'").count() == 3 and read.where("payload IS NOT NULL").count() == 0
    decoded = []
    monkeypatch.setattr(warc, "_payload", lambda head, block: decoded.append(1) or block)
    reader = warc.WarcReader({"path": f"{tmp_path}/w"})
    assert list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload_bytes",), 4)])) != []
    batches = [b for part in reader.partitions() for b in reader.read(part)]
    assert sum(b.num_rows for b in batches) == 3 and not decoded


def test_warc_of_others(spark):
    """Plain archives and gzip members without stored lengths, also with a record type of another kind."""
    def record(kind, body, extra=b""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{kind}>\r\nContent-Length: {len(body)}\r\n".encode()
        return head + extra + b"\r\n" + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    records = [record("warcinfo", b"software: x"), record("response", http, b"Content-Type: application/http; msgtype=response\r\n"),
               record("resource", b"")]
    for data in (b"".join(records), b"".join(map(gzip.compress, records))):
        handle = pa.PythonFile(io.BytesIO(data), mode="r")
        rows = list(warc.read_archive(handle, lambda row: True))
        assert [(r["record_type"], r["payload"]) for r in rows] == [("warcinfo", b"software: x"), ("response", b"hello"), ("resource", b"")]
        handle = pa.PythonFile(io.BytesIO(data), mode="r")
        rows = list(warc.read_archive(handle, lambda row: row["record_type"] == "resource"))
        assert [r["record_id"] for r in rows] == ["<urn:x:resource>"]


def test_warc_reads_only_committed(spark, pages, tmp_path):
    read = archived(spark, pages, f"{tmp_path}/w")
    (tmp_path / "w" / "part-999-lost.warc.gz").write_bytes(b"\x1f\x8b broken")
    assert read.count() == 9 and spark.read.format("warc").load(f"{tmp_path}/w").count() == 9
    with pytest.raises(Exception, match="already holds archives"):
        archived(spark, pages, f"{tmp_path}/w")


def test_warc_small_payloads_are_responses(spark, pages):
    kinds = {r.record_id: r.record_type for r in warc.crawl_records(pages, least_bytes=5).collect()}
    assert set(kinds.values()) == {"response"}
    assert warc.crawl_records(pages.limit(0)).collect() == []


def test_registered_queries_agree_with_sql(spark):
    from check_oracle import compare

    for name in queries.ORACLES:
        result, _ = compare(spark, "/root/testdata/sf0.001", name)
        assert result.startswith("ok"), result
