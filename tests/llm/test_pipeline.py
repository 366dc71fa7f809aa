"""Every stage of the pipeline against a brute-force version over its own input."""

import re
import zlib

import pytest

import corpus_pipeline
from cohortspark.llm import mixing, packing, quality, queries
from cohortspark.llm.common import table, written
from tests.llm.test_documents import check_packing
from tests.llm.test_near_copies import brute_copies
from tests.llm.test_repeats import removed_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs = written(stage(spark, docs, SF), f"test-{name}")
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_stage(stages, spark):
    scored = quality.classify(stages["documents"], table(spark, SF, "labels"))
    assert set(rows_of(stages["quality"])) == {r.doc_id for r in scored.where("predicted = 1").collect()}
    good = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    kept = set(rows_of(stages["quality"]))
    right = [int(d in kept) == q for d, q in good.items()]
    assert sum(right) / len(right) > 0.9


def test_near_dedup_stage(stages):
    """All pairs by the likeness of their five-word shingles, then the first document of every linked group."""
    before = rows_of(stages["quality"])
    groups = brute_copies({d: r.text for d, r in before.items()})
    assert len(set(groups.values())) < len(before)
    assert set(rows_of(stages["near_dedup"])) == set(groups.values())


def test_substring_stage(stages):
    before, after = rows_of(stages["near_dedup"]), rows_of(stages["substring_dedup"])
    assert set(before) == set(after)
    want = {r[0]: r for r in removed_bytes([(d, r.text) for d, r in before.items()])}
    for d, row in after.items():
        lost = len(before[d].text.encode()) - len(row.text.encode())
        assert row.n_chars == len(row.text) and lost <= want[d][2]
        assert want[d][2] - lost <= 6 * want[d][3]  # characters cut at the ends of a run stay


def test_mix_stage(stages):
    before, after = rows_of(stages["substring_dedup"]), stages["mix"].collect()
    times = {}
    for r in after:
        assert r == before[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) == set(before) and max(times.values()) <= 2
    tokens = {}
    for r in after:
        tokens.setdefault(r.source, [0, 0])[0] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in before.values():
        tokens[r.source][1] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(once <= mixed <= mixing.MAX_REPEATS * once + 1 for mixed, once in tokens.values())


def test_pack_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = sorted(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages["mix"].collect())
    rows = stages["pack"].collect()
    check_packing(rows, packing.CAPACITY)
    assert sum(r.length for r in rows) == sum(want) and sum(r.start == 0 for r in rows) == len(want)


def test_run_gives_the_last_stage(stages, spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    want = stages["pack"].select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns, with names that are no identifiers or that stages use themselves, pass all stages but the last."""
    from pyspark.sql import functions as F

    names = ["my col", "a:b", "a-b", "x`y", "dot.ted", "rest", "z", "kept", "spans", "covered", "left", "start", "end", "anchor",
             "kind", "context", "_doc", "_key", "_row", "node", "group", "text_key", "component_id", "bucket", "block", "stays"]
    docs = table(spark, SF, "documents").where("doc_id < 60")
    docs = docs.select("*", *[F.col("doc_id").cast("string").alias(n) for n in names], F.struct("lang", "source").alias("a struct"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, SF), f"named-{name}")
        assert out.columns == docs.columns, name
    rows = out.select("doc_id", "lang", *[F.col(f"`{n.replace('`', '``')}`") for n in names], F.col("`a struct`.lang").alias("inner")).collect()
    assert rows and all(r.inner == r.lang and all(r[2 + i] == str(r.doc_id) for i in range(len(names))) for r in rows)
