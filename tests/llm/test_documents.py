"""Fingerprints, near-duplicate groups, mixing, packing and quality against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortspark.llm import common, components, minhash, mixing, neighbours, packing, quality, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall(text or "")
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)] or ([tuple(words)] if words else [])


def jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / len(a | b) if a | b else 1.0


# ---- 1 ----


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    return path


def test_fingerprints(spark, folder, odd_documents):
    got = {r.doc_id: r for r in queries.QUERIES["op1_minhash"](spark, folder).collect()}
    rows = sorted(odd_documents)
    assert len(got) == len(rows)
    errors = []
    for at, (doc_id, text, *_) in enumerate(rows):
        text, following = text or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = got[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [row.near_edited - jaccard(text, edited), row.near_next - jaccard(text, following)]
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
    assert max(map(abs, errors)) < 0.16 and abs(sum(errors) / len(errors)) < 0.01
    by_text = {}
    for doc_id, text, *_ in odd_documents:
        by_text.setdefault(tuple(WORD.findall(text or "")), set()).add(got[doc_id].fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())


def test_next_row_over_many_ranges(spark):
    ids = [3, 3, 7, 10, 11, 500, 501, 900000000000, -5, -4]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "none")], "id long, v string").repartition(3)
    want = sorted(ids)
    for size in (1, 2, 3, 100):
        starts = neighbours.range_starts(rows, "id", size)
        got = neighbours.with_next(rows, "id", {"v": "following"}, starts).orderBy("id").collect()
        assert [r.following for r in got] == [f"t{i}" for i in want[1:] + want[:1]]


def test_fingerprint_plans_have_no_python(spark, folder):
    for name in ("op1_minhash", "op2_temperature_mix"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_awkward_fingerprints(spark, awkward, no_documents, tmp_path):
    awkward.write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = queries.QUERIES["op1_minhash"](spark, f"{tmp_path}/a").collect()
    assert len(rows) == awkward.count()
    assert all((r.near_next is None) == (r.doc_id is None) for r in rows)
    no_documents.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert queries.QUERIES["op1_minhash"](spark, f"{tmp_path}/b").collect() == []


# ---- 6 ----


def brute_simhash(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    hashes = [xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles(lowered, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    ids = sorted(values)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            least = min(label[j] for j in ids if (values[i] ^ values[j]).bit_count() <= radius)
            if least < label[i]:
                label[i], changed = least, True
    return label


def test_simhash_groups(documents, odd_documents):
    values = {r[0]: brute_simhash(r[1]) for r in odd_documents}
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == values
    assert {i: r.component_id for i, r in got.items()} == brute_components(values)


@pytest.mark.parametrize("bucket_rows", [130, 2048])
def test_covering_family_loses_no_pair(spark, bucket_rows):
    """Clusters around two centres, also with buckets so small that they are dealt out again."""
    rng = np.random.default_rng(1)
    values = []
    for _ in range(2):
        centre = int(rng.integers(0, 1 << 63))
        values += [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(450)]
    table = {i: v for i, v in enumerate(values)}
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in table.items()]
    fps = spark.createDataFrame(signed, "doc_id long, fp long")
    groups = {r.fp: r.component_id for r in simhash.near_groups(fps, bucket_rows=bucket_rows).collect()}
    assert {i: groups[fp] for i, fp in signed} == brute_components(table)


def test_masks_cover():
    rng = np.random.default_rng(5)
    for level in range(3):
        family = [m % (1 << 64) for m in simhash.masks(3, level)]
        for _ in range(500):
            apart = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(apart & m == 0 for m in family)


def test_one_of_each(awkward, no_documents):
    kept = simhash.one_of_each(awkward, simhash.near_duplicates(awkward))
    assert kept.columns == awkward.columns
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 2
    groups = simhash.near_duplicates(awkward).where("doc_id IS NOT NULL").collect()
    assert set(ids) == {r.component_id for r in groups}
    assert simhash.near_duplicates(no_documents).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (299, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 2 ----


def brute_weights(totals, max_repeats):
    share = {s: t / sum(totals.values()) for s, t in totals.items() if t}
    low, high = 0.0, 1.0
    for _ in range(50):
        a = (low + high) / 2
        per = [p ** (a - 1) for p in share.values()]
        low, high = (low, a) if max(per) <= max_repeats * min(per) else (a, high)
    a = round(high, 9)
    total = sum(p ** a for p in share.values())
    return a, {s: p ** a / total for s, p in share.items()}


def test_mixture(documents, odd_documents):
    totals, tokens = Counter(), {}
    for doc_id, text, _, source, _ in odd_documents:
        tokens[doc_id] = len(WORD.findall(text or ""))
        totals[source] += tokens[doc_id]
    a, weights = brute_weights(totals, 1.25)
    units = common.written(mixing.units(documents), "units")
    found = {r.source: r for r in mixing.weights(units).collect()}
    for source, weight in weights.items():
        assert math.isclose(found[source].weight, weight, rel_tol=1e-8) and math.isclose(found[source].exponent, a)
    rows = mixing.mixture(documents, block_tokens=500).collect()
    per = Counter()
    for r in rows:
        per[r.source] += r.tokens
    for source, r in found.items():
        assert r.quota - max(tokens.values()) <= per[source] <= r.quota and r.quota <= 1.2501 * r.total
    times = Counter(r.doc_id for r in rows)
    assert set(times) == set(tokens) and set(times.values()) <= {1, 2}
    places = {}
    for r in rows:
        places.setdefault(r.block, []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) > 5


def test_mixture_of_a_budget_and_entropy(documents):
    units = common.written(mixing.units(documents), "units")
    rows = mixing.weights(units, max_repeats=None, target_entropy=0.98, budget=3000).collect()
    weights = [r.weight for r in rows if r.weight]
    entropy = -sum(w * math.log(w) for w in weights)
    assert entropy >= 0.98 * math.log(len(weights)) - 1e-9 and sum(r.quota for r in rows) <= 3000
    assert rows[0].exponent == 1.0 or entropy <= 0.98 * math.log(len(weights)) + 1e-6
    taken = mixing.mixture(documents, max_repeats=None, target_entropy=0.98, budget=3000).agg(F.sum("tokens")).first()[0]
    assert taken <= 3000


@pytest.mark.parametrize("piece_rows", [1, 7, 1000])
def test_pieces_of_running_totals_change_nothing(documents, piece_rows):
    units = common.written(mixing.units(documents), "units")
    weights = common.written(mixing.weights(units), "weights")
    rows = [sorted(map(tuple, mixing.mix(units, weights, block_tokens=500, piece_rows=n).collect()), key=str)
            for n in (piece_rows, 500)]
    assert rows[0] == rows[1]


def test_realised_mixture(awkward, no_documents):
    rows = mixing.mixture(awkward)
    out = mixing.realise(awkward, rows)
    assert out.columns == awkward.columns
    times = {(r.doc_id, r.source, r.text_key): 0 for r in rows.collect()}
    for r in rows.collect():
        times[r.doc_id, r.source, r.text_key] += r.copies
    assert out.count() == sum(times.values()) and len(times) == awkward.count() - 1
    assert mixing.realise(no_documents, mixing.mixture(no_documents)).collect() == []


# ---- 7 ----


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("table", ["documents", "awkward"])
@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(request, table, capacity):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), capacity):
            part = ids[i:i + capacity]
            want.append((r.doc_id, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.pack(docs, queries.tokenizer_path(), capacity).collect()
    assert sorted((r[:5] for r in map(tuple, rows)), key=str) == sorted(want, key=str)
    used = check_packing(rows, capacity)
    least = -(-sum(r.length for r in rows) // capacity)
    assert least <= used <= 1.02 * least + 2


def test_packing_nothing(no_documents):
    assert packing.pack(no_documents, queries.tokenizer_path()).collect() == []


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    for capacity, top in ((100, 100), (100, 30), (4096, 4096), (10, 10)):
        counts = {int(k): int(rng.integers(1, 200)) for k in rng.integers(1, top + 1, 40)}
        used = Counter()
        for times, items in packing.plan(counts, capacity):
            assert times > 0 and sum(k * n for k, n in items) <= capacity
            for k, n in items:
                used[k] += times * n
        assert used == Counter(counts)


def test_two_for_one():
    """Greedy fill gives 6 + 3 of 10; the pair 2 + 2 fits the gap of 4 that the 3 leaves."""
    made = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert made[0] == (1, [(6, 1), (2, 2)])


def test_tokens_of_odd_words():
    texts = ["It's <|endoftext|>x ΑΣ ὈΔΥΣΣΕΎΣ İx é ﬁ we'll 12a3 \x1c b\x85c 'S !'d ~", "", " \t", "ÇA×B µ ªº ÿß", "a\x0bb", "\u00a0x\u2003y"]
    import pyarrow as pa

    tokens = packing.WordTokens(queries.tokenizer_path())
    ids, counts = tokens(pa.array(texts))
    want = [e.ids for e in tokens.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


# ---- 8 ----


def test_discriminant(spark):
    rng = np.random.default_rng(0)
    good = ["".join(f"{''.join(rng.choice(list('abcdefgh'), rng.integers(2, 8)))} " for _ in range(rng.integers(20, 200))) for _ in range(300)]
    bad = [f"{'SPAM!! ' * int(rng.integers(10, 90))}{g[:200]}" for g in good[:120]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(1000, None), (1001, ""), (None, "x")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 300)) for i in range(420)] + [(1, None), (2, 7), (None, 1), (5, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    out = [r for r in rows if r.held_out and r.doc_id < 420]
    assert len(out) > 50 and sum(r.predicted == (r.doc_id < 300) for r in out) / len(out) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    # labels of the held-out fold change nothing
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {(r.doc_id, r.score) for r in quality.classify(docs, other).collect()} == {(r.doc_id, r.score) for r in rows}
    kept = quality.keep_good(docs.withColumn("label", F.lit("z")), labels).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_discriminant_without_classes(spark, documents, no_documents):
    one = spark.createDataFrame([(3, 1), (6, 1)], "doc_id long, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(documents, one).collect()} == {1.0}
    assert {r.score for r in quality.classify(documents, none).collect()} == {0.5}
    assert quality.classify(no_documents, one).collect() == []


def test_discriminant_equals_plain_numpy(spark):
    """Scores of the Spark fit against log densities with explicit inverses, from the same statistics."""
    rng = np.random.default_rng(4)
    texts = ["".join(f"{''.join(rng.choice(list('abcdeXYZ0.!'), rng.integers(1, 9)))} " for _ in range(rng.integers(5, 120)))
             for _ in range(160)]
    truth = [int(len(t) % 3 > 0) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, y in enumerate(truth) if i % 7], "doc_id long, quality int")
    x = np.array([quality.statistics(t.encode()) for t in texts], np.float64)
    known = [i for i in range(160) if i % 7 and zlib.crc32(str(i).encode()) % 5]
    classes = [np.array([x[i] for i in known if truth[i] == y]) for y in (0, 1)]
    spread = [np.cov(c.T, bias=True) for c in classes]
    pooled = sum(len(c) * s for c, s in zip(classes, spread)) / len(known)
    logs = []
    for c, s in zip(classes, spread):
        s = (1 - quality.ALPHA) * s + quality.ALPHA * pooled
        s = (1 - quality.GAMMA) * s + quality.GAMMA * np.diag(np.diag(s)) + 1e-6 * np.eye(len(s))
        off = x - c.mean(axis=0)
        logs.append(np.log(len(c) / len(known)) - 0.5 * np.linalg.slogdet(s)[1]
                    - 0.5 * np.einsum("ni,ij,nj->n", off, np.linalg.inv(s), off))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert np.allclose([got[i] for i in range(160)], want, atol=1e-6) and len(set(want.round(3))) > 50


def test_new_words_of_known_parts_cost_no_calls():
    """Words are cut a batch at a time: 40 000 new words of 400 parts make fewer calls than there are words, with the same ids."""
    import random
    import sys

    import pyarrow as pa

    tokens, rng = packing.WordTokens(queries.tokenizer_path()), random.Random(6)
    parts = ["".join(rng.choices("aeinorst\u00e9\u00df", k=6)) for _ in range(200)]
    words = [f"{a}-{b.title()}{end}" for a in parts for b in parts for end in (".", "'s")][:40_000]
    texts = [" ".join(words[i:i + 100]) for i in range(0, len(words), 100)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        ids, lengths = tokens(pa.array(texts))
    finally:
        sys.setprofile(None)
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for own in want for i in own]
    assert len(set(words)) == 40_000 and calls < 20_000
