"""Near copies by five-word shingles, and the pipeline's stage, against brute force."""

import random

import numpy as np

import corpus_pipeline
from cohortspark.llm import near_copies, simhash
from cohortspark.llm.common import table, written
from cohortspark.llm.components import components
from tests.llm.conftest import DOCUMENTS, prose
from tests.llm.test_documents import brute_components, brute_simhash, jaccard


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_copies(texts, least=0.8):
    ids = sorted(texts)
    own = {i: lowered(texts[i]) for i in ids}
    like = {i: [j for j in ids if jaccard(own[i], own[j]) >= least - 1e-9] for i in ids}
    label, changed = {i: i for i in ids}, True
    while changed:
        changed = False
        for i in ids:
            low = min(label[j] for j in like[i])
            if low < label[i]:
                label[i], changed = low, True
    return label


def edited(rng, text, edits):
    words = text.split(" ")
    for k, at in enumerate(rng.sample(range(len(words)), edits)):
        words[at] = f"edit{rng.random()}{k}"
    return " ".join(words)


def planted():
    """Sixty texts, each with a copy of one to eight edited words, and texts that one repeated line dominates."""
    rng, rows = random.Random(8), {}
    for i in range(60):
        text = prose(rng, rng.randint(200, 320))
        rows[2 * i], rows[2 * i + 1] = text, edited(rng, text, 1 + i % 8)
    line = prose(rng, 13)
    for i in range(6):
        rows[200 + i] = f"{f'{line} ' * 60}{prose(rng, 40)}"
    return rows


def kept(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCUMENTS).repartition(5)
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}


def test_stage_links_planted_edits_and_nothing_else(spark):
    texts = planted()
    want = brute_copies(texts)
    pairs = [jaccard(texts[2 * i], texts[2 * i + 1]) for i in range(60)]
    assert sum(0.8 <= p < 0.97 for p in pairs) > 30 and sum(p < 0.8 for p in pairs) > 5
    old = brute_components({i: brute_simhash(t) for i, t in texts.items()})
    assert len(set(old.values()) - set(want.values())) > 20  # near copies that 3 of 64 bits leave
    assert {old[i] for i in range(200, 206)} == {200} and all(want[i] == i for i in range(200, 206))  # and what it takes
    assert kept(spark, texts) == set(want.values())


def test_stage_on_generated_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute_copies({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values())


def test_chains_and_odd_texts(spark, odd_documents):
    texts, rng = {r[0]: r[1] for r in odd_documents}, random.Random(2)
    chain = prose(rng, 250)
    for i in range(1000, 1012):  # neighbours are alike, the ends are not
        texts[i] = chain
        chain = edited(rng, chain, 3)
    assert jaccard(texts[1000], texts[1011]) < 0.8
    want = brute_copies(texts)
    assert want[1011] == 1000 and kept(spark, texts) == set(want.values())


def test_groups_of_awkward_rows(awkward, no_documents):
    groups = near_copies.near_copies(awkward)
    assert groups.count() == awkward.count()
    rows = simhash.one_of_each(awkward, groups).collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in rows) == 2
    want = brute_copies({r.doc_id: r.text for r in awkward.where("doc_id IS NOT NULL").collect()})
    assert set(ids) == set(want.values())
    assert near_copies.near_copies(no_documents).collect() == []


def test_sketches_of_pairs_at_the_limit():
    """Sets of similarity 0.8: no band shared or too few places, in none of 300."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        values = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b = near_copies.sketch(values[:90]), near_copies.sketch(values[10:])
        same = a == b
        assert same.reshape(near_copies.BANDS, near_copies.ROWS).all(axis=1).any() and same.sum() >= near_copies.MIN_AGREE


def test_masks_cover_three_bits_of_a_block():
    """Fingerprints that differ in at most three bits of one block agree under a mask, whatever the other blocks hold."""
    rng = np.random.default_rng(5)
    per_block = near_copies.BANDS // near_copies.BLOCKS
    for block in range(near_copies.BLOCKS):
        for _ in range(200):
            a, b = rng.integers(0, 2, (2, near_copies.BLOCKS * near_copies.ROWS), dtype=np.uint8)
            own = slice(block * near_copies.ROWS, (block + 1) * near_copies.ROWS)
            b[own] = a[own]
            b[block * near_copies.ROWS + rng.choice(near_copies.ROWS, rng.integers(0, 4), replace=False)] ^= 1
            same = (near_copies.under_masks(a[None]) == near_copies.under_masks(b[None])).all(axis=2)[0]
            assert same[block * per_block:(block + 1) * per_block].any()


def test_fingerprints_at_the_limit():
    """A bit is the majority of the shingles; of 3000 pairs of similarity 0.8 none is missed, and no unlike pair is near."""
    rng = np.random.default_rng(6)
    one = rng.integers(0, 1 << 63, 1, dtype=np.uint64)
    single = near_copies.fingerprint(one)
    assert (near_copies.fingerprint(np.concatenate([one, rng.integers(0, 1 << 63, 1, dtype=np.uint64)])) <= single).all()
    for _ in range(3000):
        values = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        a, b, c = (near_copies.fingerprint(v) for v in (values[:90], values[10:], rng.integers(0, 1 << 63, 90, dtype=np.uint64)))
        under = near_copies.under_masks(np.stack([a, b]))
        assert (under[0] == under[1]).all(axis=1).any() and (a != b).sum() <= near_copies.MAX_DIFFER < (a != c).sum()


def test_buckets_link_what_meets(spark, monkeypatch):
    """Links of the buckets, thinned, against all pairs that agree under a mask and differ in few bits."""
    rng = np.random.default_rng(7)
    bits = rng.integers(0, 2, (30, near_copies.BLOCKS * near_copies.ROWS), dtype=np.uint8)
    bits = np.concatenate([bits, *[bits ^ (rng.random(bits.shape) < p) for p in (0.02, 0.1, 0.2)]]).astype(np.uint8)
    under = near_copies.under_masks(bits)
    meet = (under[:, None] == under[None]).all(axis=3).any(axis=2) & ((bits[:, None] != bits[None]).sum(axis=2) <= near_copies.MAX_DIFFER)
    want = np.arange(len(bits))
    while True:
        after = np.array([want[row].min() for row in meet])
        if (after == want).all():
            break
        want = after
    assert 25 < len(set(want)) < 90
    rows = [(i, np.packbits(b).tobytes()) for i, b in enumerate(bits)]
    nodes = spark.createDataFrame(rows, "node long, fp binary").repartition(3)
    links = near_copies._thinned(near_copies._rough_links(near_copies._dealt(nodes)))
    assert links.where("a <= b").isEmpty() and links.count() < len(bits) * 4
    roots = {r.node: r.component for r in components(written(links, "test-links")).collect()}
    assert [roots.get(i, i) for i in range(len(bits))] == want.tolist()
    padded = np.zeros((len(bits), 8 * -(-bits.shape[1] // 64)), np.uint8)
    padded[:, :bits.shape[1] // 8] = np.packbits(bits, axis=1)
    bucket, words = np.repeat([3, 5], len(bits)), np.concatenate([padded, padded]).view(np.uint64)
    plain = near_copies._meeting(bucket, words)
    monkeypatch.setattr(near_copies, "_LARGE_BUCKET", 10)  # both ways of a bucket
    assert near_copies._meeting(bucket, words).tolist() == plain.tolist()
