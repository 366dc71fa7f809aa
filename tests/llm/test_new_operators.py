"""Hard negatives, sharding and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import hard_negatives, list_ranking, prefix_trie, sharding

VECTORS = "vec_id long, embedding array<double>, label int"

# ---- 11: hard negatives ----


def brute_negatives(rows, positives=5, negatives=10, scale=256):
    kept = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.add((i, label, tuple(math.floor(scale * x) for x in v)))
    out = []
    for i, label, v in kept:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other)
                  for j, other, w in kept if j != i and len(w) == len(v)]
        own = sorted(((s, j) for s, j, other in scored if other == label), key=lambda t: (-t[0], t[1]))[:positives]
        for p, j in own:
            fit = sorted(((s, n) for s, n, other in scored if other != label and 30 * p <= 100 * s <= 90 * p),
                         key=lambda t: (-t[0], t[1]))[:negatives]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(table):
    got = hard_negatives.mine(table, F.col("vec_id") % 100 == 0, F.col("vec_id"), F.col("embedding"), F.col("label"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 10))
    rows = [(i, (centres[i % 6] + 0.5 * rng.standard_normal(10)).tolist(), 0 if i % 3 == 0 else i % 5) for i in range(900)]
    rows += [(i, rows[5][1], 1) for i in range(900, 1200)]  # one very common vector, and ties
    got = mined(spark.createDataFrame(rows, VECTORS).repartition(7))
    assert got and got == brute_negatives(rows)


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.4, 0.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 2),
            (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [1.0], 2), (None, [0.4, 0.0], 2), (9, [0.4, 0.0], None), (2, [0.4, 0.0], 2),
            (2, [0.3, 0.0], 3), (100, [-1.0, 0.0], 1), (200, [], 1), (201, [], 1), (202, [], 2), (300, [1e300, 1.0], 4),
            (301, [1e300, 0.0], 4), (302, [1e299, 0.0], 5), (303, [1e308, 0.0], 5), (400, [-0.0], 2), (0, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "z", 1) for r in rows], f"{VECTORS}, row string, v int")
    held = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    want = [r for r in brute_negatives([r for r in rows if r[1] is None or not r[1] or r[1][0] is None or abs(r[1][0]) < 1e100 or r[1][0] in (nan, inf)])]
    got = mined(table)
    assert [r for r in got if r[0] not in (300,)] == [r for r in want if r[0] != 300]
    # scores beyond 64 bits are held at the limit, which then is above nine tenths of itself
    assert {r[4] for r in got if r[0] == 300} <= {held(1 << 70)}
    assert mined(table.limit(0)) == []
    assert mined(spark.createDataFrame([(0, [1.0], 1)], VECTORS)) == []


def test_segment_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.standard_normal((60, 37)))
    mean, deviation = hard_negatives.summaries(v, hard_negatives.SEGMENTS[-1])
    ids = np.arange(60)
    a = hard_negatives.Vectors(ids, ids % 2, v, mean, deviation)
    exact = v @ v.T
    width = []
    for level in range(len(hard_negatives.SEGMENTS)):
        down, up = hard_negatives.bounds(a, a, level)
        assert (down <= exact).all() and (exact <= up).all()
        width.append((up - down).mean())
    assert width[1] < width[0]  # finer segments bound tighter
    # vectors that are almost constant by segment are told apart without scoring
    steps = np.repeat(np.sign(rng.standard_normal((4000, 4))), 16, axis=1) * 200 + rng.integers(-3, 4, (4000, 64))
    mean, deviation = hard_negatives.summaries(steps, hard_negatives.SEGMENTS[-1])
    rows = hard_negatives.Vectors(np.arange(4000), np.zeros(4000, int), steps, mean, deviation)
    limits = np.full((50, 1), hard_negatives._LOW), np.full((50, 1), hard_negatives._HIGH)
    lists = hard_negatives.Lists(rows.take(slice(0, 50)), *limits, 5, True)
    for at in range(0, 4000, 500):
        lists.meet(rows.take(slice(at, at + 500)))
    assert lists.scored < lists.met / 4
    anchor, _, found, score = lists.rows()
    for i in range(50):
        want = sorted(((-int(s), j) for j, s in enumerate(steps @ steps[i]) if j != i))[:5]
        assert [(-s, j) for s, j in zip(score[anchor == i].tolist(), found[anchor == i].tolist())] == want


# ---- 12: sharding ----


def brute_shards(rows, shards):
    groups = {}
    for d, text in rows:
        groups.setdefault(text or "", []).append(d)
    sized = [(len(ids) * (len(t.encode()) + 16), min((d for d in ids if d is not None), default=None), t) for t, ids in groups.items()]
    loads, taken = [0] * shards, {}
    for size, _, _ in sorted(sized, key=lambda g: -g[0]):
        at = loads.index(min(loads))
        loads[at] += size
        taken.setdefault(size, []).append(at)
    place = {}
    for size, chosen in taken.items():
        members = sorted((g for g in sized if g[0] == size), key=lambda g: (g[1] is None, g[1] or 0))
        place.update({g[2]: s for g, s in zip(members, sorted(chosen), strict=True)})
    return place, loads


@pytest.mark.parametrize("sorted_rows", [4096, 10])
def test_shards_are_longest_first(documents, odd_documents, sorted_rows):
    got = sharding.shard(documents, 7, sorted_rows=sorted_rows).collect()
    texts = [(r[0], r[1]) for r in odd_documents]
    place, loads = brute_shards(texts, 7)
    assert {r.doc_id: r.shard for r in got} == {d: place[t or ""] for d, t in texts}
    assert [sum(r["size"] for r in got if r.shard == s) for s in range(7)] == loads
    for s in range(7):
        own = sorted((r.slot, r.doc_id) for r in got if r.shard == s)
        assert [slot for slot, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    by_id = dict(texts)
    assert all(r.text_crc32 == zlib.crc32((by_id[r.doc_id] or "").encode()) for r in got)
    assert all(r["size"] == len((by_id[r.doc_id] or "").encode()) + 16 for r in got)


def test_shards_of_awkward_rows(awkward, no_documents):
    rows = awkward.collect()
    for sorted_rows in (4096, 5):
        got = sharding.shard(awkward, 40, sorted_rows=sorted_rows).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows)
        for s in range(40):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        empty = {r.shard for r in got if r["size"] == 16}
        assert len(empty) == 1  # null and empty texts stay together
    assert sharding.shard(no_documents).collect() == []


def test_many_of_one_size_are_dealt_like_one_after_the_other():
    rng = random.Random(4)
    for _ in range(60):
        fast, slow = sharding.Schedule(6), [0] * 6
        for size in sorted((rng.randint(1, 40) for _ in range(5)), reverse=True):
            count = rng.choice([1, 3, 24, 25, 100, 1000])
            dealt = fast.deal(size, count)
            want = [0] * 6
            for _ in range(count):
                at = slow.index(min(slow))
                slow[at] += size
                want[at] += 1
            assert dealt.tolist() == want
            assert sorted((s, load) for load, s in fast.heap) == list(enumerate(slow))


# ---- 13: the prefix trie ----


def brute_trie(turn_rows, rebuild=True):
    own = {}
    for c, turn, role, text in turn_rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    talks = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        talks[c] = own.get(base, [])[:h] + ts[h:] if rebuild else ts
    members = {}
    for c, ts in talks.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = lambda p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p]
        saved = sum((len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == len(path))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids(path)),
                    sum(not kids(p) for p in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def talk_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(-45, 130), 10**15, 10**15 + 7]:
        if c == 40:
            continue  # an absent opening conversation
        for t in range(rng.randint(1, 6)):
            rows.append((c, t * 2 if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi there", "a b c", "", None, "é ü\x0bx"])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]  # copies
    rows += [(300, 0, "user", "hi"), (300, 0, "user", "hi"), (300, 0, "assistant", "hi"), (None, 0, "user", "nobody"), (301, None, None, None)]
    return rows


def columns(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("walked, piece_nodes, piece_turns", [(100_000, 1000, 100_000), (40, 30, 2)])
def test_trie_equals_brute_force(spark, walked, piece_nodes, piece_turns):
    rows = talk_rows()
    table = spark.createDataFrame([(*r, "z", "z") for r in rows], f"{TURNS}, depth string, place string").repartition(5)
    turns = prefix_trie.turns_of(table, piece_turns)
    got = prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns), piece_nodes, piece_turns, walked)
    assert columns(got) == brute_trie(rows)
    plain = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct(), piece_nodes, piece_turns, walked)
    assert columns(plain) == brute_trie(rows, rebuild=False)


def test_tour_positions_enclose_subtrees(spark):
    turns = prefix_trie.turns_of(spark.createDataFrame(talk_rows(), TURNS))
    rows = prefix_trie.prefix_trie(turns, turns.select("conv_id").distinct()).collect()
    assert sorted(p for r in rows for p in (r.enter_position, r.exit_position)) == list(range(2 * len(rows)))
    assert all((r.exit_position - r.enter_position) % 2 == 1 for r in rows)
    for r in rows:
        inside = [q for q in rows if r.enter_position <= q.enter_position and q.exit_position <= r.exit_position]
        assert len(inside) == (r.exit_position - r.enter_position + 1) // 2 and min(q.conv_id for q in inside) == r.conv_id


def test_no_conversations(spark):
    table = spark.createDataFrame([], TURNS)
    turns = prefix_trie.turns_of(table)
    assert columns(prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns))) == []


def test_lists_are_ranked(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10**12), 400)
    ends = {100, 399}
    rows = [(x, None if i in ends else ids[i + 1], rng.randint(-5, 9)) for i, x in enumerate(ids)]
    want, total = {}, 0
    for i, (x, _, w) in enumerate(rows):
        want[x] = total
        total = 0 if i in ends else total + w
    links = spark.createDataFrame(rows, "id long, next long, w long")
    for walked in (1000, 20):
        assert {r.id: r.w for r in list_ranking.prefix_sums(links, ["w"], walked).collect()} == want
