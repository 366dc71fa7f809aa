"""Near copies: texts that share at least ``LEAST`` of their five-word shingles, linked transitively.

Covering SimHash as in ``simhash``, with a longer fingerprint and an exact decision. Texts of one shingle set are one
node. A node has a fingerprint of ``BLOCKS`` blocks of ``ROWS`` bits, each the majority of its shingles' hashes. A block has
a covering family of 15 masks: two nodes that differ in at most three of its bits agree under one of them, always, and so
do most that differ in a few more. Nodes that agree under a mask meet in a bucket, where those whose whole fingerprints
differ in ``MAX_DIFFER`` bits at most are linked into rough clusters. Texts of a rough cluster move once to one task, which
compares whole shingle sets; only pairs of a similarity of at least ``least`` are linked. A pair is compared unless both are
linked already, so a group of copies costs its size and not its square.

A pair of similarity exactly 0.8 differs in a bit with probability 0.15. Of 60 000 random pairs of it (sets of 90) none
missed all families and 2 differed in more than ``MAX_DIFFER`` bits. More similar pairs are lost less often. No pair below
``least`` is linked.

Words are as in ``simhash``: runs of anything but ASCII white space, A-Z lowered. A text of up to five words has one
shingle; one of up to three shingles is like its equals only. Defined results: null is empty and like other empty texts;
documents without an id take the group of their shingle set and link nothing themselves; repeated rows are kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from cohortspark.llm.common import Scratch, if_small, map_batches, written
from cohortspark.llm.components import components
from cohortspark.llm.repeats import packed
from cohortspark.llm.simhash import _shingle_hashes, spanned, text_key

SHINGLE_WORDS = 5
LEAST = 0.8
RADIUS = 3
#: Blocks of a fingerprint and bits of a block.
BLOCKS, ROWS = 12, 24
#: Masks of all blocks.
BANDS = BLOCKS * (2 ** (RADIUS + 1) - 1)
#: Bits in which the fingerprints of a linked pair differ, at most: 4.6 standard deviations above similarity 0.8.
MAX_DIFFER = 72
#: Places under all masks in which such a pair agrees, at least: a bit is under 2^RADIUS masks.
MIN_AGREE = BANDS * ROWS - 2 ** RADIUS * MAX_DIFFER
#: Bits of the first 64 that may differ before the others are looked at.
_FIRST_DIFFER = 25
#: A set of fewer shingles shares less than ``LEAST`` with any other.
LEAST_SHINGLES = 4
#: Shingle hashes of a text whose bits are counted at a time.
_CHUNK = 1 << 16
#: Rows of buckets that are looked at together, and nodes of a bucket that is looked at alone.
_ROWS_HELD, _LARGE_BUCKET = 100_000, 512
#: Links that are thinned together.
_LINKS_HELD = 1_000_000

_draw = np.random.default_rng(77)
_TIMES, _AGAIN = (_draw.integers(0, 1 << 63, -(-BLOCKS * ROWS // 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _masks() -> np.ndarray:
    """The masks of every block (block, mask, bit). The vectors of a block's bits are as many of each as can be."""
    out = []
    for _ in range(BLOCKS):
        vectors = np.concatenate([_draw.permutation(np.arange(1, 2 ** (RADIUS + 1))) for _ in range(2)])[:ROWS]
        out.append([np.bitwise_count(vectors & v) & 1 for v in range(1, 2 ** (RADIUS + 1))])
    return np.array(out, np.uint8)


_MASKS = _masks()


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    own = _shingle_hashes(text, SHINGLE_WORDS)
    return np.unique(np.fromiter(own, np.uint64, len(own)))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits of a set that is not empty: a bit is 1 if over half of the shingles have it."""
    ones = np.zeros(64 * len(_TIMES), np.int64)
    for i in range(0, len(hashes), _CHUNK):
        words = hashes[i:i + _CHUNK, None] * _TIMES
        words = (words ^ (words >> np.uint64(32))) * _AGAIN
        words ^= words >> np.uint64(29)
        bits = np.unpackbits(words.view(np.uint8), axis=1).view(np.uint64)  # eight counts of one byte in a number
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).sum(axis=0, dtype=np.int64)
    return (2 * ones > len(hashes)).astype(np.uint8)[:BLOCKS * ROWS]


def under_masks(bits: np.ndarray) -> np.ndarray:
    """The bits under every mask of fingerprints (a row each): (row, mask, bit)."""
    return (bits.reshape(-1, BLOCKS, 1, ROWS) & _MASKS).reshape(len(bits), BANDS, ROWS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The bits of a set under one mask after the other."""
    return under_masks(fingerprint(hashes)[None]).ravel()


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (a digest of the shingle set), fp (the fingerprint's bytes; empty for a set that is like no other)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = [], []
            for value in batch.column(1):
                hashes = shingle_set((value.as_py() or "").encode())
                nodes.append(xxh64_intdigest(hashes.tobytes()))
                fps.append(np.packbits(fingerprint(hashes)).tobytes() if len(hashes) >= LEAST_SHINGLES else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)),
                 pa.array(fps, pa.binary())], names=["doc_id", "text_key", "node", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
    return map_batches(rows, run, "doc_id long, text_key long, node long, fp binary")


def _packed_bits(column: pa.Array) -> np.ndarray:
    """Fingerprints as bytes, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BLOCKS * ROWS // 8)


def _dealt(nodes: DataFrame) -> DataFrame:
    """A row (bucket, node, fp) for every mask of a node; the bucket is the mask's number and the bits under it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                under = np.packbits(under_masks(np.unpackbits(_packed_bits(batch.column(1)), axis=1)), axis=2)
                bucket = np.broadcast_to(np.arange(BANDS, dtype=np.int64), under.shape[:2])
                for i in range(under.shape[2]):
                    bucket = bucket << 8 | under[:, :, i]
                each = pa.array(np.repeat(np.arange(len(batch)), BANDS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.ravel()), batch.column(0).take(each), batch.column(1).take(each)],
                    names=["bucket", "node", "fp"])

    return map_batches(nodes.select("node", "fp"), run, "bucket long, node long, fp binary")


def _meeting(bucket: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The first member of everyone's component inside its bucket; rows are sorted by bucket. Words: 64 bits a column."""
    n = len(bucket)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.append(start, n))
    out = np.arange(n)
    for at, size in zip(start[sizes > _LARGE_BUCKET], sizes[sizes > _LARGE_BUCKET], strict=True):
        own = words[at:at + size]
        out[at:at + size] = at + _linked(
            size, lambda i, rest, own=own: np.bitwise_count(own[rest] ^ own[i]).sum(axis=1, dtype=np.int64) <= MAX_DIFFER)
    behind = np.repeat(start + sizes, sizes) - np.arange(n) - 1
    behind[np.repeat(sizes > _LARGE_BUCKET, sizes)] = 0
    active, step, pairs = np.flatnonzero(behind > 0), 1, []
    first = np.ascontiguousarray(words[:, 0])
    while len(active):
        near = active[np.bitwise_count(first[active] ^ first[active + step]) <= _FIRST_DIFFER]
        near = near[np.bitwise_count(words[near] ^ words[near + step]).sum(axis=1, dtype=np.int64) <= MAX_DIFFER]
        pairs.append((near, near + step))
        step += 1
        active = active[behind[active] >= step]
    if pairs:
        out = np.minimum(out, spanned(n, *map(np.concatenate, zip(*pairs, strict=True))))
    return out


def _rough_links(dealt: DataFrame) -> DataFrame:
    """(a, b): links of a spanning forest of the buckets of a task, a few at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit(bucket: np.ndarray, node: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            words = np.zeros((len(fps), 8 * len(_TIMES)), np.uint8)
            words[:, :fps.shape[1]] = fps
            root = _meeting(bucket, words.view(np.uint64))
            moved = np.flatnonzero(root != np.arange(len(root)))
            return _forest(node[moved], node[root[moved]])

        def whole() -> list[np.ndarray]:
            return [np.concatenate(parts) for parts in zip(*held, strict=True)]

        for batch in batches:
            if len(batch):
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _packed_bits(batch.column(2))))
                rows += len(batch)
            if rows >= _ROWS_HELD:
                columns = whole()
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield emit(*(c[:cut] for c in columns))
                held, rows = [tuple(c[cut:].copy() for c in columns)], 0
        if held:
            yield emit(*whole())

    return map_batches(dealt.repartition("bucket").sortWithinPartitions("bucket", "node"), run, "a long, b long")


def _linked(n: int, like: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first member of everyone's component; ``like`` tells which of some members are like one."""
    first, rest = np.arange(n), np.arange(n)
    while len(rest):
        root, waiting, rest = rest[0], [rest[0]], rest[1:]
        while waiting and len(rest):
            near = like(waiting.pop(), rest)
            found, rest = rest[near], rest[~near]
            first[found] = root
            waiting.extend(found)
    return first


def similar(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The first member of everyone's component, by whole shingle sets that are not empty."""
    sizes = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(names), bool)
    state = {"members": np.arange(len(sets)), "flat": flat}  # what is left to compare with

    def like(i: int, rest: np.ndarray) -> np.ndarray:
        if len(rest) < len(state["members"]):
            stays = np.isin(state["members"], rest)
            state["flat"] = state["flat"][np.repeat(stays, sizes[state["members"]])]
            state["members"] = rest
        own = flat[ends[i] - sizes[i]:ends[i]]
        marked[own] = True
        starts = np.cumsum(sizes[rest]) - sizes[rest]
        common = np.add.reduceat(marked[state["flat"]], starts, dtype=np.int64)
        marked[own] = False
        return common >= least * (sizes[rest] + sizes[i] - common) - 1e-9

    return _linked(len(sets), like)


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """(a, b): every node of some links, but the smallest of its component, with that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = spanned(len(nodes), at[:len(a)], at[len(a):])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _thinned(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) of the same components: nodes that many buckets have linked meet again, dealt by ``a``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += len(batch)
            if rows >= _LINKS_HELD:
                yield _forest(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield _forest(*map(np.concatenate, zip(*held, strict=True)))

    return map_batches(links.repartition("a"), run, "a long, b long")


def _by_group(rows: DataFrame, value: Callable, first: Callable, schema: str) -> DataFrame:
    """(node, first member) of rows (group, node, value), where ``first`` looks at the values of a whole group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, values = None, [], []

        def emit() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                own = np.array(nodes, np.int64)
                root = own[first(values)]
                moved = root != own
                yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(root[moved])], names=["a", "b"])

        for batch in batches:
            for its, node, v in zip(*(batch.column(i) for i in range(3)), strict=True):
                if its.as_py() != group:
                    yield from emit()
                    group, nodes, values = its.as_py(), [], []
                if not nodes or nodes[-1] != node.as_py():  # repeated rows follow each other
                    nodes.append(node.as_py())
                    values.append(value(v.as_py()))
        yield from emit()

    return map_batches(rows.repartition("group").sortWithinPartitions("group", "node"), run, schema)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and component_id (the smallest digest of a shingle set in the group) of every document.

    Texts move compressed, and only what names the groups stays in the shared folder.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    sketches = scratch.written(_sketches(docs), "sketches")
    prints = written(sketches.select("doc_id", "text_key", "node"), "near-prints")
    nodes = scratch.written(
        sketches.where("doc_id IS NOT NULL AND length(fp) > 0").groupBy("node").agg(
            F.min(F.struct("doc_id", "text_key")).alias("own"), F.first("fp").alias("fp")),
        "nodes")
    rough = _thinned(_rough_links(_dealt(nodes)))
    clusters = scratch.written(components(rough, scratch.written), "clusters")
    members = scratch.written(
        clusters.join(nodes, "node").select(
            F.col("component").alias("group"), "node", F.col("own.doc_id").alias("_doc"),
            F.col("own.text_key").alias("_key")), "members")
    texts = packed(docs).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    links = _by_group(
        texts.join(if_small(members), ["_doc", "_key"]).select("group", "node", "z"),
        lambda v: shingle_set(zstandard.decompress(v)), similar, "a long, b long")
    links = written(links.select(F.col("a").alias("node"), F.col("b").alias("component_id")), "near-links")
    scratch.remove()
    return prints.join(links, "node", "left").select(
        "doc_id", "text_key", F.coalesce("component_id", "node").alias("component_id"))
