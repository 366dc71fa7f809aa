"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

Every bit position gets a vector of ``radius + 1`` bits. For each of the ``2^(radius+1) - 1`` non-zero vectors v there is
a table whose mask has the positions not orthogonal to v. The positions in which two fingerprints within the radius
differ span at most ``radius`` dimensions, so some v is orthogonal to all of them: the pair agrees under that mask and
meets in that table, always. Candidates are then compared bit by bit.

Equal fingerprints are one node. A bucket above ``bucket_rows`` nodes is dealt out again by a second, independent family
of masks on top of its key, and so on; the guarantee holds inside every bucket, so nothing is lost. Of a bucket only a
spanning forest of its links leaves the task, never all pairs.

Defined results: a null text is empty and has fingerprint zero, linked like any other; documents without an id take their
fingerprint's component and link nothing themselves; repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.common import if_small, map_batches, written
from cohortspark.llm.components import components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Nodes per bucket before it is dealt out again; above 128, the most nodes that can be pairwise within three bits, since
#: no mask would ever part these.
BUCKET_ROWS = 2048
#: Bytes of text whose shingles are held at a time.
CHUNK_BYTES = 1_500_000


def _shingle_hashes(text: bytes, words: int) -> list[int]:
    from xxhash import xxh64_intdigest

    parts = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not parts:
        return []
    line = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(line, SEED)]
    ends, at = [], -1
    for part in parts:
        at += len(part) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[:-words]]
    return [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:], strict=True)]


def fingerprint_texts(texts: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprints: a bit is set if over half of a text's shingle hashes have it."""
    hashes = [_shingle_hashes(t, words) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    flat = np.fromiter((h for own in hashes for h in own), np.uint64, int(counts.sum()))
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        major = (2 * ones > counts[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key (a digest that tells rows of one id apart), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found, held, room = [], [], CHUNK_BYTES
            for text in texts:
                held.append(text)
                room -= len(text)
                if room < 0:
                    found.append(fingerprint_texts(held, words))
                    held, room = [], CHUNK_BYTES
            found.append(fingerprint_texts(held, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.concatenate(found).view(np.int64))],
                names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key())
    return map_batches(rows, run, "doc_id long, text_key long, fp long")


def masks(radius: int = RADIUS, level: int = 0) -> list[int]:
    """The masks of one covering family, as signed longs."""
    dims = radius + 1
    vectors = np.random.default_rng(1000 + level).integers(1, 1 << dims, 64)
    out = []
    for v in range(1, 1 << dims):
        odd = np.bitwise_count(vectors & v) & 1
        value = sum(1 << i for i in range(64) if odd[i])
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def _dealt(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows (bucket, fp, rep) dealt out to a family of masks on top of their bucket."""
    family = F.array(*[F.lit(m).cast("long") for m in masks(radius, level)])
    one = rows.select("bucket", "fp", "rep", F.posexplode(family).alias("t", "mask"))
    key = F.xxhash64("bucket", F.lit(level), "t", F.col("fp").bitwiseAND(F.col("mask")))
    return one.select(key.alias("bucket"), "fp", "rep")


def _forest(bucket: np.ndarray, fp: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest inside each bucket; rows are sorted by bucket."""
    n = len(bucket)
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    behind = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n))) - np.arange(n) - 1
    active, step = np.flatnonzero(behind > 0), 1
    lefts, rights = [], []
    while len(active):
        near = active[np.bitwise_count(fp[active] ^ fp[active + step]) <= radius]
        lefts.append(near)
        rights.append(near + step)
        step += 1
        active = active[behind[active] >= step]
    a = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
    b = np.concatenate(rights) if rights else np.zeros(0, np.int64)
    label = spanned(n, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return rep[moved], rep[label[moved]]


def spanned(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first of everyone's component, for n members and links between a and b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(dealt: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(3)]
            held = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            first_of_last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if first_of_last:
                yield emit([c[:first_of_last] for c in held])
                held = [c[first_of_last:] for c in held]
        if held is not None and len(held[0]):
            yield emit(held)

    def emit(columns: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _forest(columns[0], columns[1].view(np.uint64), columns[2], radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_groups(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component) for stored fingerprints (doc_id, fp): the smallest doc_id that links within the radius reach."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    rows = nodes.where("rep IS NOT NULL").select(F.lit(0).cast("long").alias("bucket"), "fp", "rep")
    edges, level = None, 0
    while True:
        dealt = _dealt(rows, radius, level)
        large = written(
            dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket"), "large-buckets")
        found = _links(dealt.join(large, "bucket", "left_anti"), radius)
        edges = found if edges is None else edges.unionByName(found)
        if large.isEmpty():
            break
        rows = written(dealt.join(large, "bucket", "left_semi"), "large-bucket-rows")
        level += 1
    roots = components(edges)
    return nodes.join(roots, nodes.rep == roots.node, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, fp and component_id of every document."""
    fps = written(fingerprints(docs, words), "simhash")
    return fps.join(near_groups(fps, radius), "fp").select("doc_id", "text_key", "fp", "component_id")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of every component its first document, and all documents without an id.

    The keys that go, and those of repeated rows, are stored first: they are few beside the texts, which then meet them in
    an anti join and move only if the keys are too many to be broadcast (``common.BROADCAST_BYTES``).
    """
    members = groups.where("doc_id IS NOT NULL").select("doc_id", "text_key", "component_id")
    place = F.struct("doc_id", "text_key")
    first = written(members.groupBy(F.col("component_id").alias("_component")).agg(F.min(place).alias("first")), "components-first")
    keys = members.join(first, F.col("component_id") == F.col("_component")).groupBy("doc_id", "text_key").agg(
        F.count("*").alias("rows"), F.min((place == F.col("first")).cast("int")).alias("stays"))
    special = written(keys.where("rows > 1 OR stays = 0").select(
        F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "stays"), "components-rest")
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_key().alias("_key"), F.struct("*").alias("_row"))
    kept = rows.join(if_small(special.select("_doc", "_key")), ["_doc", "_key"], "left_anti").select("_row.*")
    again = special.where("stays = 1").select("_doc", "_key")
    if again.isEmpty():
        return kept
    return kept.unionByName(
        rows.join(if_small(again), ["_doc", "_key"], "left_semi").dropDuplicates(["_doc", "_key"]).select("_row.*"))
