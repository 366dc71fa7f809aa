"""Long repeats across documents: anchors, context classes, and the windows that are left.

Shared by the two substring operators, which differ in their tokens (bytes or words), in how they choose anchors, in what
"earlier" means, and in how they resolve what is left. A *window* is ``width`` consecutive tokens of one document.

1. Every window chooses an anchor, a short token run inside it, by a rule that looks only at the window's content; equal
   windows therefore choose equal anchors at equal places. The *context* of an anchor is every window that chose it.
   One scan emits (hash of anchor, hash of context, document, span), packed by bucket of the anchor hash.
2. In a bucket, an occurrence whose whole context occurs earlier is *covered*. The first of a context class stays if its
   anchor also occurs in other contexts elsewhere; only there can single windows still repeat.
3. For these the tokens are fetched by a join on documents, windows inside one covered span are left out, and the rest is
   resolved exactly by the operator.

Runs that a bounded sample of documents shows to be frequent are chosen only by windows that hold nothing else, as those
inside a line that many documents share; a window over the line's end chooses a rare run. Frequent anchors are dealt over
all buckets by document, and what is left of them is resolved by aggregation and join on the window itself, which Spark
combines before the shuffle and splits at need. The sample decides the choice and the layout only: any list of frequent
runs gives the same result.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from cohortspark.llm.common import Scratch, map_batches, quoted, text_or_empty, tidy, written

#: Documents in the sample that shows frequent anchors, and the share of them that makes an anchor frequent.
SAMPLE_DOCS, FREQUENT = 4000, 0.01
#: Bytes of text whose anchors are searched at a time, whose anchors are packed at a time, and per bucket of anchors.
CHUNK_BYTES, SLICE_BYTES, BUCKET_BYTES = 400_000, 5_000_000, 24 << 20
#: Runs of windows that are resolved at a time.
RESOLVED_RUNS = 30_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of the base and of its inverse, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


powers = Powers()


class Hashes:
    """Hashes of any token runs of a sequence, from one running sum."""

    def __init__(self, tokens: np.ndarray) -> None:
        n = len(tokens)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])


class Frequent:
    """A set of frequent runs by hash, asked for by many at a time."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(np.asarray(hashes).astype(np.int64).view(np.uint64))
        self.heads = np.zeros(1 << 16, bool)
        self.heads[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        found = self.heads[(hashes >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(found)
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        found[at] = self.hashes[place] == hashes[at]
        return found


@dataclass
class Anchors:
    """Chosen anchors of a chunk: document (index in the chunk), span of the context in the document, two hashes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


@dataclass(frozen=True)
class Repeats:
    """What an operator brings along.

    ``tokens(texts)`` gives the tokens of texts one after the other, as integers, and the number of tokens of each;
    ``anchors(texts, frequent)`` the chosen anchors, ``candidates(texts)`` (text, hash) of all runs that could be;
    ``in_order``: a repeat inside one document counts, by position; ``dtype``: of stored
    tokens; ``resolve(table)`` finds the spans of one partition of windows.
    """

    width: int
    dtype: np.dtype
    in_order: bool
    tokens: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    anchors: Callable[[list[bytes], Frequent], Anchors]
    candidates: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
    resolve: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]]


def around(docs: np.ndarray, first: np.ndarray, most: np.ndarray, least: np.ndarray, bounds: np.ndarray, width: int,
           hashes: Hashes, anchor: np.ndarray) -> Anchors:
    """Anchors at ``first`` with the span of the windows that chose them, which begin from ``most`` to ``least`` tokens
    before them. Positions count in the chunk; ``bounds`` are where documents begin in it. How far the span reaches is part
    of the context hash, so equal contexts are equal spans.
    """
    start, end = first - most, first - least + width
    geometry = mix((most * 1024 + least).astype(np.uint64) + np.uint64(1))
    context = mix(hashes(start, end) ^ geometry)
    return Anchors(docs, start - bounds[docs], end - bounds[docs], anchor, context)


# ---- texts that move -------------------------------------------------------------------------------------------


def with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows of one id with other texts are told apart by a digest."""
    text = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def packed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, text_key and the compressed text, for joins that must move texts; ``carry``: and a struct of all other
    columns of ``docs``."""
    rows = with_key(docs)
    fields = [StructField("doc_id", LongType()), StructField("text_key", LongType()), StructField("z", BinaryType())]
    if carry:
        text = text_or_empty("text")
        rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"),
                           F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("rest"))
        fields.append(rows.schema["rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(map(packer.compress, _texts(batch)), pa.binary()),
                 *([batch.column("rest")] if carry else [])], names=["doc_id", "text_key", "z", *["rest"] * carry])

    return map_batches(rows, run, StructType(fields))


def unpacked(column: pa.Array) -> list[bytes]:
    opener = zstandard.ZstdDecompressor()
    return [opener.decompress(z) for z in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``SLICE_BYTES`` of text, one row at least, whatever the size of Arrow's batches."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= SLICE_BYTES or at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunks(texts: list[bytes], room: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``room`` bytes, one text at least."""
    start, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= room:
            yield start, at + 1
            start, held = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


# ---- 1. anchors by bucket --------------------------------------------------------------------------------------


def _frequent(docs: DataFrame, spec: Repeats, n_docs: int) -> np.ndarray:
    """Hashes of runs that occur in many documents of the sample: in ``FREQUENT`` of them, counted over slices in which
    they occur more than once. There are at most as many as 1 / FREQUENT documents have runs."""
    share = max(1, min(1_000_000, SAMPLE_DOCS * 1_000_000 // max(n_docs, 1)))
    sample = with_key(docs).where(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _texts(batch)
            pairs = []
            for a, b in chunks(texts):
                doc, run_ = spec.candidates(texts[a:b])
                order = np.lexsort((doc, run_))
                doc, run_ = doc[order], run_[order]
                new = np.concatenate([[True], (run_[1:] != run_[:-1]) | (doc[1:] != doc[:-1])])[:len(run_)]
                pairs.append(run_[new])
            runs, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]), return_counts=True)
            several = counts > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[several].view(np.int64)), pa.array(counts[several])], names=["anchor", "docs"])

    least = max(20, int(FREQUENT * min(n_docs, SAMPLE_DOCS)))
    counted = map_batches(sample, run, "anchor long, docs long").groupBy("anchor").agg(F.sum("docs").alias("docs"))
    rows = counted.where(F.col("docs") >= least).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64))


#: Bytes of the anchor's and of the context's hash that are kept. Anchors that share theirs only share a group.
ANCHOR_BYTES, CONTEXT_BYTES = 4, 7


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of numbers, first bytes of all, then second bytes of all: high bytes of small numbers
    compress to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: np.ndarray, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = data[:n * width].reshape(width, n).T
    return wide.view("<u8").ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, which a running sum undoes."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


_FIELDS = (ANCHOR_BYTES, CONTEXT_BYTES, 4, 4, 1, 1)


def _pack(ids: np.ndarray, keys: np.ndarray, anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, start: np.ndarray,
          length: np.ndarray, hot: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The documents of a block (ids, keys) and its anchors, column after column; rows are in document order."""
    used, local = np.unique(doc, return_inverse=True)
    step = _steps(local)
    # positions as distances, beginning anew with every document
    apart = np.where(step > 0, start.astype(np.uint64), _steps(start))
    apart[0] = start[0]
    columns = (anchor, context, step, apart, length, hot)
    block = b"".join(_planes(c, width) for c, width in zip(columns, _FIELDS, strict=True))
    return _planes(_steps(ids[used].view(np.uint64)), 8), keys[used].astype("<i8").tobytes(), block


def _unpack(ids: bytes, keys: bytes, block: bytes) -> tuple[np.ndarray, ...]:
    """anchor, context, document, key, start, length, hot of every row."""
    n, at = len(block) // sum(_FIELDS), 0
    data, out = np.frombuffer(block, np.uint8), []
    for width in _FIELDS:
        out.append(_from_planes(data[at:], n, width))
        at += n * width
    anchor, context, step, apart, length, hot = out
    doc = np.cumsum(step).astype(np.int64)
    first = step > 0
    first[:1] = True
    total = np.cumsum(apart).astype(np.int64)
    begun = (total - apart.astype(np.int64))[np.flatnonzero(first)]
    start = total - begun[np.cumsum(first) - 1]
    names = np.cumsum(_from_planes(np.frombuffer(ids, np.uint8), len(ids) // 8, 8)).view(np.int64)
    return (anchor, context, names[doc], np.frombuffer(keys, "<i8")[doc], start.astype(np.int32),
            length.astype(np.int32), hot.astype(np.uint8))


def _bucketed(docs: DataFrame, spec: Repeats, buckets: int, frequent: np.ndarray) -> DataFrame:
    """bucket, the documents of a batch (ids, keys), and the packed anchors of the batch in that bucket."""
    listed = Frequent(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = _texts(batch)
            known = np.array(batch.column("doc_id").is_valid())
            found = []
            for a, b in chunks(texts):
                part = spec.anchors(texts[a:b], listed)
                part.doc = part.doc + a
                found.append(part)
            if not found:
                continue
            doc, start, end, anchor, context = (
                np.concatenate([getattr(f, n) for f in found]) for n in ("doc", "start", "end", "anchor", "context"))
            keep = known[doc]
            doc, start, end, anchor, context = (x[keep] for x in (doc, start, end, anchor, context))
            if not len(doc):
                continue
            hot = listed(anchor)
            keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            salt = mix(keys[doc].view(np.uint64))
            bucket = ((np.where(hot, mix(anchor ^ salt), anchor) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, doc, bucket))
            firsts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            rows = [_pack(ids, keys, anchor[r], context[r], doc[r], start[r], (end - start)[r], hot[r])
                    for r in np.split(order, firsts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order][firsts], pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))],
                names=["bucket", "ids", "keys", "block"])

    return map_batches(with_key(docs), run, "bucket int, ids binary, keys binary, block binary")


# ---- 2. context classes ----------------------------------------------------------------------------------------

COVERED, LEFT, LEFT_FREQUENT = 0, 1, 2
SPANS = "doc_id long, text_key long, start int, end int, kind int, anchor long, context long"


def _classes(anchor, context, doc, key, start, length, hot, in_order: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their kind, of one bucket. Order: by anchor, context, document, key, start."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((start, key, doc, context, anchor))
    a, c, d = anchor[order], context[order], doc[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_class = new_anchor | np.concatenate([[True], c[1:] != c[:-1]])
    firsts = np.flatnonzero(new_class)
    first = firsts[np.cumsum(new_class) - 1]
    covered = d > d[first]
    if in_order:  # any later row of a class is covered, unless it is the same place of a repeated row
        k, s = key[order], start[order]
        covered |= (k != k[first]) | (s != s[first])
    groups = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    several = (np.add.reduceat(new_class.astype(np.int64), groups) > 1)[group]
    if not in_order:  # a class below is sorted by document, so this takes the first of every class
        several &= (np.minimum.reduceat(d, groups) < np.maximum.reduceat(d, groups))[group]
    left = ~covered & (several | (hot[order] == 1))
    kind = np.where(covered, COVERED, np.where(hot[order] == 1, LEFT_FREQUENT, LEFT))
    keep = covered | left
    return order[keep], kind[keep]


#: Shares in which a bucket's anchors are classified, one after the other.
SHARES = 4


def _share(columns: tuple[np.ndarray, ...], share: int) -> tuple[np.ndarray, ...]:
    mine = columns[0] % np.uint64(SHARES) == share
    return tuple(c[mine] for c in columns)


def _spans(bucketed: DataFrame, spec: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, ids, keys, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append((ids, keys, block))
        while held:
            _, parts = held.popitem()
            for share in range(SHARES):  # rows of one anchor are in one share
                yield classified([_share(_unpack(*part), share) for part in parts])

    def classified(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        anchor, context, doc, key, start, length, hot = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        rows, kind = _classes(anchor, context, doc, key, start, length, hot, spec.in_order)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[rows]), pa.array(key[rows]), pa.array(start[rows]), pa.array(start[rows] + length[rows]),
             pa.array(kind.astype(np.int32)), pa.array(anchor[rows].view(np.int64)),
             pa.array(np.where(kind == LEFT_FREQUENT, context[rows], np.uint64(0)).view(np.int64))],
            names=["doc_id", "text_key", "start", "end", "kind", "anchor", "context"])

    return bucketed.repartition("bucket").mapInArrow(tidy(run), SPANS)


def _settled(spans: DataFrame, spec: Repeats, scratch: Scratch) -> DataFrame:
    """Spans in which the contexts of frequent anchors, first of their bucket so far, are the first of all or covered;
    those of anchors with one context alone are left out."""
    hot = spans.where(F.col("kind") == LEFT_FREQUENT)
    place = F.struct("doc_id", "text_key", "start") if spec.in_order else F.col("doc_id")
    # stored: a join straight above an aggregate could not be split where one context is very frequent
    first = scratch.written(hot.groupBy("anchor", "context").agg(F.min(place).alias("first")), "first-places")
    several = scratch.written(first.groupBy("anchor").agg(F.count("*").alias("contexts")), "contexts")
    met = hot.join(first, ["anchor", "context"]).join(several, "anchor")
    later = place > F.col("first")
    met = met.where(later | (F.col("contexts") > 1)).withColumn("kind", F.when(later, COVERED).otherwise(LEFT_FREQUENT))
    return spans.where(F.col("kind") != LEFT_FREQUENT).unionByName(
        scratch.written(met.select(*spans.columns), "frequent-spans"))


# ---- 3. windows that are left ----------------------------------------------------------------------------------

WINDOWS = "anchor long, kind int, doc_id long, text_key long, start int, tokens binary"


def _windows(docs: DataFrame, spans: DataFrame, spec: Repeats) -> DataFrame:
    """Runs of windows that are not inside one covered span, with their tokens, per span that is left."""
    own = spans.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.when(F.col("kind") == COVERED, F.struct("start", "end"))).alias("covered"),
        F.collect_list(F.when(F.col("kind") != COVERED, F.struct("start", "end", "kind", "anchor"))).alias("left"),
    ).where(F.size("left") > 0)
    met = packed(docs).join(own, ["doc_id", "text_key"])
    width = spec.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                tokens, counts = spec.tokens(unpacked(part.column("z")))
                tokens = tokens.astype(spec.dtype)
                bases = np.cumsum(counts) - counts
                n = len(tokens)

                def flat(column: pa.Array, *names: str):
                    """Fields of a list of structs, and the row of each element."""
                    offsets = column.offsets.to_numpy()
                    values = column.flatten()
                    return [np.repeat(np.arange(len(column)), np.diff(offsets)),
                            *(values.field(x).to_numpy(zero_copy_only=False) for x in names)]

                row, s, e = flat(part.column("covered"), "start", "end")
                open_ = np.zeros(n + 1, np.int32)  # over 0 where a window begins inside a covered span
                inside = e - s >= width
                np.add.at(open_, (bases[row] + s)[inside], 1)
                np.add.at(open_, (bases[row] + e - width + 1)[inside], -1)
                free = np.concatenate([[0], np.cumsum(np.cumsum(open_)[:n] == 0)])
                row, s, e, kind, anchor = flat(part.column("left"), "start", "end", "kind", "anchor")
                first, last = bases[row] + s, bases[row] + e - width  # of windows
                # from the first to the last window that is free
                lo = np.searchsorted(free, free[first], side="right") - 1
                hi = np.searchsorted(free, free[np.maximum(last + 1, 0)], side="left") - 1
                keep = (last >= first) & (lo <= hi) & (lo <= last)
                row, lo, hi, kind, anchor = (x[keep] for x in (row, lo, hi, kind, anchor))
                size = tokens.itemsize
                data = tokens.tobytes()
                runs = [data[size * a:size * (b + width)] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(kind.astype(np.int32)), part.column("doc_id").take(pa.array(row)),
                     part.column("text_key").take(pa.array(row)), pa.array((lo - bases[row]).astype(np.int32)),
                     pa.array(runs, pa.binary())], names=["anchor", "kind", "doc_id", "text_key", "start", "tokens"])

    return met.select("doc_id", "text_key", "z", "covered", "left").mapInArrow(tidy(run), WINDOWS)


def window_rows(spec: Repeats, starts: np.ndarray, lengths: np.ndarray, tokens: np.ndarray):
    """Of runs stored one after the other: run, position in its document, place among the tokens and hash of every window."""
    bases = np.cumsum(lengths) - lengths
    n = lengths - spec.width + 1
    run = np.repeat(np.arange(len(n)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = bases[run] + inside
    return run, starts[run] + inside, place, Hashes(spread(tokens))(place, place + spec.width)


def spread(tokens: np.ndarray) -> np.ndarray:
    """Tokens as 64-bit numbers that hash well; bytes are small numbers otherwise."""
    return mix(tokens.astype(np.uint64) + np.uint64(0x51ED270B)) if tokens.dtype == np.uint8 else tokens.astype(np.uint64)


FOUND = "doc_id long, text_key long, start int, end int"


def _resolved(windows: DataFrame, spec: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        del held
        # equal windows have an anchor in common, so anchors may be taken a share at a time
        shares = len(whole) // RESOLVED_RUNS + 1
        share = (mix(whole["anchor"].to_numpy().view(np.uint64)) >> np.uint64(20)) % np.uint64(shares)
        for number in range(shares):
            table = whole.take(pa.array(np.flatnonzero(share == number)))
            if not len(table):
                continue
            rows = {
                "doc": table["doc_id"].to_numpy(), "key": table["text_key"].to_numpy(), "start": table["start"].to_numpy(),
                "length": pc.binary_length(table["tokens"]).to_numpy() // np.dtype(spec.dtype).itemsize,
                "tokens": np.frombuffer(b"".join(table["tokens"].to_pylist()), spec.dtype),
            }
            which, start, end = spec.resolve(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["doc"][which]), pa.array(rows["key"][which]), pa.array(start.astype(np.int32)),
                 pa.array(end.astype(np.int32))], names=["doc_id", "text_key", "start", "end"])

    return windows.repartition("anchor").mapInArrow(tidy(run), FOUND)


def _resolved_frequent(windows: DataFrame, spec: Repeats, scratch: Scratch) -> DataFrame:
    """The windows of frequent anchors, each resolved by the earliest place of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, RESOLVED_RUNS) for b in batches for at in range(0, len(b), RESOLVED_RUNS)):
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), spec.dtype)
            lengths = pc.binary_length(batch.column("tokens")).to_numpy() // np.dtype(spec.dtype).itemsize
            row, start, _, window = window_rows(spec, batch.column("start").to_numpy(), lengths, tokens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), batch.column("doc_id").take(pa.array(row)),
                 batch.column("text_key").take(pa.array(row)), pa.array(start.astype(np.int32))],
                names=["window", "doc_id", "text_key", "start"])

    rows = windows.mapInArrow(tidy(run), "window long, doc_id long, text_key long, start int")
    place = F.struct("doc_id", "text_key", "start") if spec.in_order else F.col("doc_id")
    first = rows.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    first = scratch.written(first.select("window", "first"), "first-windows")
    again = rows.join(first, "window").where(place > F.col("first"))
    return again.select("doc_id", "text_key", "start", (F.col("start") + spec.width).alias("end"))


# ---- all together ----------------------------------------------------------------------------------------------


def _release(*frames: DataFrame) -> None:
    """Let Spark's cleaner find the shuffle files of finished steps: they are kept until their plans are collected."""
    spark = frames[0].sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed_spans(docs: DataFrame, spec: Repeats) -> DataFrame:
    """doc_id, text_key, spans: an array of (start, end) that may overlap, of documents that lose something.

    Only these rows stay in the shared folder.
    """
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, (size["bytes"] or 0) // BUCKET_BYTES + 1)
    frequent = _frequent(docs, spec, size.n)
    spans = scratch.written(_spans(_bucketed(docs, spec, buckets, frequent), spec), "context-spans")
    _release(spans)
    spans = _settled(spans, spec, scratch)
    windows = scratch.written(_windows(docs, spans, spec), "left-windows")
    _release(windows)
    fine = _resolved(windows.where(F.col("kind") == LEFT).select("anchor", "doc_id", "text_key", "start", "tokens"), spec)
    coarse = _resolved_frequent(
        windows.where(F.col("kind") == LEFT_FREQUENT).select("doc_id", "text_key", "start", "tokens"), spec, scratch)
    whole = spans.where(F.col("kind") == COVERED).select("doc_id", "text_key", "start", "end")
    found = whole.unionByName(fine).unionByName(coarse)
    found = written(
        found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "removed-spans")
    scratch.remove()
    _release(found)
    return found


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n tokens are inside a span."""
    edges = np.zeros(n + 1, np.int32)
    np.add.at(edges, start, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges)[:n] > 0


def apply_spans(docs: DataFrame, spans: DataFrame, cut: Callable, schema: str, carry: bool = False) -> DataFrame:
    """Every document with its spans: doc_id and what ``cut(text, start, end)`` gives, as in ``schema``; ``carry``: and
    the struct ``rest`` of its other columns."""
    moved = packed(docs, carry)
    met = moved.join(spans, ["doc_id", "text_key"], "left")
    kept = ["doc_id", *["rest"] * carry]
    names = [field.split()[0] for field in schema.split(", ")]
    full = StructType([*(moved.schema[n] for n in kept), *StructType.fromDDL(schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("spans")
            offsets, values = column.offsets.to_numpy(), column.flatten()
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            ends = np.cumsum(lengths)
            start, end = (values.field(x).to_numpy(zero_copy_only=False) for x in ("start", "end"))
            rows = [cut(text, start[b - n:b], end[b - n:b]) for text, n, b in
                    zip(unpacked(batch.column("z")), lengths.tolist(), ends.tolist(), strict=True)]
            values = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}
            yield pa.RecordBatch.from_pydict(
                {**{n: batch.column(n) for n in kept}, **values})

    return met.select(*kept, "z", "spans").mapInArrow(tidy(run), full)
