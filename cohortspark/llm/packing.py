"""Packing documents into token sequences of bounded length by best-two-fit.

1. Tasks tokenize documents, append the end id, cut what is longer than a sequence, and number the pieces of every
   length they made. Texts never move; a piece is a narrow row, stored once.
2. What decides a packing is how many pieces there are of each length, a table of at most ``capacity`` rows at any size
   of the input. ``plan`` packs these counts: the longest piece opens a sequence, the longest piece that fits is added
   until none does, then the smallest piece of the sequence is replaced by the two remaining pieces that fill its
   enlarged gap more tightly, if there are such. While the counts allow, the same choice would be made again, so a
   choice is taken for as many sequences at once and the plan stays small.
3. A piece's place follows from its length and its number among the pieces of that length, by a search in the plan.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; an empty
table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cohortspark.llm.common import map_batches, written

CAPACITY = 4096
END_ID = 1
#: Distinct parts of words that a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 700_000
#: Characters tokenized at a time.
CHUNK_CHARS = 8_000_000


class _Spans:
    """Spans of one growing array, by number."""

    def __init__(self) -> None:
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.data, self.n, self.used = np.zeros(1 << 14, np.int32), 0, 0

    def add(self, lengths: np.ndarray, data: np.ndarray) -> None:
        while self.n + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.resize(a, 2 * len(a)) for a in (self.starts, self.lengths))
        while self.used + len(data) > len(self.data):
            self.data = np.resize(self.data, 2 * len(self.data))
        self.starts[self.n:self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n:self.n + len(lengths)] = lengths
        self.data[self.used:self.used + len(data)] = data
        self.n += len(lengths)
        self.used += len(data)

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans one after the other, and the end of each."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) - np.repeat(ends - lengths, lengths)
        return self.data[np.repeat(self.starts[numbers], lengths) + inside], ends


class WordTokens:
    """Ids of texts by way of their words and the words' parts.

    White space separates tokens in this vocabulary and is dropped, so a text's ids are those of its words in order. A
    word of plain Latin letters, digits and ASCII marks is cut into the parts that the vocabulary's own splitting makes
    of it, and each distinct part is tokenized once; any other word is a part of its own, split by the tokenizer. Words
    are told apart and cut by Arrow, a batch at a time; only parts that are new meet the tokenizer.
    """

    #: The splitting of the vocabulary, for lower-case texts of these characters, and its word end.
    PLAIN = r"^[\x21-\x7E\x{C0}-\x{FF}]+$"
    PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|[a-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+|[0-9]|[^a-z0-9\x{DF}-\x{F6}\x{F8}-\x{FF}]+)"
    WORD_END = "</w>"
    SPECIAL = "<|"
    #: Parts that go to the tokenizer as one text.
    TOGETHER = 512

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.WORD_END)]] = True
        self._forget_parts()

    def _forget_parts(self) -> None:
        self.part_numbers: dict[str, int] = {}
        self.parts = _Spans()

    def _plain(self, words: pa.Array) -> pa.Array:
        return pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.invert(pc.match_substring(words, self.SPECIAL)))

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        is_plain = self._plain(pa.array(parts, pa.large_string())).to_pylist()
        plain = [p for p, yes in zip(parts, is_plain, strict=True) if yes]
        if plain:
            got = self._encoded([" ".join(plain[i:i + self.TOGETHER]) for i in range(0, len(plain), self.TOGETHER)])
            ids = np.array([i for g in got for i in g], np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the vocabulary does not end every part with a word end")
            self._add_parts(plain, np.diff(ends, prepend=0), ids)
        other = [p for p, yes in zip(parts, is_plain, strict=True) if not yes]
        if other:
            got = self._encoded(other)
            self._add_parts(other, np.array([len(g) for g in got]), np.array([i for g in got for i in g], np.int32))

    def _add_parts(self, parts: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        for part in parts:
            self.part_numbers[part] = len(self.part_numbers)
        self.parts.add(lengths, ids)

    def _cut(self, words: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of all words in order, and where each word's parts end. A space behind every part tells them apart."""
        cut = pc.replace_substring_regex(pc.utf8_lower(words), self.PARTS, r"\1 ")
        whole = pc.binary_join_element_wise(words, "", " ")
        split = pc.ascii_split_whitespace(pc.if_else(self._plain(words), cut, whole))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        behind = np.ones(offsets[-1], bool)
        behind[offsets[1:] - 1] = False  # the empty text behind the last space
        parts = split.flatten().filter(pa.array(behind)).dictionary_encode()
        return parts, offsets[1:] - np.arange(1, len(words) + 1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in order, and the number of ids of each text."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.part_numbers) > REMEMBERED:
            self._forget_parts()
        parts, part_ends = self._cut(words.dictionary)
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self.part_numbers
        new = [p for p in distinct if p not in numbers]
        if new:
            self._learn_parts(new)
        known = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))
        data, id_ends = self.parts.take(known[parts.indices.to_numpy()])
        spans = _Spans()
        spans.add(np.diff(np.concatenate([[0], id_ends])[part_ends], prepend=0), data)
        ids, word_ends = spans.take(words.indices.to_numpy())
        offsets = split.offsets.to_numpy()
        return ids, np.diff(np.concatenate([[0], word_ends])[offsets - offsets[0]])


#: What a worker has learnt, by vocabulary.
_LEARNT: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _LEARNT:
        _LEARNT[path] = WordTokens(path)
    return _LEARNT[path]


PIECES = StructType([
    StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()),
    StructField("length", LongType()), StructField("ids_crc32", LongType()),
    StructField("part", IntegerType()), StructField("number", LongType()),
])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, numbered per task and length (``part``, ``number``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, part = word_tokens(tokenizer), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            while at < len(batch):
                base = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, base + CHUNK_CHARS)))
                chunk = batch.slice(at, to - at)
                at = to
                ids, lengths = tokens(pc.fill_null(chunk.column(1), ""))
                ends = np.cumsum(lengths)
                n_pieces = lengths // capacity + 1
                doc = np.repeat(np.arange(len(chunk)), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, lengths[doc] + 1 - start)
                last = start + length == lengths[doc] + 1
                frm = (ends - lengths)[doc] + start
                data, tail = ids.astype("<u4").tobytes(), np.uint32(end_id).astype("<u4").tobytes()
                crc = np.empty(len(doc), np.int64)
                for i, (a, n, z) in enumerate(zip(frm.tolist(), length.tolist(), last.tolist(), strict=True)):
                    value = zlib.crc32(memoryview(data)[4 * a:4 * (a + n - z)])
                    crc[i] = zlib.crc32(tail, value) if z else value
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else []
                counts = np.diff(np.append(first, len(ordered))).astype(np.int64)
                number = np.empty(len(doc), np.int64)
                number[order] = np.arange(len(ordered)) - np.repeat(first, counts) + made[ordered]
                made[ordered[first]] += counts
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)),
                     pa.array(number)], names=PIECES.names)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over counts of lengths: (number of sequences, [(length, copies), ...]) of every choice made."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made = []
    present = np.flatnonzero(left)
    top = capacity
    while True:
        while top > 0 and left[top] == 0:
            top -= 1
        if top == 0:
            return made
        chosen: dict[int, int] = {top: 1}
        left[top] -= 1
        gap = capacity - top
        while gap:
            at = int(np.searchsorted(present, gap, side="right")) - 1
            while at >= 0 and left[present[at]] == 0:
                at -= 1
            if at < 0:
                break
            fit = int(present[at])
            take = int(min(left[fit], gap // fit))
            chosen[fit] = chosen.get(fit, 0) + take
            left[fit] -= take
            gap -= take * fit
        if gap:
            smallest = min(chosen)
            room = gap + smallest
            pair = _two(left, present, smallest, room) if len(chosen) > 1 or chosen[smallest] > 1 else None
            if pair:
                chosen[smallest] -= 1
                left[smallest] += 1
                for length in pair:
                    chosen[length] = chosen.get(length, 0) + 1
                    left[length] -= 1
        items = [(length, n) for length, n in sorted(chosen.items(), reverse=True) if n]
        for length, n in items:
            left[length] += n
        times = int(min(left[length] // n for length, n in items))
        for length, n in items:
            left[length] -= n * times
        made.append((times, items))
        if len(made) % 256 == 0:
            present = np.flatnonzero(left)


def _two(left: np.ndarray, present: np.ndarray, smallest: int, room: int) -> tuple[int, int] | None:
    """Two remaining lengths whose sum is over ``smallest``, at most ``room`` and as large as can be."""
    have = present[: np.searchsorted(present, room)]
    have = have[left[have] > 0]
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, side="right") - 1
    ok = at >= 0
    # a pair of one length twice needs two pieces of it; else the next shorter partner is taken
    alone = ok & (at == np.arange(len(have))) & (left[have] < 2)
    at = np.where(alone, at - 1, at)
    ok &= at >= 0
    if not ok.any():
        return None
    sums = np.where(ok, have + have[np.maximum(at, 0)], 0)
    best = int(np.argmax(sums))
    return (int(have[best]), int(have[at[best]])) if sums[best] > smallest else None


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for stored pieces."""
    spark = pieces.sparkSession
    tasks = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments: dict[int, list] = {}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for times, items in plan(counts, capacity):
        offset = 0
        for length, n in items:
            segments.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in segments.items()})
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            for rows in np.split(order, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1):
                if not len(rows):
                    continue
                size = int(length[rows[0]])
                first, base, copies, frm = tables.value[size]
                at = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[at]
                where[rows] = base[at] + inside // copies[at]
                offset[rows] = frm[at] + inside % copies[at] * size
            yield pa.RecordBatch.from_arrays(
                [batch.column(f) for f in fields] + [pa.array(where), pa.array(offset)],
                names=[*fields, "sequence_id", "offset"])

    ranked = pieces.join(tasks.select("length", "part", "before"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("number"))
    return ranked.select(*fields, "rank").mapInArrow(locate, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
