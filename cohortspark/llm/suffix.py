"""Suffix-array deduplication: bytes that a string of ``WIDTH`` bytes of an earlier document covers are removed.

A window's anchor is its 20-byte string with the smallest hash, of those that are not frequent if there is one (see
``repeats``). What context classes leave open is
resolved by the interval tree of an enhanced suffix array: the suffixes of the remaining windows are sorted, neighbours
give common prefix lengths, and one scan with a stack visits every interval of suffixes with a common prefix of WIDTH
bytes or more, inner ones first. An interval whose members are preceded by different bytes is a maximal repeat, and its
members are all its occurrences. A member whose document is not the smallest of its interval loses the common prefix.
Strings that the same byte precedes everywhere are left out before sorting: the string one byte to the left says more.

Defined results: a null or empty text has no bytes; documents without an id keep everything and are no one's earlier
document; rows that share an id are not earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm import repeats
from cohortspark.llm.repeats import Anchors, Frequent, Hashes, Repeats, spread

WIDTH, GRAM = 50, 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


def candidates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every 20-byte string."""
    data, lengths = _tokens(texts)
    if len(data) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = Hashes(spread(data)).all_of(GRAM)
    ends = np.cumsum(lengths)
    at = np.arange(len(gram))
    doc = np.searchsorted(ends, at, side="right")
    inside = at + GRAM <= ends[doc]
    return doc[inside], gram[inside]


def anchors(texts: list[bytes], frequent: Frequent) -> Anchors:
    """The 20-byte strings that windows choose."""
    data, lengths = _tokens(texts)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n, grams = len(data), WIDTH - GRAM + 1
    if n < WIDTH:
        return Anchors(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)))
    hashes = Hashes(spread(data))
    gram = hashes.all_of(GRAM)
    rank = (gram >> np.uint64(33)).astype(np.uint32) | np.uint32(1)
    rank[frequent(gram)] |= np.uint32(1 << 31)
    least = _sliding_min(rank, grams)  # of the window that begins here
    crosses = np.zeros(n + 1, np.int32)  # windows that begin in the last 49 bytes of a document do not count
    np.add.at(crosses, np.maximum(bounds[1:] - WIDTH + 1, bounds[:-1]), 1)
    np.add.at(crosses, bounds[1:], -1)
    least[np.cumsum(crosses)[:len(least)] > 0] = 0
    # the largest minimum of the windows that hold a gram is its own rank just if it is the smallest of one of them
    padded = np.concatenate([np.zeros(grams - 1, np.uint32), least, np.zeros(grams - 1, np.uint32)])
    largest = ~_sliding_min(~padded, grams)[:len(rank)]
    at = np.flatnonzero(largest == rank)
    own = rank[at]
    most, fewest = np.full(len(at), -1), np.full(len(at), grams)
    for before in range(grams):  # windows that begin so many bytes before the string
        chose = padded[at + grams - 1 - before] == own
        most[chose] = before
        np.minimum(fewest, before, out=fewest, where=chose)
    docs = np.searchsorted(bounds, at, side="right") - 1
    return repeats.around(docs, at, most, fewest, bounds, WIDTH, hashes, gram[at])


def _common(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbouring rows."""
    different = matrix[1:] != matrix[:-1]
    first = np.where(different.any(axis=1), different.argmax(axis=1), matrix.shape[1])
    return np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of every interval of the tree with a common prefix of ``least`` or more, inner ones first."""
    stack: list[tuple[int, int]] = []
    for at, length in enumerate([*common.tolist(), 0]):
        length = length if length >= least else 0
        begin = at
        while stack and stack[-1][0] > length:
            inner, begin = stack.pop()
            yield inner, begin, at
        if length and (not stack or stack[-1][0] < length):
            stack.append((length, begin))


def longest_earlier(common: np.ndarray, docs: np.ndarray, least: int) -> np.ndarray:
    """Per suffix: the length of the longest common prefix, of ``least`` or more, with one of a smaller document, or 0.

    Of an inner interval only its smallest document and the suffixes of that document go on to the outer one; the others
    have their answer.
    """
    best = np.zeros(len(docs), np.int64)
    doc = docs.tolist()
    open_: dict[int, tuple[int, int, list[int]]] = {}  # by first suffix: last suffix, smallest document, its suffixes
    for length, first, last in intervals(common, least):
        at, parts = first, []
        while at <= last:
            if at in open_:
                end, smallest, own = open_.pop(at)
                parts.append((smallest, own))
                at = end + 1
            else:
                parts.append((doc[at], [at]))
                at += 1
        smallest = min(part[0] for part in parts)
        stay: list[int] = []
        for lowest, own in parts:
            if lowest == smallest:
                stay += own
            else:
                best[own] = length
        open_[first] = (last, smallest, stay)
    return best


def is_maximal(before: np.ndarray, first: int, last: int) -> bool:
    """Whether the members of an interval are preceded by different bytes (a start of a text differs from any)."""
    own = before[first:last + 1]
    return bool((own < 0).any() or own.min() != own.max())


def _sorted_suffixes(tokens: np.ndarray, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and their bytes in that order; a suffix sorts before its extensions."""
    width = -(-int(length.max()) // 8) * 8
    inside = np.arange(width)
    matrix = tokens[np.minimum(place[:, None] + inside, len(tokens) - 1)]
    matrix[inside[None] >= length[:, None]] = 0
    words = matrix.view(">u8").astype(np.uint64)
    order = np.lexsort((length, *words.T[::-1]))
    return order, matrix[order]


def _left_diverse(run: np.ndarray, place: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Whether the windows of a group follow different windows, or one has none before it; rows are in text order."""
    before = np.full(len(group), -1, np.int64)
    follows = (run[1:] == run[:-1]) & (place[1:] == place[:-1] + 1)
    before[1:][follows] = group[:-1][follows]
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
    np.minimum.at(low, group, before)
    np.maximum.at(high, group, before)
    return (low < 0) | (low != high)


def resolve(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Removed spans of stored runs: run, start, end."""
    none = np.zeros(0, np.int64)
    tokens, lengths = rows["tokens"], rows["length"].astype(np.int64)
    run, start, place, window = repeats.window_rows(SPEC, rows["start"].astype(np.int64), lengths, tokens)
    if not len(run):
        return none, none, none
    _, group = np.unique(window, return_inverse=True)
    n = int(group.max()) + 1
    doc = rows["doc"][run]
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc)
    np.maximum.at(high, group, doc)
    shared = (low < high)[group]
    run, start, place, group, doc = (x[shared] for x in (run, start, place, group, doc))
    if not len(run):
        return none, none, none
    wanted = _left_diverse(run, place, group, n)[group]
    run, start, place, doc = (x[wanted] for x in (run, start, place, doc))
    ends = np.cumsum(lengths)
    length = ends[run] - place
    order, matrix = _sorted_suffixes(tokens, place, length)
    best = longest_earlier(_common(matrix, length[order]), doc[order], WIDTH)
    removed = order[best > 0]
    return run[removed], start[removed], start[removed] + best[best > 0]


SPEC = Repeats(WIDTH, np.dtype(np.uint8), False, _tokens, anchors, candidates, resolve)


def maximal_repeats(texts: list[bytes], least: int = WIDTH) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """All maximal repeats of a few texts with all their occurrences (text, position), for one task or a test."""
    data, lengths = _tokens(texts)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(data))
    length = ends[text] - place
    long = length >= least
    if not long.any():
        return []
    text, place, length = text[long], place[long], length[long]
    order, matrix = _sorted_suffixes(data, place, length)
    text, place, length = text[order], place[order], length[order]
    position = place - (ends - lengths)[text]
    before = np.where(position > 0, data[np.maximum(place - 1, 0)].astype(np.int64), -1)
    found = []
    for size, first, last in intervals(_common(matrix, length), least):
        if is_maximal(before, first, last):
            found.append((matrix[first, :size].tobytes(),
                          sorted(zip(text[first:last + 1].tolist(), position[first:last + 1].tolist(), strict=True))))
    return found


def whole_characters(text: bytes, gone: np.ndarray) -> np.ndarray:
    """The removed bytes without those of characters that are removed in part."""
    data = np.frombuffer(text, np.uint8)
    first = (data & 0xC0) != 0x80
    character = np.cumsum(first) - 1
    kept = np.zeros(int(first.sum()), bool)
    kept[character[~gone]] = True
    return gone & ~kept[character]


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    if not len(start):
        return len(text), 0, 0, hashlib.sha256(text).hexdigest()
    gone = repeats.cover(len(text), start, end)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeats.apply_spans(docs, repeats.removed_spans(docs, SPEC), _cut,
                               "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    if not len(start):
        return (text.decode("utf-8", "replace"),)
    gone = whole_characters(text, repeats.cover(len(text), start, end))
    return (np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "replace"),)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with shortened texts and their new ``n_chars``; other columns as they are. Characters that are removed in
    part are kept whole."""
    rows = repeats.apply_spans(docs, repeats.removed_spans(docs, SPEC), _kept_text, "kept string", carry=True)
    return rows.select(*[
        F.col("kept").alias("text") if c == "text" else F.length("kept").cast("long").alias("n_chars") if c == "n_chars"
        else F.col("rest").getField(c).alias(c) for c in docs.columns])
