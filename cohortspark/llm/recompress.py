"""Substring deduplication by recompression: words that a window of ``WIDTH`` words seen earlier covers are removed.

Words are named by a 64-bit hash. A round first names runs of one symbol by symbol and length, then splits symbols in two
halves by a bit of their name and names every pair of neighbours from the first and the second half. Names depend on
nothing but content, so equal word sequences get the same symbols but for a few at their ends. How far those reach is
known: every symbol carries the span of words that determines it.

A window's anchor is, of the highest-level symbols that it determines, the one with the smallest name, of those that are
not frequent if there is one; so equal windows choose equal anchors. A window that determines no symbol (a long run of one
word) takes its smallest five-word string.
Anchors, their contexts and the remaining windows go the way that ``repeats`` describes; what remains is compared word by
word.

Defined results: a null text has no words; documents without an id keep everything and nothing is earlier in them; rows
that repeat both id and text are one document; of rows with one id and different texts, the smaller digest is earlier.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from cohortspark.llm import repeats
from cohortspark.llm.repeats import Anchors, Frequent, Hashes, Repeats, mix, spread

WIDTH, ROUNDS, GRAM = 20, 2, 5
_FAR = 1 << 40
_BREAKS = bytes([0x20, *range(0x09, 0x0E)])
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words, and the number of words of each text."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    inside = np.ones(256, bool)
    inside[list(_BREAKS)] = False
    word = np.concatenate([[False], inside[data], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    start, end = edges[0::2], edges[1::2]
    hashes = Hashes(spread(data))
    names = mix(hashes(start, end) + (end - start).astype(np.uint64))
    return names, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)])))


class Symbols:
    """Symbols of one level in text order: name, document, and the span of words that determines each."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.doc, self.low, self.high = name, doc, low, high

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per symbol: is its next of the same document, and how far its neighbours reach (not at all at an end)."""
        joined = self.doc[1:] == self.doc[:-1]
        after = np.append(joined, False)
        before = np.concatenate([[False], joined])
        low, high = np.full(len(self.low), -_FAR), np.full(len(self.high), _FAR)
        low[1:][joined] = self.low[:-1][joined]
        high[:-1][joined] = self.high[1:][joined]
        return before, after, low, high

    def runs(self) -> Symbols:
        """Runs of one symbol become a symbol; that a run ends is seen from its neighbours."""
        if not len(self.name):
            return self
        _, _, low, high = self.neighbours()
        first = np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])])
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(first)) - 1
        count = (last - at + 1).astype(np.uint64)
        name = np.where(count > 1, mix(self.name[at] + count * np.uint64(0xA24BAED4963EE407)), self.name[at])
        return Symbols(name, self.doc[at], np.minimum(low[at], self.low[at]), np.maximum(high[last], self.high[last]))

    def pairs(self, level: int) -> Symbols:
        """Neighbours from the first and the second half of all names become a symbol."""
        if not len(self.name):
            return self
        before, after, low, high = self.neighbours()
        second = (mix(self.name ^ np.uint64(0x9FB21C651E98DF25 + level)) & np.uint64(1)).astype(bool)
        opens = ~second & after
        opens[:-1] &= second[1:]
        closes = np.concatenate([[False], opens[:-1]])
        # a symbol of the first half stays alone because of what follows, one of the second because of what precedes
        low_ = np.where(second, low, self.low)
        high_ = np.where(second, self.high, high)
        nxt = np.minimum(np.arange(len(self.name)) + 1, len(self.name) - 1)
        name = np.where(opens, mix(self.name * np.uint64(0xC2B2AE3D27D4EB4F) + mix(self.name[nxt] + np.uint64(level + 1))),
                        self.name)
        low_ = np.where(opens, self.low, np.minimum(low_, self.low))
        high_ = np.where(opens, self.high[nxt], np.maximum(high_, self.high))
        keep = ~closes
        return Symbols(name[keep], self.doc[keep], low_[keep], high_[keep])


def parse(names: np.ndarray, docs: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of every level, from the first round on."""
    at = np.arange(len(names))
    level = Symbols(names, docs, at, at + 1)
    levels = []
    for number in range(rounds):
        level = level.runs().pairs(number)
        levels.append(level)
    return levels


def _choose(low: np.ndarray, high: np.ndarray, rank: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
    """The candidates with the smallest rank in some open window, and how many words before them the first and the last
    window begins that chose them; windows that had any candidate are closed."""
    best = np.full(len(open_), np.iinfo(np.uint64).max, np.uint64)
    reach = WIDTH - (high - low)  # windows begin up to so many words before the candidate
    steps = [(np.flatnonzero((reach >= k) & (low >= k)), k) for k in range(int(reach.max(initial=-1)) + 1)]
    for rows, k in steps:
        np.minimum.at(best, low[rows] - k, rank[rows])
    most, fewest = np.full(len(low), -1), np.full(len(low), WIDTH)
    for rows, k in steps:
        window = low[rows] - k
        chose = rows[open_[window] & (best[window] == rank[rows])]
        most[chose] = k
        fewest[chose] = np.minimum(fewest[chose], k)
    open_ &= best == np.iinfo(np.uint64).max
    at = np.flatnonzero(most >= 0)
    return at, most[at], fewest[at]


def _runs(names: np.ndarray, bounds: np.ndarray, docs: np.ndarray, hashes: Hashes):
    """The spans of words that may be anchors: of each level from the highest, then the five-word strings; with hashes."""
    def hashed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix(hashes(low, high) ^ (high - low).astype(np.uint64))

    for level in parse(names, docs)[::-1]:
        # a candidate lies in one document, since what reaches over an end is never determined
        fits = (level.low >= 0) & (level.high < _FAR) & (level.high - level.low <= WIDTH)
        low, high = level.low[fits], level.high[fits]
        yield low, high, hashed(low, high)
    at = np.flatnonzero(np.arange(len(names)) + GRAM <= bounds[docs + 1])
    yield at, at + GRAM, hashed(at, at + GRAM)


def candidates(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every run of words that may be an anchor."""
    names, counts = _words(texts)
    docs = np.repeat(np.arange(len(texts)), counts)
    runs = list(_runs(names, np.concatenate([[0], np.cumsum(counts)]), docs, Hashes(names)))
    return np.concatenate([docs[low] for low, _, _ in runs]), np.concatenate([anchor for _, _, anchor in runs])


def anchors(texts: list[bytes], frequent: Frequent) -> Anchors:
    """The runs of words that windows choose."""
    names, counts = _words(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = len(names)
    if n < WIDTH:
        return Anchors(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)))
    docs = np.repeat(np.arange(len(texts)), counts)
    open_ = np.arange(n) + WIDTH <= bounds[docs + 1]  # windows that lie in one document
    hashes = Hashes(names)
    found = []
    for low, high, anchor in _runs(names, bounds, docs, hashes):
        if not open_.any():
            break
        near = np.concatenate([[0], np.cumsum(open_)])  # runs that an open window may hold
        held = near[low + 1] > near[np.maximum(high - WIDTH, 0)]
        low, high, anchor = low[held], high[held], anchor[held]
        rank = (anchor >> np.uint64(2)) | (frequent(anchor).astype(np.uint64) << np.uint64(62))
        at, most, fewest = _choose(low, high, rank, open_)
        found.append((low[at], most, fewest, anchor[at]))
    low, most, fewest, anchor = (np.concatenate(c) for c in zip(*found, strict=True))
    return repeats.around(docs[low], low, most, fewest, bounds, WIDTH, hashes, anchor)


def resolve(rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of stored runs whose words stand at an earlier place: run, start, end."""
    none = np.zeros(0, np.int64)
    run, start, place, window = repeats.window_rows(
        SPEC, rows["start"].astype(np.int64), rows["length"].astype(np.int64), rows["tokens"])
    if not len(run):
        return none, none, none
    doc, key = rows["doc"][run], rows["key"][run]
    order = np.lexsort((start, key, doc, window))
    run, start, place, window, doc, key = (x[order] for x in (run, start, place, window, doc, key))
    new = np.concatenate([[True], window[1:] != window[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[first]) | (key != key[first]) | (start != start[first])
    for k in range(WIDTH):  # word by word
        later &= rows["tokens"][place + k] == rows["tokens"][place[first] + k]
    return run[later], start[later], start[later] + WIDTH


SPEC = Repeats(WIDTH, np.dtype("<u8"), True, _words, anchors, candidates, resolve)


def _cut(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    words = _WORD.findall(text)
    if len(start):
        gone = repeats.cover(len(words), start, end)
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    else:
        kept = words
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return repeats.apply_spans(docs, repeats.removed_spans(docs, SPEC), _cut,
                               "n_words long, n_removed long, kept_sha256 string")


def _kept_text(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
    words = _WORD.findall(text)
    gone = repeats.cover(len(words), start, end).tolist()
    return (b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode("utf-8", "replace"),)


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, kept: the words that stay, joined by one space."""
    return repeats.apply_spans(docs, repeats.removed_spans(docs, SPEC), _kept_text, "kept string")
