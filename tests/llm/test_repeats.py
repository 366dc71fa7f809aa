"""Substring operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from cohortspark.llm import recompress, repeats, suffix


def removed_bytes(rows):
    """What op 3 removes, by a set of all earlier strings; rows of one id are not earlier than each other."""
    seen, out = set(), []
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append(text)
    for doc_id in sorted(by_id):
        own = set()
        for text in by_id[doc_id]:
            data = (text or "").encode()
            gone = bytearray(len(data))
            for i in range(len(data) - 49):
                if data[i:i + 50] in seen:
                    gone[i:i + 50] = b"\1" * 50
                own.add(data[i:i + 50])
            kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
            out.append((doc_id, len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
        seen |= own
    return sorted(out)


def removed_words(rows):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("operator, brute", [(suffix, removed_bytes), (recompress, removed_words)])
def test_against_brute_force(documents, odd_documents, operator, brute):
    got = sorted(tuple(r) for r in operator.digest(documents).collect())
    assert got == brute([r[:2] for r in odd_documents])
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("operator, brute", [(suffix, removed_bytes), (recompress, removed_words)])
@pytest.mark.parametrize("docs, least", [(4000, 0.01), (4000, 2.0), (1, 0.01)])
def test_frequent_anchors_change_nothing(documents, odd_documents, operator, brute, docs, least, monkeypatch):
    """Whatever counts as frequent, none, some or all, the result is the same."""
    monkeypatch.setattr(repeats, "SAMPLE_DOCS", docs)
    monkeypatch.setattr(repeats, "FREQUENT", least)
    every = lambda d, spec, n: np.unique(spec.candidates([(t[1] or "").encode() for t in odd_documents])[1].view(np.int64))
    if docs == 1:
        monkeypatch.setattr(repeats, "_frequent", every)
    got = sorted(tuple(r) for r in operator.digest(documents).collect())
    assert got == brute([r[:2] for r in odd_documents])


@pytest.mark.parametrize("operator", [suffix, recompress])
def test_awkward_and_empty(awkward, no_documents, odd_documents, operator):
    got = [tuple(r) for r in operator.digest(awkward).collect()]
    assert len(got) == len(odd_documents) + 3
    without_id = [r for r in got if r[0] is None]
    assert [r[2] for r in without_id] == [0, 0]
    repeated = [r for r in got if r[0] == odd_documents[7][0]]
    assert len(repeated) == 2 and repeated[0] == repeated[1]
    assert operator.digest(no_documents).collect() == []


def test_deduplicate_keeps_columns_and_characters(awkward):
    out = suffix.deduplicate(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
    assert all("�" not in r.text for r in rows)


def test_interval_tree_gives_all_maximal_repeats():
    rng = random.Random(1)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 14))) for _ in range(3)]
        places = {}
        for t, text in enumerate(texts):
            for i in range(len(text)):
                for j in range(i + 3, len(text) + 1):
                    places.setdefault(text[i:j], []).append((t, i))
        maximal = {}
        for string, found in places.items():
            if len(found) < 2:
                continue
            left = {texts[t][i - 1] if i else (t, i) for t, i in found}
            right = {texts[t][i + len(string)] if i + len(string) < len(texts[t]) else (t, i) for t, i in found}
            if len(left) > 1 and len(right) > 1:
                maximal[string] = sorted(found)
        assert dict(suffix.maximal_repeats(texts, 3)) == maximal


def test_longest_earlier_against_pairs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        common, docs = rng.integers(0, 6, n - 1), rng.integers(0, 4, n)
        want = [max([min(common[min(i, j):max(i, j)]) for j in range(n) if docs[j] < docs[i]], default=0) for i in range(n)]
        assert suffix.longest_earlier(common, docs, 2).tolist() == [w if w >= 2 else 0 for w in want]


def test_equal_windows_choose_equal_anchors():
    rng = random.Random(4)
    words = [f"x{i}" for i in range(6)]
    shared = " ".join(rng.choice(words) for _ in range(20))
    texts = [f"{' '.join(rng.choice(words) for _ in range(rng.randint(0, 9)))} {shared} {' '.join(rng.choice(words) for _ in range(rng.randint(0, 9)))}".encode()
             for _ in range(40)]
    found = recompress.anchors(texts, repeats.Frequent(np.zeros(0, np.int64)))
    inside = []
    for t, text in enumerate(texts):
        at = len(text.split()) and [i for i in range(len(text.split()) - 19) if text.split()[i:i + 20] == shared.encode().split()][0]
        mine = found.doc == t
        inside.append({int(a) for a, s, e in zip(found.anchor[mine], found.start[mine], found.end[mine], strict=True) if s <= at and at + 20 <= e})
    assert set.intersection(*inside)


def test_recompression_shrinks_and_agrees_inside():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 50, 400).astype(np.uint64)
    parts = [np.concatenate([rng.integers(0, 50, k).astype(np.uint64), shared]) for k in (3, 17)]
    levels = [recompress.parse(p, np.zeros(len(p), np.int64), rounds=4) for p in parts]
    for one, two in zip(*levels, strict=True):
        inner = [set(zip((s.low[(s.low >= len(p) - 400) & (s.high <= len(p))] - (len(p) - 400)).tolist(),
                         s.name[(s.low >= len(p) - 400) & (s.high <= len(p))].tolist(), strict=True))
                 for s, p in ((one, parts[0]), (two, parts[1]))]
        assert inner[0] == inner[1] and inner[0]
    assert len(levels[0][-1].name) < len(parts[0]) / 2
