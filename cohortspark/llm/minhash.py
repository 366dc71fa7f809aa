"""Document fingerprints by one-permutation MinHash, in built-in expressions only.

A text's five-word shingles are hashed once; the top bits of a hash name its bin and each bin keeps its smallest hash.
An empty bin borrows from the first bin with a value along a random walk of its own over all bins (optimal
densification), so that two texts borrow alike where their bins agree. The low eight bits of every bin are packed, eight
bins to a long. A pair of unrelated bins agrees in eight bits once in 256, and likeness is corrected for that.

Everything happens inside a row: hashes are sorted together with one sentinel per bin, the largest hash of the bin, and
the first element of every bin is its minimum, the sentinel where it is empty. No shuffle is needed to fingerprint.

Words are runs of anything but ASCII white space, unchanged. Defined results: a text of one to four words has one shingle,
all its words; a text without words, like null, has the empty fingerprint, which is like another empty one (1) and
unlike any other (0).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, functions as F

from cohortspark.llm.common import words_of

BINS, BITS, SHINGLE_WORDS = 256, 8, 5
#: Steps of the walk that are spelled out; the rest of the walk is one search over all bins.
STEPS = 12
_SHIFT = 56
_REST = (1 << _SHIFT) - 1
_FOLDS = ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101))


def _walks() -> list[tuple[int, int]]:
    """Per bin the start and the odd stride of its walk over all bins."""
    draw = random.Random(5)
    return [(draw.randrange(BINS), draw.randrange(BINS // 2) * 2 + 1) for _ in range(BINS)]


def shingle_hashes(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Hashes of all word shingles, repeats included."""
    def hashes(own: Column) -> Column:
        several = F.transform(
            F.sequence(F.lit(0), F.size(own) - words), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(words)]))
        few = F.when(F.size(own) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(own)))
        return F.when(F.size(own) >= words, several).otherwise(few)

    # a one-element array binds the word hashes to a name, so that they are computed once
    bound = F.array(F.transform(words_of(text), lambda word: F.xxhash64(word)))
    return F.flatten(F.transform(bound, hashes))


def _densified(minima: Column) -> Column:
    walks = _walks()
    nowhere = F.lit(None).cast("bigint")
    values = F.transform(minima, lambda x: F.when(x.bitwiseAND(F.lit(_REST)) != _REST, x).otherwise(nowhere))
    ints = lambda numbers: F.array(*[F.lit(n) for n in numbers])
    spelled = [ints([(a + b * j) % BINS for a, b in walks]) for j in range(STEPS)]
    first, stride = ints([a for a, _ in walks]), ints([b for _, b in walks])

    def fill(own: Column) -> Column:
        def borrow(x: Column, i: Column) -> Column:
            rest = F.sequence(F.lit(STEPS), F.lit(BINS - 1))
            walk = F.transform(rest, lambda j: F.get(own, (F.get(first, i) + F.get(stride, i) * j) % BINS))
            return F.coalesce(x, *[F.get(own, F.get(s, i)) for s in spelled],
                              F.get(F.filter(walk, lambda v: v.isNotNull()), 0))
        return F.transform(own, borrow)

    return F.flatten(F.transform(F.array(values), fill))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint: 32 longs, or none for a text without words."""
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                            lambda b: F.shiftleft(b.cast("long"), _SHIFT).bitwiseOR(F.lit(_REST)))

    def minima(hashes: Column) -> Column:
        def firsts(ordered: Column) -> Column:
            return F.filter(ordered, lambda x, i: (i == 0) | (
                F.shiftright(x, _SHIFT) != F.shiftright(F.get(ordered, i - 1), _SHIFT)))
        return F.flatten(F.transform(F.array(F.sort_array(F.concat(hashes, sentinels))), firsts))

    def packed(bins: Column) -> Column:
        def eight(w: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(8):
                low = F.get(bins, w * 8 + k).bitwiseAND(F.lit(255).cast("long"))
                out = out.bitwiseOR(F.shiftleft(low, 8 * k))
            return out
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), eight)

    def whole(hashes: Column) -> Column:
        some = F.flatten(F.transform(F.array(_densified(minima(hashes))), packed))
        return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(some)

    return F.flatten(F.transform(F.array(shingle_hashes(text)), whole))


def as_text(fp: Column) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(one: Column, two: Column) -> Column:
    """Estimated share of common shingles, 0 to 1: the share of equal bins, corrected for chance agreement; null beside
    a missing fingerprint."""
    def equal_bytes(pair: Column) -> Column:
        x = pair["a"].bitwiseXOR(pair["b"])
        for shift, mask in _FOLDS:  # leaves the lowest bit of every byte that is not zero
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        return F.lit(8) - F.bit_count(x)

    pairs = F.arrays_zip(one.alias("a"), two.alias("b"))
    equal = F.aggregate(F.transform(pairs, equal_bytes), F.lit(0), lambda total, n: total + n)
    chance = 1.0 / (1 << BITS)
    corrected = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1 - chance))
    known = one.isNotNull() & two.isNotNull()
    return (F.when(~known, F.lit(None).cast("double")).when((F.size(one) == 0) & (F.size(two) == 0), 1.0)
            .when((F.size(one) == 0) | (F.size(two) == 0), 0.0).otherwise(corrected))
