"""Trigram similarity of texts, computed inside Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: least similarity at which two texts count as similar.
SIMILAR_AT = 0.3

# Characters trimmed from both ends of a query text.
TRIMMED = "~!@#$%^&*()-+={}[]|\\:;\"'<>,.?/ "


def trim_query(text: str) -> str:
    return text.strip(TRIMMED)


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text.

    The text is lowered and cut into words of letters and digits; each word is padded with two
    blanks before and one after. Distinct words are taken first and written one per line, so that
    one pass of a look-ahead pattern, which does not cross lines, reads off all trigrams.
    """
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")
    lines = F.concat(F.lit("  "), F.array_join(words, " \n  "), F.lit(" "))
    found = F.array_distinct(F.regexp_extract_all(lines, F.lit("(?=(...))"), F.lit(1)))
    # without any word the one padded line is blank
    return F.array_remove(found, "   ")


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of both texts; 0 when neither has any."""
    pair = F.array(F.struct(trigrams(left).alias("a"), trigrams(right).alias("b")))

    def score(sets: Column) -> Column:
        shared = F.size(F.array_intersect(sets["a"], sets["b"]))
        total = F.size(sets["a"]) + F.size(sets["b"]) - shared
        return F.when(total > 0, shared / total).otherwise(F.lit(0.0))

    # the one-element transform computes each trigram set once per row
    return F.when(left.isNotNull() & right.isNotNull(), F.get(F.transform(pair, score), F.lit(0)))


def is_similar(left: Column, right: Column) -> Column:
    return similarity(left, right) >= SIMILAR_AT
