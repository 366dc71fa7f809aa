"""Trigram index of a text column: similar texts without a look at all texts.

The index holds a posting (trigram, number of the text's trigrams, key) for every trigram of every text, in folders by a
hash of the trigram and in order of trigram and size, so a question reads the postings of its own trigrams only. A second
table has the number of texts of every trigram.

With q trigrams in the question, a text of s trigrams that shares n of them is n / (q + s - n) similar. To be ``at``
similar it must share at least ``at * q``, so it holds one of the rarest ``q - at * q + 1`` trigrams, and its size is
between ``at * q`` and ``q / at``. Only texts that pass both are counted. For the best k, the texts of the rarest trigrams
are scored first; the k-th best of them bounds the rest. Scores are exact.

The index is of the rows it was built from. Texts without a trigram and null texts are similar to nothing and not in it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.functions.similarity import trigrams
from cohortspark.session import written

#: Folders of the postings.
PARTS = 32
#: Texts that are scored first for the best k, per wanted text, about.
SEEDS = 8


def _part(gram: Column, parts: int) -> Column:
    return F.pmod(F.hash(gram), F.lit(parts)).cast("int")


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """gram, size, key: one row per trigram of every text."""
    grams = df.select(F.col(key).alias("key"), trigrams(F.col(text).cast("string")).alias("grams"))
    return grams.select(F.size("grams").alias("size"), "key", F.explode("grams").alias("gram")).select("gram", "size", "key")


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    parts: int
    key_type: str

    # ---------------------------------------------------------------- reading

    def grams_of(self, text: str) -> list[tuple[str, int, int]]:
        """(trigram, its folder, texts that have it) of a question, the rarest first."""
        asked = F.explode(trigrams(F.lit(text))).alias("gram")
        found = self.spark.range(1).select(asked).select("gram", _part(F.col("gram"), self.parts).alias("part")).collect()
        if not found:
            return []
        counts = self.spark.read.schema("gram string, texts long").parquet(f"{self.path}/counts")
        texts = {r.gram: r.texts for r in counts.where(F.col("gram").isin([r.gram for r in found])).collect()}
        return sorted(((r.gram, r.part, texts.get(r.gram, 0)) for r in found), key=lambda g: (g[2], g[0]))

    def all_postings(self) -> DataFrame:
        return self.spark.read.schema(f"gram string, size int, key {self.key_type}, part int").parquet(f"{self.path}/postings")

    def _postings(self, grams: list[tuple[str, int, int]]) -> DataFrame:
        """The postings of some trigrams; other folders are not read."""
        return self.all_postings().where(F.col("part").isin({g[1] for g in grams}) & F.col("gram").isin([g[0] for g in grams]))

    def _scored(self, rows: DataFrame, asked: int) -> DataFrame:
        shared = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("shared"))
        return shared.select("key", (F.col("shared") / (F.col("size") + F.lit(asked) - F.col("shared"))).alias("similarity"))

    def similar(self, text: str, at: float) -> DataFrame:
        """key, similarity of all texts that are ``at`` similar or more; ``at`` is above 0."""
        grams = self.grams_of(text)
        asked = len(grams)
        needed = max(1, math.ceil(at * asked - 1e-9))
        if not asked:
            return self._scored(self._postings([("", 0, 0)]), 1)
        fit = F.col("size").between(needed, math.floor(asked / at + 1e-9))
        rows = self._postings(grams).where(fit)
        rarest = grams[:asked - needed + 1]
        if len(rarest) < asked:
            holders = self._postings(rarest).where(fit).select("key").distinct()
            rows = rows.join(written(holders, "similar-candidates"), "key", "left_semi")
        return self._scored(rows, asked).where(F.col("similarity") >= at)

    def bound(self, text: str, k: int) -> float | None:
        """A similarity that at least k texts reach, close to that of the k-th best; None if fewer share a trigram."""
        grams = self.grams_of(text)
        if not grams or k < 1:
            return None
        seeds, reached = [], 0
        for gram in grams:
            seeds.append(gram)
            reached += gram[2]
            if reached >= SEEDS * k:
                break
        rows = self._postings(grams)
        if len(seeds) < len(grams):
            rows = rows.join(written(self._postings(seeds).select("key").distinct(), "similar-seeds"), "key", "left_semi")
        best = [r.similarity for r in self._scored(rows, len(grams)).orderBy(F.desc("similarity")).limit(k).collect()]
        if len(best) == k:
            return best[-1]
        if len(seeds) == len(grams):
            return None
        best = [r.similarity for r in self._scored(self._postings(grams), len(grams)).orderBy(F.desc("similarity")).limit(k).collect()]
        return best[-1] if len(best) == k else None

    def best(self, text: str, k: int) -> DataFrame | None:
        """key, similarity of the k most similar texts and of all that are as similar as the k-th; None if fewer than k
        texts share a trigram with the question, so that others belong to the answer."""
        at = self.bound(text, k)
        if at is None:
            return None
        return self.similar(text, at)


def build(df: DataFrame, key: str, text: str, path: str, parts: int = PARTS) -> TextIndex:
    """Write the index of a text column below ``path``. ``key`` names the rows, each key one row.

    The postings are cut by ranges of (folder, trigram, size, key), so the postings of a trigram that most texts have are
    many files, each of a range of sizes.
    """
    rows = postings(df, key, text)
    order = ["part", "gram", "size", "key"]
    placed = rows.withColumn("part", _part(F.col("gram"), parts)).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.partitionBy("part").parquet(f"{path}/postings")
    index = TextIndex(df.sparkSession, path.rstrip("/"), parts, df.schema[key].dataType.simpleString())
    counts = index.all_postings().groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    counts.repartitionByRange(4, "gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return index
