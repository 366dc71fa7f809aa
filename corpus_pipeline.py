"""A corpus from raw documents to packed sequences, one operator per stage.

1. ``quality``: documents that the discriminant rejects go.
2. ``near_dedup``: of each group of texts that share 0.8 or more of their five-word shingles the first document stays.
3. ``substring_dedup``: bytes that 50-byte strings of earlier documents cover go, by whole characters.
4. ``mix``: sources at tempered weights; none is repeated more than ``mixing.MAX_REPEATS`` times, every document occurs.
5. ``pack``: token sequences, one row per piece; a document that the mixture repeats is packed as often.

Every stage is written to the shared folder and read again, so a lost executor costs a re-read of one stage. SQL cannot
say these stages, so there is none; the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortspark.llm import mixing, near_copies, packing, quality, simhash, suffix
from cohortspark.llm.common import table, written
from cohortspark.llm.queries import tokenizer_path

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, near_copies.near_copies(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.realise(docs, mixing.mixture(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix", mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
