"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.session import scratch_path, written

__all__ = ["WORD_BREAK", "Scratch", "if_small", "map_batches", "quoted", "table", "text_or_empty", "tidy", "words_of", "written"]

#: Rows of a batch that goes to a Python worker, at most: rows hold whole texts, and both sides hold a batch.
BATCH_ROWS = 500

#: Bytes of the files of a table of keys that is broadcast, at most: more than Spark's own limit, since texts would move.
BROADCAST_BYTES = 16 << 20

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with small batches. The limit is a setting of the session, which is lowered where it is higher."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(tidy(run), schema)


def tidy(run: Callable) -> Callable:
    """``run``, which gives memory back to the system when its task ends: workers live on beside those of later stages, and
    the memory of an executor is shared by all."""
    def wrapped(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return wrapped


def if_small(stored: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its files hold ``BROADCAST_BYTES`` at most; else Spark joins it as any other."""
    size = int(str(stored._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col(f"`{name.replace('`', '``')}`")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; no words give an empty array."""
    return F.filter(F.split(text, WORD_BREAK), lambda word: word != "")


class Scratch:
    """A folder for the tables that an operator needs on its way only; ``remove`` it when the result is stored."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, scratch_path(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """As ``session.written``, in this folder."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
