"""Text files as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.operators.ordered import row_numbers


def numbered_lines(spark: SparkSession, pattern: str, **limits: int) -> DataFrame:
    """(file, line, value) with lines counted from 1 in each file.

    A large file is read in blocks. Blocks are ordered by where they start and lines inside a block
    by how they are read, so numbering one huge file is cut at block borders.
    """
    lines = spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        "value",
    )
    numbered = row_numbers(lines, ["file"], [("_block", False), ("_place", False)], "line", **limits)
    return numbered.select("file", "line", "value")
