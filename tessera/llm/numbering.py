"""Gapless positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CHUNK = 10_000


def chunk_bits(rows: int) -> int:
    """Leading bits of a hash that cut ``rows`` rows into chunks of at most about ROWS_PER_CHUNK."""
    return max(0, (max(1, rows) // ROWS_PER_CHUNK).bit_length())


def numbered(df: DataFrame, group: str, key: str, name: str, bits: int) -> DataFrame:
    """``name``: 0-based position of each row in its group by ``key``, a 64-bit hash of the row.

    A group is cut into chunks by the key's leading bits, so a group that holds a third of all rows
    is numbered in many tasks; a table of one row per chunk gives where each chunk starts. Rows with
    equal keys are equal rows, their order among themselves changes nothing."""
    chunked = df.withColumn("_chunk", F.shiftrightunsigned(F.col(key), 64 - bits) if bits else F.lit(0).cast("long"))
    size = chunked.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    start = size.select(F.col(group).alias("_g"), F.col("_chunk").alias("_c"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(key)) - 1
    return (chunked.withColumn("_place", place)
            .join(start, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
            .withColumn(name, F.col("_start") + F.col("_place")).drop("_chunk", "_place", "_g", "_c", "_start"))
