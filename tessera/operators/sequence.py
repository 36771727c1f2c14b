"""Position and predecessor within ordered groups, safe for hot groups.

``row_number()`` / ``lag()`` over ``Window.partitionBy(group)`` send a whole
group to one task; a group holding a third of all rows becomes a third of the
job in one task. These helpers range-partition by (group, order) instead, so a
hot group is spread over many partitions, compute positions / predecessors
inside each (partition, group) chunk, and stitch chunks together through a
small per-chunk boundary table (one row per chunk). The range-partitioned
frame is checkpointed to the shared folder so the partition assignment is
fixed even if a task is retried.

``order`` must be a total order within a group (add a unique tie-breaker).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _chunked(df: DataFrame, group: list[str], order: list[str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id())
    return cut_lineage(r)


def ordered_index(df: DataFrame, group: list[str], order: list[str], name: str = "idx",
                  partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 0-based position of the row within its group by ``order``."""
    r = _chunked(df, group, order, partitions)
    local = F.row_number().over(Window.partitionBy("_pid", *group).orderBy(*order)) - 1
    r = r.withColumn("_local", local)
    chunks = r.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = chunks.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.partitionBy(*group).orderBy("_pid")
                                              .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (r.join(offsets.select("_pid", *group, "_off"), ["_pid", *group])
            .withColumn(name, (F.col("_local") + F.col("_off")).cast("long"))
            .drop("_pid", "_local", "_off"))


def previous_value(df: DataFrame, group: list[str], order: list[str], value: str, name: str = "prev",
                   partitions: int | None = None) -> DataFrame:
    """Adds ``name``: ``value`` of the preceding row of the group by ``order`` (null for the first)."""
    r = _chunked(df, group, order, partitions)
    w = Window.partitionBy("_pid", *group).orderBy(*order)
    r = r.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last_of_chunk = r.groupBy("_pid", *group).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last_of_chunk.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*group).orderBy("_pid")))
    return (r.join(carry.select("_pid", *group, "_carry"), ["_pid", *group])
            .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
            .drop("_pid", "_lag", "_first", "_carry"))
