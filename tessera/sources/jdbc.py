"""Live databases over JDBC.

Not exercised in this repository's tests: no database server may be started
here and no PostgreSQL/MySQL driver jar is installed. The functions are plain
Spark JDBC reads and writes with the partitioning options a large table needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

INSERT_BATCH = 500  # rows per JDBC batch, as the reference's restore


def read_table(spark: SparkSession, url: str, table: str, props: Mapping[str, str] | None = None,
               partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
               partitions: int = 64) -> DataFrame:
    """S2 for one table: a partitioned scan when a numeric key and its bounds are given (each
    partition is its own range query), else a single-partition scan."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (props or {}).items():
        r = r.option(k, v)
    if partition_column and lower is not None and upper is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", partitions))
    return r.load()


def read_database(spark: SparkSession, url: str, tables: Sequence[str], props: Mapping[str, str] | None = None,
                  keys: Mapping[str, tuple[str, int, int]] | None = None) -> dict[str, DataFrame]:
    """Every listed base table (``keys`` gives (column, lower, upper) per table to partition)."""
    out = {}
    for t in tables:
        k = (keys or {}).get(t)
        out[t] = read_table(spark, url, t, props, *(k if k else (None, None, None)))
    return out


def restore_to_database(tables: Mapping[str, DataFrame], order: Sequence[str], url: str,
                        props: Mapping[str, str] | None = None, truncate: bool = True) -> None:
    """Write tables in FK load order (T2), truncating then appending in batches of 500."""
    for t in order:
        if t not in tables:
            continue
        w = (tables[t].write.format("jdbc").option("url", url).option("dbtable", t)
             .option("batchsize", INSERT_BATCH).option("truncate", str(truncate).lower()))
        for k, v in (props or {}).items():
            w = w.option(k, v)
        w.mode("overwrite").save()
