"""Usage event files.

Events are JSON objects (one per line, or one per file with ``multi_line``).
Malformed records are skipped, never fatal. ``mode='go'`` also drops events
with an empty or missing ``state``; ``mode='ts'`` keeps a null state and
requires a string ``testId``. A missing folder is an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = ("testId string, state string, file string, title string, project string, resetMode string, "
                "lastSeenAt string, testHash string, _corrupt_record string")


def read_usage_events(spark: SparkSession, path: str, mode: str = "go", multi_line: bool = False) -> DataFrame:
    from tessera.sources.store import FS

    empty = spark.createDataFrame([], "state string, file string, title string, project string, reset_mode string, "
                                      "last_seen_at timestamp, test_hash string, test_id string")
    if not FS(spark).exists(path):
        return empty
    raw = (spark.read.schema(EVENT_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", multi_line)
           .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    ok = raw.where(F.col("_corrupt_record").isNull())
    if mode == "go":
        ok = ok.where(F.col("state").isNotNull() & (F.col("state") != ""))
    else:
        ok = ok.where(F.col("testId").isNotNull())
    return ok.select("state", F.coalesce("file", F.lit("")).alias("file"), F.coalesce("title", F.lit("")).alias("title"),
                     F.coalesce("project", F.lit("")).alias("project"), F.col("resetMode").alias("reset_mode"),
                     F.try_to_timestamp("lastSeenAt").alias("last_seen_at"), F.col("testHash").alias("test_hash"),
                     F.col("testId").alias("test_id"))


def write_usage_events(events: DataFrame, path: str) -> None:
    """Write usage rows in the event JSON shape (camelCase fields, ISO timestamps)."""
    (events.select(F.col("state"), "file", "title", "project", F.col("reset_mode").alias("resetMode"),
                   F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("lastSeenAt"),
                   F.col("test_hash").alias("testHash"))
     .write.mode("error").json(path))
