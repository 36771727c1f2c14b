"""Export flow: catalog -> fingerprint -> snapshot revision.

The catalog of the exported database (``schema_columns`` for one ``db_id``) is
fingerprinted; the tables are written as a new revision carrying that
fingerprint; the sighting is appended to the observation log that W4/X2 fold.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.catalog import schema_fingerprint
from tessera.sources import store


def export_revision(spark: SparkSession, root: str, scenario: str, tables: Mapping[str, DataFrame],
                    cols: DataFrame, enums: DataFrame | None = None, fmt: str = "parquet",
                    observations_path: str | None = None) -> DataFrame:
    fp_row = schema_fingerprint(cols, enums).select("db_id", "fingerprint").collect()  # one row per exported db
    fingerprint = fp_row[0].fingerprint if fp_row else ""
    counts = store.write_snapshot(spark, root, scenario, tables, fmt=fmt, schema_fingerprint=fingerprint)
    if observations_path and fp_row:
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        spark.createDataFrame([(r.db_id, r.fingerprint, now) for r in fp_row],
                              "db_id string, fingerprint string, seen_at timestamp") \
            .write.mode("append").parquet(observations_path)
    return counts
