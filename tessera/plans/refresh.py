"""Refresh flow: drift between a revision's catalog and the live catalog of one database, applied to
the data (SURVEY §3.3: A8 -> P9 -> J2 -> J3 -> J4 -> A5/A6 -> G3 -> S7).

Fingerprints cover every table and the enums, as the export's do; excluded tables are
left out of the diff only. Equal fingerprints skip the diff. Different fingerprints with
an empty diff update the revision's manifest (G4) and leave its data. The
report's own suggestions replace the source's remote rewrite step; any change without a
suggestion that needs a decision stops the refresh.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import drift as D
from tessera.operators.catalog import exclude_tables, schema_fingerprint
from tessera.operators.generate import apply_refresh_plan, typed_plan
from tessera.sources import store


def refresh_revision(spark: SparkSession, root: str, scenario: str, old_cols: DataFrame, live_cols: DataFrame,
                     excluded: list[str] | None = None, key_cols: Mapping[str, list[str]] | None = None,
                     revision: str | None = None, db_id: str | None = None, old_enums: DataFrame | None = None,
                     live_enums: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Returns (drift report, new revision row counts or None when no data changed).

    With ``db_id`` only that database's catalogs count, whatever else the frames hold."""
    if db_id is not None:
        one = F.col("db_id") == db_id
        old_cols, live_cols = old_cols.where(one), live_cols.where(one)
        old_enums, live_enums = (e.where(one) if e is not None else None for e in (old_enums, live_enums))
    old_fp = schema_fingerprint(old_cols, old_enums).select("db_id", "fingerprint")
    live_fp = schema_fingerprint(live_cols, live_enums).select("db_id", "fingerprint")
    old_cols = exclude_tables(old_cols, excluded or [])
    live_cols = exclude_tables(live_cols, excluded or [])
    databases = old_cols.select("db_id").union(live_cols.select("db_id")).distinct()
    if live_fp.select("db_id").distinct().count() > 1:
        raise ValueError("a revision belongs to one database: name it with db_id")
    if old_fp.exceptAll(live_fp).isEmpty() and live_fp.exceptAll(old_fp).isEmpty():
        return D.drift_report(D.classify_drift(D.schema_diff(old_cols, old_cols), old_cols, old_cols), databases), None

    changes = D.schema_diff(old_cols, live_cols)
    classified = D.classify_drift(changes, old_cols, live_cols)
    report = D.drift_report(classified, databases)
    plan = typed_plan(classified, live_cols)  # schema-sized
    rev, manifest = store.resolve(spark, root, scenario, revision)
    if not plan:
        stored = live_fp.select("db_id", F.lit(manifest.get("schemaFingerprint") or "").alias("schema_fingerprint"))
        synced = D.sync_fingerprint(stored, live_fp, changes).collect()  # one row per database
        if synced:
            store.update_manifest(spark, root, scenario, rev, schemaFingerprint=synced[0].schema_fingerprint)
        return report, None
    new = apply_refresh_plan(store.read_revision(spark, root, scenario, rev), plan, key_cols)
    fp_rows = live_fp.collect()  # one row per database
    counts = store.write_snapshot(spark, root, scenario, new, source="refresh",
                                  schema_fingerprint=fp_rows[0].fingerprint if fp_rows else "")
    return report, counts
