"""Stored schema versions and the differences between them (for W4, W5 and J7).

Schemas are stored by fingerprint: databases whose schemas are equal share one stored copy, so a fleet's store
grows with its different schemas. Differences are computed for pairs of fingerprints, each pair once
however many databases or datasets ask for it, by the same diff that compares two live catalogs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.drift import change_text, diff_summary, schema_diff
from tessera.operators.history import schema_history, versions_behind
from tessera.operators.revisions import catalog_status


def schema_store(catalogs: DataFrame) -> DataFrame:
    """``catalogs(fingerprint, db_id, table_name, column_name, ...)`` -> one row per fingerprint, table and column.

    Rows without a fingerprint are left out. Equal fingerprints mean equal schemas, so which database a copy is taken from makes
    no difference."""
    return catalogs.where(F.coalesce("fingerprint", F.lit("")) != "").drop("db_id").dropDuplicates(["fingerprint", "table_name", "column_name"])


def version_changes(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """J2 between stored versions: ``pairs(from_fp, to_fp)`` -> (from_fp, to_fp, kind, table_name, column_name, detail, seq).
    Pairs of which a version isn't stored, and equal versions, have no rows."""
    wanted = known_pairs(store, pairs).where("from_fp <> to_fp")
    pair = F.struct("from_fp", "to_fp").alias("db_id")
    side = lambda fp: wanted.select(pair, F.col(fp).alias("fingerprint")).join(store, "fingerprint").drop("fingerprint")
    changes = schema_diff(side("from_fp"), side("to_fp"))
    return changes.select("db_id.from_fp", "db_id.to_fp", "kind", "table_name", "column_name", "detail", "seq")


def known_pairs(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """The different pairs of which both versions are stored."""
    stored = store.select("fingerprint").distinct()
    known = pairs.select("from_fp", "to_fp").where("from_fp IS NOT NULL AND to_fp IS NOT NULL").distinct()
    for fp in ("from_fp", "to_fp"):
        known = known.join(stored.withColumnRenamed("fingerprint", fp), fp, "left_semi")
    return known.select("from_fp", "to_fp")


def version_summaries(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """A5 between stored versions: (from_fp, to_fp, summary, changes), ``-`` and no changes for versions that don't differ; ``changes`` are
    the texts that a check prints, by table and column. Pairs of which a version isn't stored are left out."""
    known = known_pairs(store, pairs)
    changes = version_changes(store, known).withColumn("db_id", F.struct("from_fp", "to_fp"))
    summary = diff_summary(changes, known.select(F.struct("from_fp", "to_fp").alias("db_id"))).select("db_id", "summary")
    text = F.struct("table_name", "column_name", "seq", change_text(F.col("kind"), F.col("table_name"), F.col("column_name"), F.col("detail")).alias("text"))
    listed = changes.groupBy("db_id").agg(F.sort_array(F.collect_list(text)).alias("t")).select("db_id", F.col("t.text").alias("changes"))
    return (summary.join(listed, "db_id", "left")
            .select("db_id.from_fp", "db_id.to_fp", "summary", F.coalesce("changes", F.array().cast("array<string>")).alias("changes")))


def history_with_diffs(observations: DataFrame, store: DataFrame) -> DataFrame:
    """W4 with ``diff_from_previous``: the summary of changes from the version that was current before; null where
    one of the two isn't stored."""
    history = schema_history(observations)
    pairs = history.select(F.col("previous").alias("from_fp"), F.col("fingerprint").alias("to_fp"))
    found = version_summaries(store, pairs).select(F.col("from_fp").alias("previous"), F.col("to_fp").alias("fingerprint"),
                                                   F.col("summary").alias("diff_from_previous"))
    return history.join(found, ["previous", "fingerprint"], "left").select(*history.columns, "diff_from_previous")


def status_with_drift(latest: DataFrame, live: DataFrame, history: DataFrame, store: DataFrame) -> DataFrame:
    """J7 of a check: status, versions behind (W5, null if unknown) and the drift from the stored to the live schema, as a summary and as the list of
    changes. An outdated revision whose schema isn't stored any more is ``noschema``."""
    asked = latest.join(live.select("db_id", F.col("fingerprint").alias("to_fp")), "db_id").withColumnRenamed("schema_fingerprint", "from_fp")
    behind = versions_behind(history, asked.select("db_id", "from_fp", "to_fp").distinct())
    behind = asked.join(behind, ["db_id", "from_fp", "to_fp"]).select("db_id", "revision", "scenario", "behind")
    found = version_summaries(store, asked).withColumnRenamed("from_fp", "schema_fingerprint")
    status = catalog_status(latest, live).join(latest.select("scenario", "db_id", "revision", "schema_fingerprint"), ["scenario", "db_id", "revision"])
    out = (status.join(live.select("db_id", F.col("fingerprint").alias("to_fp")), "db_id", "left")
           .join(found, ["schema_fingerprint", "to_fp"], "left").join(behind, ["scenario", "db_id", "revision"], "left"))
    outdated = F.col("status") == "outdated"
    return out.select("scenario", "db_id", "revision", "schema_short", "live_short",
                      F.when(outdated & F.col("summary").isNull(), "noschema").otherwise(F.col("status")).alias("status"),
                      F.when(outdated, F.col("behind")).alias("behind"), F.when(outdated, F.col("summary")).alias("drift"),
                      F.when(outdated, F.col("changes")).alias("changes"))
