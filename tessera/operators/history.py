"""Schema history per database from fingerprint sightings.

``observations(db_id, fingerprint, seen_at)``: each time a database's schema
was fingerprinted. Per (db, fingerprint): ``version`` is the order of first
appearance, first/last seen, and ``previous`` the fingerprint that was current
just before the first appearance (trap Q19: a fingerprint seen again keeps its
old version). Version numbering and the predecessor lookup use the
hot-group-safe helpers, so one database with a third of all sightings is still
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.sequence import ordered_index, previous_value


def schema_history(observations: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(db_id, fingerprint, version, first_seen, last_seen, previous[, diff summary]).

    ``summaries(db_id, from_fp, to_fp, summary)`` (A5 between stored schemas)
    is attached as the diff from the previous fingerprint when given.
    """
    # a sighting reported twice is one sighting: the predecessor needs a total order
    obs = observations.select("db_id", "fingerprint", "seen_at").distinct()
    spans = obs.groupBy("db_id", "fingerprint").agg(F.min("seen_at").alias("first_seen"),
                                                    F.max("seen_at").alias("last_seen"))
    versions = ordered_index(spans, ["db_id"], ["first_seen", "fingerprint"], name="_v")
    prev = previous_value(obs, ["db_id"], ["seen_at", "fingerprint"], "fingerprint", name="_prev")
    at_first = prev.select("db_id", "fingerprint", F.col("seen_at").alias("first_seen"), "_prev")
    out = (versions.join(at_first, ["db_id", "fingerprint", "first_seen"], "left")
           .select("db_id", "fingerprint", (F.col("_v") + 1).alias("version"), "first_seen", "last_seen",
                   F.when(F.col("_prev") != F.col("fingerprint"), F.col("_prev")).alias("previous")))
    if summaries is not None:
        s = summaries.select("db_id", F.col("from_fp").alias("previous"), F.col("to_fp").alias("fingerprint"),
                             F.col("summary").alias("diff_from_previous"))
        out = out.join(s, ["db_id", "previous", "fingerprint"], "left")
    return out


def current_fingerprint(observations: DataFrame) -> DataFrame:
    """Fingerprint of the latest sighting per database."""
    return observations.groupBy("db_id").agg(F.max_by("fingerprint", F.struct("seen_at", "fingerprint"))
                                             .alias("current"))


def versions_behind(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(db_id, from_fp, to_fp)`` -> to.version - from.version, or null (unknown) when
    either is absent or the difference is negative; 0 for equal known fingerprints."""
    h = history.select("db_id", "fingerprint", "version")
    f = h.select("db_id", F.col("fingerprint").alias("from_fp"), F.col("version").alias("_fv"))
    t = h.select("db_id", F.col("fingerprint").alias("to_fp"), F.col("version").alias("_tv"))
    j = pairs.join(f, ["db_id", "from_fp"], "left").join(t, ["db_id", "to_fp"], "left")
    diff = F.col("_tv") - F.col("_fv")
    behind = (F.when(F.col("from_fp") == F.col("to_fp"), F.when(F.col("_fv").isNotNull(), F.lit(0)))
              .when(F.col("_fv").isNull() | F.col("_tv").isNull() | (diff < 0), F.lit(None))
              .otherwise(diff))
    return j.select("db_id", "from_fp", "to_fp", behind.cast("int").alias("behind"))
