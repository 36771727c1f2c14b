"""Registered queries over stored schema versions: the fleet's old and new catalogs are stored under two fingerprints a database,
which is seen with the old one, the new one, the old one again and, for some, with one that was never stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.operators import versions as V
from tessera.workloads.q_catalog import DIFF_CTE
from tessera.workloads.registry import _prep, query

_SUMMARY_SQL = """
dbs AS (SELECT db_id, count(*) AS n FROM cat_new GROUP BY db_id),
counts AS (SELECT db_id, count(*) FILTER (WHERE kind = 'table_added') AS t_add, count(*) FILTER (WHERE kind = 'table_removed') AS t_rem,
             count(*) FILTER (WHERE kind = 'column_added') AS c_add, count(*) FILTER (WHERE kind = 'column_removed') AS c_rem,
             count(*) FILTER (WHERE kind = 'column_changed') AS c_chg, count(*) AS n_changes FROM changes GROUP BY db_id),
summaries AS (SELECT d.db_id, d.n, coalesce(nullif(concat_ws(' ', CASE WHEN t_add > 0 THEN '+' || t_add || ' tbl' END, CASE WHEN t_rem > 0 THEN '-' || t_rem || ' tbl' END,
                CASE WHEN c_add > 0 THEN '+' || c_add || ' col' END, CASE WHEN c_rem > 0 THEN '-' || c_rem || ' col' END,
                CASE WHEN c_chg > 0 THEN '~' || c_chg || ' col' END), ''), '-') AS summary, coalesce(n_changes, 0) AS n_changes
              FROM dbs d LEFT JOIN counts c ON c.db_id = d.db_id)"""


def _fleet(spark, sf_dir):
    """(sightings, store of both catalogs, databases with their number of columns)."""
    _prep(spark, sf_dir, "cat_old", "cat_new")
    old, new = (spark.table(t).withColumn("fingerprint", F.concat("db_id", F.lit(tag))) for t, tag in (("cat_old", "-old"), ("cat_new", "-new")))
    dbs = new.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))
    tags = F.when(F.col("n") % 2 == 0, F.array(*map(F.lit, ("-old", "-new", "-old", "-lost")))).otherwise(F.array(*map(F.lit, ("-old", "-new", "-old"))))
    seen = dbs.select("db_id", F.posexplode(tags).alias("seen_at", "tag")).select("db_id", F.concat("db_id", "tag").alias("fingerprint"), "seen_at")
    return seen, V.schema_store(old.unionByName(new)), dbs


@query("w4_schema_history_diffs", DIFF_CTE + "," + _SUMMARY_SQL + """
SELECT db_id, db_id || '-old' AS fingerprint, 1 AS version, 0 AS first_seen, 2 AS last_seen, NULL AS previous, NULL AS diff_from_previous FROM summaries
UNION ALL
SELECT db_id, db_id || '-new', 2, 1, 1, db_id || '-old', CASE WHEN EXISTS (SELECT 1 FROM cat_old o WHERE o.db_id = s.db_id) THEN summary END FROM summaries s
UNION ALL
SELECT db_id, db_id || '-lost', 3, 3, 3, db_id || '-old', NULL FROM summaries WHERE n % 2 = 0""")
def q_w4_diffs(spark, sf_dir):
    seen, store, _ = _fleet(spark, sf_dir)
    return V.history_with_diffs(seen, store)


@query("j7_catalog_drift", DIFF_CTE + "," + _SUMMARY_SQL + """,
latest AS (SELECT db_id, n, summary, n_changes, CASE n % 5 WHEN 0 THEN NULL WHEN 1 THEN db_id || '-new' WHEN 2 THEN db_id || '-lost' ELSE db_id || '-old' END AS stored,
             CASE WHEN n % 7 = 0 THEN NULL ELSE db_id || '-new' END AS live FROM summaries)
SELECT 'fleet/' || db_id AS scenario, db_id, substr(stored, 1, 12) AS schema_short, substr(live, 1, 12) AS live_short,
  CASE WHEN stored IS NULL OR (stored = db_id || '-lost' AND live IS NOT NULL) THEN 'noschema' WHEN live IS NULL THEN 'unknown'
       WHEN stored = live THEN 'current' ELSE 'outdated' END AS status,
  CASE WHEN stored = db_id || '-old' AND live IS NOT NULL THEN 1 END AS behind,
  CASE WHEN stored = db_id || '-old' AND live IS NOT NULL THEN summary END AS drift,
  CASE WHEN stored = db_id || '-old' AND live IS NOT NULL THEN n_changes END AS n_changes
FROM latest""")
def q_j7_drift(spark, sf_dir):
    seen, store, dbs = _fleet(spark, sf_dir)
    tag = (F.when(F.col("n") % 5 == 1, "-new").when(F.col("n") % 5 == 2, "-lost").when(F.col("n") % 5 > 2, "-old"))
    latest = dbs.select(F.concat(F.lit("fleet/"), "db_id").alias("scenario"), "db_id", F.lit("r001").alias("revision"),
                        F.concat("db_id", tag).alias("schema_fingerprint"))
    live = dbs.where("n % 7 <> 0").select("db_id", F.concat("db_id", F.lit("-new")).alias("fingerprint"))
    out = V.status_with_drift(latest, live, H.schema_history(seen), store)
    return out.withColumn("n_changes", F.size("changes").cast("long")).withColumn("n_changes", F.when(F.col("changes").isNotNull(), F.col("n_changes"))).drop("changes", "revision")
