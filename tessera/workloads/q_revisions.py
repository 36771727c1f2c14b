"""Registered revision-catalog, history and usage-annotation queries.

Revisions are derived from orders (one revision per order, scenario per
customer); schema sightings from events (database per user, fingerprint per
event type).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import history as H
from tessera.operators import revisions as RV
from tessera.operators import usage as U
from tessera.workloads import derived
from tessera.workloads.shared import env_values
from tessera.workloads.registry import _prep, query

_SCEN = "'customers/c' || CAST({k} AS VARCHAR)"
_EXISTING_NAME = "'r' || lpad(CAST(o_orderkey % 997 + 1 AS VARCHAR), 3, '0')"


def _existing(spark):
    o = spark.table("orders")
    name = F.concat(F.lit("r"), F.lpad(((F.col("o_orderkey") % 997) + 1).cast("string"), 3, "0"))
    scen = F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string"))
    existing = (o.where(F.col("o_orderstatus") == "F").select(scen.alias("scenario"), name.alias("revision"))
                .unionByName(o.where(F.col("o_orderstatus") == "P")
                             .select(scen.alias("scenario"), F.lit("draft").alias("revision"))))
    return existing


@query("w2_allocate_revisions", f"""
WITH existing AS (
  SELECT {_SCEN.format(k='o_custkey')} AS scenario, {_EXISTING_NAME} AS revision FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT {_SCEN.format(k='o_custkey')}, 'draft' FROM orders WHERE o_orderstatus = 'P'),
top AS (SELECT scenario, max(CAST(substr(revision, 2) AS BIGINT)) AS mx FROM existing
        WHERE regexp_matches(revision, '^r[0-9]+$') GROUP BY scenario),
new AS (SELECT {_SCEN.format(k='o_custkey')} AS scenario, o_orderkey AS order_key, o_orderdate AS created_at
        FROM orders WHERE o_orderstatus = 'O')
SELECT n.scenario, n.order_key, n.created_at,
       coalesce(t.mx, 0) + row_number() OVER (PARTITION BY n.scenario ORDER BY n.created_at, n.order_key) AS n,
       printf('r%03d', coalesce(t.mx, 0) + row_number() OVER (PARTITION BY n.scenario ORDER BY n.created_at, n.order_key)) AS revision
FROM new n LEFT JOIN top t ON n.scenario = t.scenario""")
def q_w2(spark, sf_dir):
    _prep(spark, sf_dir)
    o = spark.table("orders")
    new = o.where(F.col("o_orderstatus") == "O").select(
        F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string")).alias("scenario"),
        F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("created_at"))
    return RV.allocate_revisions(_existing(spark), new, ["created_at", "order_key"])


@query("w1_resolve_revision", f"""
WITH existing AS (
  SELECT {_SCEN.format(k='o_custkey')} AS scenario, {_EXISTING_NAME} AS revision FROM orders WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT {_SCEN.format(k='o_custkey')}, 'draft' FROM orders WHERE o_orderstatus = 'P'),
scen AS (SELECT DISTINCT {_SCEN.format(k='o_custkey')} AS scenario FROM orders),
ptr AS (SELECT scenario, arg_max(revision, CAST(substr(revision, 2) AS BIGINT)) AS latest FROM existing
        WHERE regexp_matches(revision, '^r[0-9]+$') GROUP BY scenario),
req AS (SELECT c_custkey AS request_id, {_SCEN.format(k='c_custkey')} AS scenario,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'r001' WHEN 'MACHINERY' THEN 'draft' END AS revision FROM customer),
r AS (SELECT req.*, s.scenario IS NOT NULL AS known, p.latest, coalesce(req.revision, p.latest) AS want
      FROM req LEFT JOIN scen s ON s.scenario = req.scenario LEFT JOIN ptr p ON p.scenario = req.scenario),
st AS (SELECT r.*, CASE WHEN NOT known THEN 'missing_scenario' WHEN want IS NULL THEN 'no_revisions'
         WHEN NOT EXISTS (SELECT 1 FROM existing e WHERE e.scenario = r.scenario AND e.revision = r.want)
         THEN 'unknown_revision' ELSE 'ok' END AS status FROM r)
SELECT request_id, scenario, revision AS requested, CASE WHEN status = 'ok' THEN want END AS resolved, status FROM st""")
def q_w1(spark, sf_dir):
    _prep(spark, sf_dir)
    existing = _existing(spark)
    scen = spark.table("orders").select(F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string"))
                                        .alias("scenario")).distinct()
    c = spark.table("customer")
    req = c.select(F.col("c_custkey").alias("request_id"),
                   F.concat(F.lit("customers/c"), F.col("c_custkey").cast("string")).alias("scenario"),
                   F.when(F.col("c_mktsegment") == "BUILDING", "r001").when(F.col("c_mktsegment") == "MACHINERY", "draft")
                   .alias("revision"))
    pointers = RV.latest_pointers(existing.where(F.col("revision").rlike(RV.REV_NUMBER)))
    return RV.resolve_revisions(req, scen, existing, pointers)


@query("w3_revision_history", f"""
WITH revs AS (
  SELECT {_SCEN.format(k='o_custkey')} AS scenario, {_EXISTING_NAME} AS revision,
         sha256(o_orderpriority) AS schema_fingerprint,
         CASE o_orderstatus WHEN 'F' THEN 'export' WHEN 'O' THEN 'generate' ELSE 'refresh' END AS source
  FROM orders),
ptr AS (SELECT scenario, arg_max(revision, CAST(substr(revision, 2) AS BIGINT)) AS latest FROM revs GROUP BY scenario)
SELECT r.scenario, r.revision, CAST(substr(r.revision, 2) AS BIGINT) AS n, r.revision = p.latest AS is_latest,
       substr(r.schema_fingerprint, 1, 12) AS schema_short, r.source, r.source <> 'export' AS has_sql
FROM revs r JOIN ptr p ON r.scenario = p.scenario""")
def q_w3(spark, sf_dir):
    _prep(spark, sf_dir)
    o = spark.table("orders")
    revs = o.select(F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string")).alias("scenario"),
                    F.concat(F.lit("r"), F.lpad(((F.col("o_orderkey") % 997) + 1).cast("string"), 3, "0")).alias("revision"),
                    F.sha2("o_orderpriority", 256).alias("schema_fingerprint"),
                    F.when(F.col("o_orderstatus") == "F", "export").when(F.col("o_orderstatus") == "O", "generate")
                    .otherwise("refresh").alias("source"))
    return RV.revision_history(revs)


@query("j7_catalog_status", f"""
WITH revs AS (
  SELECT {_SCEN.format(k='o_custkey')} AS scenario, 'db' || CAST(o_custkey % 150 AS VARCHAR) AS db_id,
         {_EXISTING_NAME} AS revision,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE event_fp END AS schema_fingerprint,
         CAST(substr({_EXISTING_NAME}, 2) AS BIGINT) * 100000000 + o_orderkey AS rk
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'click' WHEN '2-HIGH' THEN 'view'
                    WHEN '3-MEDIUM' THEN 'purchase' ELSE 'signup' END AS event_fp FROM orders) o),
latest AS (SELECT scenario, arg_max_null(db_id, rk) AS db_id, arg_max_null(revision, rk) AS revision,
             arg_max_null(schema_fingerprint, rk) AS schema_fingerprint
           FROM revs GROUP BY scenario),
live AS (SELECT 'db' || CAST(user_id AS VARCHAR) AS db_id, arg_max(event_type, ts) AS fingerprint
         FROM events GROUP BY user_id)
SELECT l.scenario, l.db_id, l.revision, substr(l.schema_fingerprint, 1, 12) AS schema_short,
       substr(v.fingerprint, 1, 12) AS live_short,
       CASE WHEN coalesce(l.schema_fingerprint, '') = '' THEN 'noschema' WHEN v.fingerprint IS NULL THEN 'unknown'
            WHEN substr(l.schema_fingerprint, 1, 12) = substr(v.fingerprint, 1, 12) THEN 'current'
            ELSE 'outdated' END AS status
FROM latest l LEFT JOIN live v ON l.db_id = v.db_id""")
def q_j7(spark, sf_dir):
    """Each customer scenario's latest revision checked against the live schema of its database
    (live fingerprint = latest sighting in the events-derived observations)."""
    _prep(spark, sf_dir, "observations")
    o = spark.table("orders")
    fp = (F.when(F.col("o_orderpriority") == "1-URGENT", "click").when(F.col("o_orderpriority") == "2-HIGH", "view")
          .when(F.col("o_orderpriority") == "3-MEDIUM", "purchase").otherwise("signup"))
    revs = o.select(F.concat(F.lit("customers/c"), F.col("o_custkey").cast("string")).alias("scenario"),
                    F.concat(F.lit("db"), (F.col("o_custkey") % 150).cast("string")).alias("db_id"),
                    F.concat(F.lit("r"), F.lpad(((F.col("o_orderkey") % 997) + 1).cast("string"), 3, "0")).alias("revision"),
                    F.when(F.col("o_orderstatus") != "P", fp).alias("schema_fingerprint"), "o_orderkey")
    n = F.struct(RV.revision_number(F.col("revision")), F.col("o_orderkey"))
    latest = revs.groupBy("scenario").agg(*[F.max_by(c, n).alias(c) for c in ("db_id", "revision",
                                                                                  "schema_fingerprint")])
    live = H.current_fingerprint(spark.table("observations")).withColumnRenamed("current", "fingerprint")
    return RV.catalog_status(latest, live)


@query("j9_sync_plan", """
WITH loc AS (
  SELECT 'ds-' || CAST(o_orderkey AS VARCHAR) AS name,
         CASE WHEN o_orderstatus = 'F' THEN 'rid-' || CAST(o_orderkey AS VARCHAR) END AS remote_id,
         CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS remote_updated_at
  FROM orders WHERE o_orderstatus IN ('F', 'O')),
rem AS (
  SELECT 'rid-' || CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_totalprice > 300000 THEN 'renamed-' || CAST(o_orderkey AS VARCHAR)
              WHEN o_orderpriority = '5-LOW' THEN 'ds-' || CAST(o_orderkey % 500 AS VARCHAR)
              ELSE 'ds-' || CAST(o_orderkey AS VARCHAR) END AS name,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '2000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at
  FROM orders WHERE o_orderstatus IN ('F', 'P')),
names AS (SELECT name AS nm, count(*) AS n_named, min(id) AS nm_id, min(updated_at) AS nm_upd FROM rem GROUP BY name),
j AS (SELECT l.*, r.id AS rid_, r.name AS id_name, r.updated_at AS id_upd, nn.n_named, nn.nm_id, nn.nm_upd
      FROM loc l LEFT JOIN rem r ON l.remote_id = r.id LEFT JOIN names nn ON l.name = nn.nm),
k AS (SELECT *, CASE WHEN rid_ IS NOT NULL THEN rid_ WHEN n_named = 1 THEN nm_id END AS mid,
             CASE WHEN rid_ IS NOT NULL THEN id_upd WHEN n_named = 1 THEN nm_upd END AS mupd FROM j)
SELECT name, mid AS matched_remote_id,
  CASE WHEN rid_ IS NULL AND coalesce(n_named, 0) > 1 THEN 'ambiguous'
       WHEN rid_ IS NULL AND n_named IS NULL THEN 'missing'
       WHEN coalesce(remote_id, '') <> '' AND remote_id = mid AND coalesce(remote_updated_at, '') <> ''
            AND remote_updated_at = mupd THEN 'up_to_date'
       ELSE 'push' END AS action,
  (rid_ IS NOT NULL AND id_name <> name) AS renamed
FROM k""")
def q_j9(spark, sf_dir):
    _prep(spark, sf_dir)
    o = spark.table("orders")
    key = F.col("o_orderkey").cast("string")
    local = o.where(F.col("o_orderstatus").isin("F", "O")).select(
        F.concat(F.lit("ds-"), key).alias("name"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("rid-"), key)).alias("remote_id"),
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("remote_updated_at"))
    remote = o.where(F.col("o_orderstatus").isin("F", "P")).select(
        F.concat(F.lit("rid-"), key).alias("id"),
        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("renamed-"), key))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("ds-"), (F.col("o_orderkey") % 500).cast("string")))
        .otherwise(F.concat(F.lit("ds-"), key)).alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("2000-01-01"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("updated_at"))
    return RV.sync_plan(local, remote)


@query("j9_sync_pull", """
WITH loc AS (
  SELECT 'ds-' || CAST(o_orderkey AS VARCHAR) AS name, 'rid-' || CAST(o_orderkey AS VARCHAR) AS remote_id,
         CASE WHEN o_orderstatus = 'F' THEN 'sc-' || CAST(o_orderkey AS VARCHAR) WHEN o_orderstatus = 'O' THEN '' END AS remote_scenario_id,
         strftime(o_orderdate, '%Y-%m-%d') AS remote_updated_at
  FROM orders),
rem AS (
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'moved-' ELSE 'rid-' END || CAST(o_orderkey AS VARCHAR) AS id, 'sc-' || CAST(o_orderkey AS VARCHAR) AS scenario_id,
         CASE WHEN o_totalprice > 300000 THEN 'renamed-' ELSE 'ds-' END || CAST(o_orderkey AS VARCHAR) AS name,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '2000-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS updated_at
  FROM orders WHERE o_orderkey % 4 <> 0),
j AS (SELECT l.*, r.id AS rid_, r.name AS id_name, r.updated_at AS id_upd, nn.id AS nm_id, nn.updated_at AS nm_upd
      FROM loc l LEFT JOIN rem r ON l.remote_scenario_id = r.scenario_id LEFT JOIN rem nn ON l.name = nn.name),
k AS (SELECT *, coalesce(rid_, nm_id) AS mid, CASE WHEN rid_ IS NOT NULL THEN id_upd ELSE nm_upd END AS mupd FROM j)
SELECT name, mid AS matched_remote_id,
  CASE WHEN mid IS NULL THEN 'missing' WHEN remote_id = mid AND remote_updated_at = mupd THEN 'up_to_date' ELSE 'pull' END AS action,
  (rid_ IS NOT NULL AND id_name <> name) AS renamed
FROM k""")
def q_j9_pull(spark, sf_dir):
    """The pull direction, matched by scenario id where a dataset knows its own, else by name."""
    _prep(spark, sf_dir)
    o = spark.table("orders")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    local = o.select(F.concat(F.lit("ds-"), key).alias("name"), F.concat(F.lit("rid-"), key).alias("remote_id"),
                     F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("sc-"), key)).when(F.col("o_orderstatus") == "O", F.lit("")).alias("remote_scenario_id"),
                     day.alias("remote_updated_at"))
    remote = o.where(F.col("o_orderkey") % 4 != 0).select(
        F.concat(F.when(F.col("o_orderkey") % 11 == 0, "moved-").otherwise("rid-"), key).alias("id"), F.concat(F.lit("sc-"), key).alias("scenario_id"),
        F.concat(F.when(F.col("o_totalprice") > 300000, "renamed-").otherwise("ds-"), key).alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("2000-01-01")).otherwise(day).alias("updated_at"))
    return RV.sync_plan(local, remote, direction="pull")


@query("j10_revision_delta", derived.cte("cat_old", "cat_new") + """,
o AS (SELECT db_id AS pair_id, table_name, count(*) AS old_rows FROM cat_old GROUP BY db_id, table_name),
n AS (SELECT db_id AS pair_id, table_name, count(*) AS new_rows FROM cat_new GROUP BY db_id, table_name),
a AS (SELECT n.db_id AS pair_id, n.table_name, string_agg('+' || n.column_name, ', ' ORDER BY n.ordinal) AS s
      FROM cat_new n WHERE NOT EXISTS (SELECT 1 FROM cat_old x WHERE x.db_id = n.db_id AND x.table_name = n.table_name
        AND x.column_name = n.column_name) GROUP BY n.db_id, n.table_name),
r AS (SELECT o.db_id AS pair_id, o.table_name, string_agg('-' || o.column_name, ', ' ORDER BY o.ordinal) AS s
      FROM cat_old o WHERE NOT EXISTS (SELECT 1 FROM cat_new x WHERE x.db_id = o.db_id AND x.table_name = o.table_name
        AND x.column_name = o.column_name) GROUP BY o.db_id, o.table_name),
j AS (SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.table_name, n.table_name) AS table_name,
             o.old_rows, n.new_rows,
             CASE WHEN o.pair_id IS NOT NULL AND n.pair_id IS NOT NULL AND (a.s IS NOT NULL OR r.s IS NOT NULL)
                  THEN '(cols: ' || concat_ws(', ', a.s, r.s) || ')' ELSE '' END AS note
      FROM o FULL JOIN n ON o.pair_id = n.pair_id AND o.table_name = n.table_name
      LEFT JOIN a ON a.pair_id = coalesce(o.pair_id, n.pair_id) AND a.table_name = coalesce(o.table_name, n.table_name)
      LEFT JOIN r ON r.pair_id = coalesce(o.pair_id, n.pair_id) AND r.table_name = coalesce(o.table_name, n.table_name))
SELECT pair_id, table_name,
       CASE WHEN old_rows IS NULL THEN 'new' WHEN new_rows IS NULL THEN 'removed'
            WHEN note <> '' THEN 'changed' ELSE 'unchanged' END AS status,
       old_rows, new_rows, note
FROM j""")
def q_j10(spark, sf_dir):
    """Two revisions per database (old and new catalogs as tables; rows = columns of the table)."""
    _prep(spark, sf_dir, "cat_old", "cat_new")

    def side(df):
        return (df.groupBy(F.col("db_id").alias("pair_id"), "table_name")
                .agg(F.count(F.lit(1)).alias("row_count"),
                     F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))).alias("_c"))
                .select("pair_id", "table_name", "row_count", F.col("_c.column_name").alias("columns")))
    return RV.revision_delta(side(spark.table("cat_old")), side(spark.table("cat_new")))


@query("a12_schema_inventory", """
WITH s AS (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS fingerprint, min(o_orderdate) AS schema_time FROM orders
           GROUP BY o_custkey),
d AS (SELECT sha256(CAST(o_custkey AS VARCHAR)) AS fingerprint, count(*) AS datasets, max(o_orderdate) AS newest FROM orders
      WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT substr(s.fingerprint, 1, 12) AS short_id, s.fingerprint, coalesce(d.datasets, 0) AS datasets,
       coalesce(greatest(s.schema_time, d.newest), s.schema_time) AS recency
FROM s LEFT JOIN d ON s.fingerprint = d.fingerprint""")
def q_a12(spark, sf_dir):
    """A stored schema for each customer with orders, and its datasets."""
    _prep(spark, sf_dir)
    o = spark.table("orders").withColumn("fingerprint", F.sha2(F.col("o_custkey").cast("string"), 256))
    return RV.schema_inventory(o.select("fingerprint", F.col("o_orderdate").alias("created_at")),
                               o.where(F.col("o_orderstatus") != "P")
                               .select("fingerprint", F.col("o_orderdate").alias("created_at")))


@query("w4_schema_history", derived.cte("observations") + """,
spans AS (SELECT db_id, fingerprint, min(seen_at) AS first_seen, max(seen_at) AS last_seen
          FROM observations GROUP BY db_id, fingerprint),
lagged AS (SELECT db_id, fingerprint, seen_at,
             lag(fingerprint) OVER (PARTITION BY db_id ORDER BY seen_at, fingerprint) AS prev FROM observations)
SELECT s.db_id, s.fingerprint,
       row_number() OVER (PARTITION BY s.db_id ORDER BY s.first_seen, s.fingerprint) AS version,
       s.first_seen, s.last_seen, CASE WHEN l.prev <> s.fingerprint THEN l.prev END AS previous
FROM spans s JOIN lagged l ON l.db_id = s.db_id AND l.fingerprint = s.fingerprint AND l.seen_at = s.first_seen""")
def q_w4(spark, sf_dir):
    _prep(spark, sf_dir, "observations")
    return H.schema_history(spark.table("observations"))


@query("w5_versions_behind", derived.cte("observations") + """,
spans AS (SELECT db_id, fingerprint, min(seen_at) AS first_seen FROM observations GROUP BY db_id, fingerprint),
h AS (SELECT db_id, fingerprint, row_number() OVER (PARTITION BY db_id ORDER BY first_seen, fingerprint) AS version
      FROM spans),
pairs AS (SELECT DISTINCT db_id, p.from_fp, p.to_fp FROM observations,
          (VALUES ('view', 'purchase'), ('purchase', 'view'), ('click', 'click'), ('error', 'nosuch')) p(from_fp, to_fp))
SELECT p.db_id, p.from_fp, p.to_fp,
  CASE WHEN p.from_fp = p.to_fp THEN CASE WHEN f.version IS NOT NULL THEN 0 END
       WHEN f.version IS NULL OR t.version IS NULL OR t.version - f.version < 0 THEN NULL
       ELSE t.version - f.version END AS behind
FROM pairs p LEFT JOIN h f ON f.db_id = p.db_id AND f.fingerprint = p.from_fp
LEFT JOIN h t ON t.db_id = p.db_id AND t.fingerprint = p.to_fp""")
def q_w5(spark, sf_dir):
    _prep(spark, sf_dir, "observations")
    obs = spark.table("observations")
    hist = H.schema_history(obs)
    combos = F.array(*[F.struct(F.lit(a).alias("from_fp"), F.lit(b).alias("to_fp"))
                       for a, b in (("view", "purchase"), ("purchase", "view"), ("click", "click"), ("error", "nosuch"))])
    pairs = obs.select("db_id").distinct().select("db_id", F.explode(combos).alias("p")).select("db_id", "p.*")
    return H.versions_behind(hist, pairs)


@query("j8_annotate_usage", derived.cte("usage_events") + """,
latest AS (SELECT 'customers/c' || regexp_extract(file, 'user_([0-9]+)', 1) AS state, file, title, project,
             max(last_seen_at) AS last_seen_at
           FROM usage_events GROUP BY 1, file, title, project),
st AS (SELECT state, count(*) AS n, max(last_seen_at) AS last_used_at FROM latest GROUP BY state)
SELECT 'customers/c' || CAST(c_custkey AS VARCHAR) AS scenario, c_name, coalesce(st.n, 0) AS tests_using,
       st.last_used_at
FROM customer LEFT JOIN st ON st.state = 'customers/c' || CAST(c_custkey AS VARCHAR)""")
def q_j8(spark, sf_dir):
    """Customer scenarios annotated with the tests (per user's spec file) that use them."""
    _prep(spark, sf_dir, "usage_events")
    ev = spark.table("usage_events").withColumn(
        "state", F.concat(F.lit("customers/c"), F.regexp_extract("file", r"user_([0-9]+)", 1)))
    scen = spark.table("customer").select(
        F.concat(F.lit("customers/c"), F.col("c_custkey").cast("string")).alias("scenario"), "c_name")
    return U.annotate_usage(scen, U.latest_usage(ev))


@query("p14_explode_contract_handles", """
SELECT 'customers/c' || CAST(c_custkey AS VARCHAR) AS state, 'account' AS handle, 'name' AS key, c_name AS value,
       true AS resolved FROM customer
UNION ALL
SELECT 'customers/c' || CAST(c_custkey AS VARCHAR), 'account', 'segment', 'staging-' || lower(c_mktsegment), true
FROM customer
UNION ALL
SELECT 'customers/c' || CAST(c_custkey AS VARCHAR), 'nation', 'key', CAST(c_nationkey AS VARCHAR), true FROM customer
UNION ALL
SELECT 'customers/c' || CAST(c_custkey AS VARCHAR), 'nation', 'region', NULL, false FROM customer""")
def q_p14(spark, sf_dir):
    """Contracts with a ``provides`` map per customer scenario; ``segmentEnv`` names an environment key."""
    _prep(spark, sf_dir)
    c = spark.table("customer")
    contracts = c.select(
        F.concat(F.lit("customers/c"), F.col("c_custkey").cast("string")).alias("state"),
        F.create_map(F.lit("account"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segmentEnv"),
                                                    F.concat(F.lit("SEG_"), F.col("c_mktsegment"))),
                     F.lit("nation"), F.create_map(F.lit("key"), F.col("c_nationkey").cast("string"),
                                                   F.lit("regionEnv"), F.lit("REGION_OF_NATION"))).alias("provides"))
    env = spark.createDataFrame([("staging", k, v) for k, v in sorted(env_values().items())],
                                "env string, key string, value string")
    return U.explode_contract_handles(contracts, env, "staging")
