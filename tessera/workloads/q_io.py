"""Registered source/sink queries: each writes driver-table data through the library into a fresh
folder under the shared checkpoint folder and reads it back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F


from tessera.plans.seed import restore_snapshot
from tessera.session import scratch_path
from tessera.sources import schema_docs as SD
from tessera.sources import sql_script as SQ
from tessera.sources import store
from tessera.sources import usage_events as UE
from tessera.workloads import derived
from tessera.workloads.shared import ORDERS_PG_TYPES, env_values
from tessera.workloads.registry import _prep, query

_TS_SQL = ("strftime({c}, '%Y-%m-%d %H:%M:%S') || regexp_replace('.' || strftime({c}, '%f'), '\\.?0+$', '')"
           " || ' +0000 UTC'")


@query("s7_write_snapshot", """
SELECT 'customer' AS table_name, count(*) AS row_count FROM customer
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'orders', count(*) FROM orders""")
def q_s7(spark, sf_dir):
    _prep(spark, sf_dir)
    root = scratch_path(spark, "store")
    return store.write_snapshot(spark, root, "shop/baseline",
                                {t: spark.table(t) for t in ("customer", "lineitem", "nation", "orders")})


@query("s1_read_snapshot", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")
def q_s1(spark, sf_dir):
    """Orders exported as CSV (export text form), read back by header and typed with PostgreSQL rules."""
    _prep(spark, sf_dir)
    root = scratch_path(spark, "store")
    store.write_snapshot(spark, root, "shop/csv", {"orders": spark.table("orders")}, fmt="csv")
    typed, _rejects, _warn = store.read_snapshot(
        spark, f"{store.revision_dir(root, 'shop/csv', 'r001')}/tables/orders", "orders", ORDERS_PG_TYPES)
    return typed.select(*ORDERS_PG_TYPES)


@query("s8_restore_snapshot", """
SELECT c_custkey, c_name,
       CASE WHEN c_acctbal > 5000 THEN 'staging-' || lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_nationkey < 5 THEN 'staging-nation-' || CAST(c_nationkey AS VARCHAR)
            ELSE CAST(c_nationkey AS VARCHAR) END AS c_nation
FROM customer""")
def q_s8(spark, sf_dir):
    """A revision holding marker cells restored into a target with the staging environment."""
    _prep(spark, sf_dir, "customer_marked")
    root = scratch_path(spark, "store")
    target = scratch_path(spark, "target")
    store.write_snapshot(spark, root, "crm/marked", {"customer": spark.table("customer_marked")})
    status = restore_snapshot(spark, root, "crm/marked", [target], env_values={target: env_values()})
    row = status.collect()[0]
    if row.status != "ok":
        raise RuntimeError(f"restore failed: {row.error}")
    return store.read_published(spark, target, "customer")


@query("s1_snapshot_rejects", """
SELECT 'orders' AS table_name, 'o_orderpriority' AS column_name, o_orderpriority AS raw FROM orders
UNION ALL
SELECT 'orders', 'o_orderstatus', o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def q_s1_rejects(spark, sf_dir):
    """Orders read back with types that the priority never fits and the status only sometimes: the cells
    that their type can't hold."""
    _prep(spark, sf_dir)
    root = scratch_path(spark, "store")
    store.write_snapshot(spark, root, "shop/csv", {"orders": spark.table("orders")}, fmt="csv")
    types = {**ORDERS_PG_TYPES, "o_orderpriority": "integer", "o_orderstatus": "boolean"}
    _typed, rejects, _warn = store.read_snapshot(
        spark, f"{store.revision_dir(root, 'shop/csv', 'r001')}/tables/orders", "orders", types)
    return rejects


@query("s8_restore_outcomes", """
WITH c AS (SELECT count(*) AS n FROM customer)
SELECT 1 AS run, 1 AS place, 'ok' AS status, 1 AS tables, n AS rows, '' AS reason FROM c
UNION ALL SELECT 1, 2, 'failed', 0, 0, 'schema mismatch'
UNION ALL SELECT 1, 3, 'ok', 1, n, '' FROM c
UNION ALL SELECT 2, 1, 'failed', 0, 0, 'schema mismatch'
UNION ALL SELECT 2, 2, 'skipped', 0, 0, 'previous target failed'
UNION ALL SELECT 3, 1, 'failed', 0, 0, 'validation failed'
UNION ALL SELECT 4, 1, 'failed', 0, 0, 'table customer'
UNION ALL SELECT 4, 2, 'ok', 1, n, '' FROM c""")
def q_s8_outcomes(spark, sf_dir):
    """Status per target of four restores of one CSV revision: a target with another schema (going on, then
    stopping), a failed key check, and a column whose cells don't fit its type (then a revision that does)."""
    from tessera.operators.integrity import key_violations

    _prep(spark, sf_dir)
    root = scratch_path(spark, "store")
    customer = spark.table("customer")
    store.write_snapshot(spark, root, "crm/all", {"customer": customer}, fmt="csv", schema_fingerprint="a" * 64)
    types = {"c_custkey": "bigint", "c_name": "text", "c_nationkey": "integer", "c_acctbal": "numeric", "c_mktsegment": "text"}
    wrong = {"customer": {**types, "c_name": "integer"}}
    duplicated = lambda t: key_violations(t["customer"], "customer", ["c_nationkey"])

    def run(number, places, bad=(), **kw):
        targets = [scratch_path(spark, "target") for _ in range(places)]
        prints = {t: ("b" if i + 1 in bad else "a") * 64 for i, t in enumerate(targets)}
        rows = restore_snapshot(spark, root, "crm/all", targets, target_fingerprints=prints, **kw).collect()  # a row per target
        return [(number, i + 1, r.status, r.tables, r.rows, r.error.split(":")[0]) for i, r in enumerate(rows)]

    fit = {"customer": types}
    out = run(1, 3, bad=(2,), types=fit, continue_on_error=True) + run(2, 2, bad=(1,), types=fit)
    out += run(3, 1, types=fit, checks=[duplicated]) + run(4, 1, types=wrong)
    out += [(4, 2, *r[2:]) for r in run(4, 1, types=fit)]
    return spark.createDataFrame(out, "run int, place int, status string, tables int, rows long, reason string")


_PREVIEW_KEYS = {"customer": ["c_custkey"], "nation": ["n_nationkey"], "orders": ["o_orderkey"], "part": ["p_partkey"]}


@query("s6_preview_snapshot", f"""
SELECT table_name, row_text, row_count, row_count > 5 AS truncated FROM (
  SELECT 'customer' AS table_name,
         concat_ws(',', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR),
                   c_mktsegment) AS row_text,
         count(*) OVER () AS row_count,
         row_number() OVER (ORDER BY c_custkey) AS rn FROM customer
  UNION ALL
  SELECT 'nation', concat_ws(',', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)),
         count(*) OVER (), row_number() OVER (ORDER BY n_nationkey) FROM nation
  UNION ALL
  SELECT 'orders', concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
                   CAST(o_totalprice AS VARCHAR), {_TS_SQL.format(c='o_orderdate')}, o_orderpriority),
         count(*) OVER (), row_number() OVER (ORDER BY o_orderkey) FROM orders
  UNION ALL
  SELECT 'part', concat_ws(',', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR),
                   CAST(p_retailprice AS VARCHAR)),
         count(*) OVER (), row_number() OVER (ORDER BY p_partkey) FROM part
) x WHERE rn <= 5""")
def q_s6(spark, sf_dir):
    _prep(spark, sf_dir)
    return store.preview_snapshot({t: spark.table(t) for t in _PREVIEW_KEYS}, _PREVIEW_KEYS, n=5).drop("bytes")


@query("s10_write_schema_docs", derived.cte("cat_new", "enum_new") + """
SELECT db_id, table_name, column_name, col_type, nullable, col_default, is_primary, is_unique, is_generated,
       enum_name, fk_table, fk_column FROM cat_new""")
def q_s10(spark, sf_dir):
    """Catalogs written as one JSON document per database, then read back and flattened (S10 + S3)."""
    _prep(spark, sf_dir, "cat_new", "enum_new")
    path = scratch_path(spark, "schemas")
    SD.write_schema_docs(spark.table("cat_new"), path, spark.table("enum_new"))
    cols, _enums, _bad = SD.read_schema_docs(spark, path)
    return cols.select("db_id", "table_name", "column_name", "col_type", "nullable", "col_default", "is_primary",
                       "is_unique", "is_generated", "enum_name", "fk_table", "fk_column")


@query("s3_read_schema_docs", derived.cte("enum_new") + """
SELECT db_id, enum_name, enum_value FROM enum_new""")
def q_s3(spark, sf_dir):
    """Enum definitions of the written documents read back (S3's second output)."""
    _prep(spark, sf_dir, "cat_new", "enum_new")
    path = scratch_path(spark, "schemas")
    SD.write_schema_docs(spark.table("cat_new"), path, spark.table("enum_new"))
    _cols, enums, _bad = SD.read_schema_docs(spark, path)
    return enums


@query("s4_read_revision_catalog", """
SELECT 'months/' || strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%m') AS scenario, 'r' || lpad(CAST(k AS VARCHAR), 3, '0') AS revision, k AS n,
       count(*) AS orders_rows, k = 2 AS has_sql
FROM (SELECT o_orderdate, o_orderkey % 3 + 1 AS k FROM orders) o GROUP BY ALL""")
def q_s4(spark, sf_dir):
    """A catalog with one scenario per order month and up to three revisions, whose manifests state the month's
    orders; a broken manifest, data files and other folders lie beside them."""
    _prep(spark, sf_dir)
    root = scratch_path(spark, "store")
    fs = store.FS(spark)
    month = F.concat(F.lit("months/"), F.date_format("o_orderdate", "yyyy/MM")).alias("scenario")
    rows = spark.table("orders").groupBy(month, (F.col("o_orderkey") % 3 + 1).alias("n")).count().collect()  # a manifest each
    for r in rows:
        at = store.revision_dir(root, r.scenario, store.revision_id(r.n))
        fs.write_text(f"{at}/manifest.json", json.dumps({"scenario": r.scenario, "tables": ["orders"], "rowCounts": {"orders": r["count"]}}))
        if r.n == 2:
            fs.write_text(f"{at}/{store.DATASET_SQL}", "SELECT 1;")
    fs.write_text(f"{root}/broken/revisions/r001/manifest.json", "{not json")
    fs.write_text(f"{root}/broken/revisions/r001/tables/orders/manifest.json", "{}")
    fs.write_text(f"{root}/broken/revisions/draft/manifest.json", "{}")
    good, _bad = store.read_revision_catalog(spark, root)
    return good.select("scenario", "revision", "n", F.col("row_counts")["orders"].alias("orders_rows"), "has_sql")


@query("s5_read_usage_events", derived.cte("usage_events") + """
SELECT state, file, title, project, reset_mode, last_seen_at, test_hash FROM usage_events
WHERE state <> 'error'""")
def q_s5(spark, sf_dir):
    """Usage events written as JSON with the error events' state blanked; the reader skips them."""
    _prep(spark, sf_dir, "usage_events")
    path = scratch_path(spark, "usage")
    ev = spark.table("usage_events").withColumn(
        "state", F.when(F.col("state") == "error", F.lit("")).otherwise(F.col("state")))
    UE.write_usage_events(ev, path)
    return UE.read_usage_events(spark, path, mode="go").drop("test_id")


_SCRIPT_TYPES = {"nation": {"n_nationkey": "integer", "n_name": "text", "n_regionkey": "integer"},
                 "customer": {"c_custkey": "bigint", "c_name": "character varying", "c_nationkey": "integer",
                              "c_acctbal": "numeric", "c_mktsegment": "text"}}


@query("s11_write_sql_script", """
SELECT 'customer' AS table_name, 0 AS seq, 'TRUNCATE TABLE "customer" RESTART IDENTITY CASCADE;' AS statement
UNION ALL
SELECT 'customer', 1, 'INSERT INTO "customer" ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") VALUES ('
       || CAST(c_custkey AS VARCHAR) || ', ''' || replace(c_name, '''', '''''') || ''', '
       || CAST(c_nationkey AS VARCHAR) || ', ' || CAST(c_acctbal AS VARCHAR) || ', '''
       || replace(c_mktsegment, '''', '''''') || ''');' FROM customer
UNION ALL
SELECT 'nation', 0, 'TRUNCATE TABLE "nation" RESTART IDENTITY CASCADE;'
UNION ALL
SELECT 'nation', 1, 'INSERT INTO "nation" ("n_nationkey", "n_name", "n_regionkey") VALUES ('
       || CAST(n_nationkey AS VARCHAR) || ', ''' || replace(n_name, '''', '''''') || ''', '
       || CAST(n_regionkey AS VARCHAR) || ');' FROM nation""")
def q_s11(spark, sf_dir):
    _prep(spark, sf_dir)
    st = SQ.sql_statements(spark, {"customer": spark.table("customer"), "nation": spark.table("nation")},
                           _SCRIPT_TYPES)
    return st.select("table_name", "seq", "statement")



