"""Registered scalar-transform queries (P1-P8, P11, P12, P15) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import coerce as CO
from tessera.functions import markers as M
from tessera.functions import parse as P
from tessera.functions import render as R
from tessera.workloads import derived
from tessera.workloads.registry import _prep, query
from tessera.workloads.shared import ORDERS_PG_TYPES, env_values

_TS_SQL = ("strftime({c}, '%Y-%m-%d %H:%M:%S') || regexp_replace('.' || strftime({c}, '%f'), '\\.?0+$', '')"
           " || ' +0000 UTC'")


@query("p5_render_cells", f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, {_TS_SQL.format(c='ts')} AS ts, CAST(user_id AS VARCHAR) AS user_id,
       event_type, CAST(value AS VARCHAR) AS value, props
FROM events""")
def q_p5(spark, sf_dir):
    _prep(spark, sf_dir)
    return R.render_cells(spark.table("events"))


@query("p1_coerce_postgres", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 0 AS n_rejects
FROM orders""")
def q_p1(spark, sf_dir):
    """Orders rendered to export text (P5), then typed back with PostgreSQL column types."""
    _prep(spark, sf_dir)
    text = R.render_cells(spark.table("orders"))
    typed = CO.coerce_table(text, ORDERS_PG_TYPES, "postgres")
    return typed.select(*ORDERS_PG_TYPES, F.size("_rejects").alias("n_rejects"))


EVENTS_MYSQL_TYPES = {"event_id": "bigint", "ts": "datetime", "user_id": "int", "event_type": "varchar(16)",
                      "value": "double", "props": "json", "is_big": "tinyint", "flag": "boolean"}


@query("p2_coerce_mysql", """
SELECT event_id, ts, user_id, event_type, value, props,
       CASE WHEN value > 25 THEN 1 ELSE 0 END AS is_big, NULL::BIGINT AS flag,
       CASE WHEN value > 45 THEN 1 ELSE 0 END AS n_rejects
FROM events""")
def q_p2(spark, sf_dir):
    """Events rendered to text, a tinyint flag column in word form and a bool column holding
    ``y``/``n`` (MySQL has no y/n rule, so those cells are rejects), typed with MySQL rules."""
    _prep(spark, sf_dir)
    ev = spark.table("events")
    text = R.render_cells(ev.withColumn("is_big", F.when(F.col("value") > 25, "true").otherwise("0"))
                          .withColumn("flag", F.when(F.col("value") > 45, "y").otherwise("NULL")))
    typed = CO.coerce_table(text, EVENTS_MYSQL_TYPES, "mysql")
    return typed.select(*EVENTS_MYSQL_TYPES, F.size("_rejects").alias("n_rejects"))


@query("p3_repair_json", derived.cte("props_damaged") + """
SELECT event_id, props AS raw,
  CASE WHEN json_valid(props) THEN props
       WHEN instr(props, '''') > 0 AND instr(props, '"') = 0 AND json_valid(replace(props, '''', '"'))
         THEN replace(props, '''', '"')
       WHEN json_valid(regexp_replace(replace(props, '''', '"'), '([^ \t"}\\]])([ \t]*):', '\\1\\2":', 'g'))
         THEN regexp_replace(replace(props, '''', '"'), '([^ \t"}\\]])([ \t]*):', '\\1\\2":', 'g')
       ELSE props END AS repaired
FROM props_damaged""")
def q_p3(spark, sf_dir):
    _prep(spark, sf_dir, "props_damaged")
    d = spark.table("props_damaged")
    return d.select("event_id", F.col("props").alias("raw"), CO.repair_json(F.col("props")).alias("repaired"))


@query("p4_to_pg_array", """
SELECT p_partkey,
  CASE WHEN p_size % 7 = 0 THEN '{' || p_brand || ',"' || p_type || '"}'
       WHEN p_size % 5 = 0 THEN '{' || CAST(p_size AS VARCHAR) || ',"' || p_type || '",NULL}'
       WHEN p_size % 3 = 0 AND p_size % 2 <> 0 THEN '{' || p_brand || ',' || p_type || '}'
       ELSE '{"' || p_brand || '","' || p_type || '"}' END AS pg_array
FROM part""")
def q_p4(spark, sf_dir):
    _prep(spark, sf_dir, "array_cells")
    return spark.table("array_cells").select("p_partkey", CO.to_pg_array(F.col("cell")).alias("pg_array"))


@query("p6_sql_literal", """
SELECT c_custkey, '''' || replace(c_name, '''', '''''') || '''' AS name_literal,
       CAST(c_acctbal AS VARCHAR) AS acctbal_literal,
       '''' || replace(c_mktsegment, '''', '''''') || '''' AS segment_literal
FROM customer""")
def q_p6(spark, sf_dir):
    _prep(spark, sf_dir)
    c = R.render_cells(spark.table("customer"))
    return c.select(F.col("c_custkey").cast("long").alias("c_custkey"),
                    R.sql_literal(F.col("c_name"), "text").alias("name_literal"),
                    R.sql_literal(F.col("c_acctbal"), "numeric").alias("acctbal_literal"),
                    R.sql_literal(F.col("c_mktsegment"), "character varying").alias("segment_literal"))


@query("p7_resolve_markers", """
SELECT c_custkey, c_name,
       CASE WHEN c_acctbal > 5000 THEN 'staging-' || lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_nationkey < 5 THEN 'staging-nation-' || CAST(c_nationkey AS VARCHAR)
            ELSE CAST(c_nationkey AS VARCHAR) END AS c_nation
FROM customer""")
def q_p7(spark, sf_dir):
    _prep(spark, sf_dir, "customer_marked")
    return M.resolve_markers(spark.table("customer_marked"), env_values(), env="staging", table="customer",
                             use_process_env=False)


@query("p8_marker_audit", """
SELECT 'customer' AS table_name, c_custkey, 'c_mktsegment' AS column_name, 'SEG_' || c_mktsegment AS key,
       'staging-' || lower(c_mktsegment) AS value FROM customer WHERE c_acctbal > 5000
UNION ALL
SELECT 'customer', c_custkey, 'c_nation', 'NATION_' || CAST(c_nationkey AS VARCHAR),
       'staging-nation-' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey < 5""")
def q_p8(spark, sf_dir):
    _prep(spark, sf_dir, "customer_marked")
    return M.marker_audit(spark.table("customer_marked"), ["c_custkey"], env_values(), table="customer")


@query("p11_extract_allowed_values", derived.cte("check_clauses") + """
SELECT o_orderkey, array_to_string(vals, ',') AS allowed_values FROM (
  SELECT o_orderkey, regexp_extract_all(
     CASE WHEN regexp_extract(clause, '(?i)(?:\\bIN\\s*\\(([^)]+)\\)|ANY\\s*\\(\\s*ARRAY\\[([^\\]]+)\\]\\s*\\))', 1) <> ''
          THEN regexp_extract(clause, '(?i)(?:\\bIN\\s*\\(([^)]+)\\)|ANY\\s*\\(\\s*ARRAY\\[([^\\]]+)\\]\\s*\\))', 1)
          ELSE regexp_extract(clause, '(?i)(?:\\bIN\\s*\\(([^)]+)\\)|ANY\\s*\\(\\s*ARRAY\\[([^\\]]+)\\]\\s*\\))', 2) END,
     '''([^'']*)''', 1) AS vals FROM check_clauses) x
WHERE len(vals) > 0""")
def q_p11(spark, sf_dir):
    _prep(spark, sf_dir, "check_clauses")
    v = spark.table("check_clauses").select("o_orderkey", P.allowed_values(F.col("clause")).alias("v"))
    return v.where(F.col("v").isNotNull()).select("o_orderkey", F.array_join("v", ",").alias("allowed_values"))


@query("p12_extract_enum_values", """
SELECT p_partkey, p_type || ',' || split_part(p_name, ' ', 1) AS enum_values,
       'part_kind' AS enum_name FROM part""")
def q_p12(spark, sf_dir):
    _prep(spark, sf_dir)
    p = spark.table("part")
    t = F.concat(F.lit("enum('"), F.col("p_type"), F.lit("','"), F.split(F.col("p_name"), " ").getItem(0), F.lit("', '')"))
    return p.select("p_partkey", F.array_join(P.enum_values(t), ",").alias("enum_values"),
                    P.synthetic_enum_name(F.lit("part"), F.lit("kind")).alias("enum_name"))


@query("p15_hash_ids", derived.cte("usage_events") + """
SELECT file, title, project, sha1(file || chr(0) || title || chr(0) || project) AS test_id
FROM usage_events GROUP BY file, title, project""")
def q_p15(spark, sf_dir):
    _prep(spark, sf_dir, "usage_events")
    u = spark.table("usage_events").select("file", "title", "project").distinct()
    return u.withColumn("test_id", P.test_id(F.col("file"), F.col("title"), F.col("project")))
