"""Registered integrity and load-order queries over the star schema and the derived catalogs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import integrity as I
from tessera.operators.graph import fk_load_order
from tessera.session import DRIVER_TABLES
from tessera.workloads import derived
from tessera.workloads.registry import _prep, query


@query("a1_row_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(DRIVER_TABLES)))
def q_a1(spark, sf_dir):
    _prep(spark, sf_dir)
    return I.row_counts({t: spark.table(t) for t in DRIVER_TABLES})


@query("a2_key_violations", """
WITH li AS (SELECT CASE WHEN l_quantity = 7 AND l_linenumber = 5 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_extendedprice FROM lineitem)
SELECT 'lineitem' AS table_name, 'pk_duplicate' AS kind, 'l_orderkey,l_linenumber' AS columns,
       coalesce(CAST(l_orderkey AS VARCHAR), 'NULL') || '|' || CAST(l_linenumber AS VARCHAR) AS key_value, count(*) AS dup_count
FROM li GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL
SELECT 'lineitem', 'pk_null', 'l_orderkey,l_linenumber', NULL, count(*) FROM li WHERE l_orderkey IS NULL OR l_linenumber IS NULL HAVING count(*) > 0
UNION ALL
SELECT 'lineitem', 'unique_duplicate', 'l_extendedprice', CAST(l_extendedprice AS VARCHAR), count(*)
FROM li WHERE l_extendedprice IS NOT NULL GROUP BY l_extendedprice HAVING count(*) > 1""")
def q_a2(spark, sf_dir):
    _prep(spark, sf_dir)
    lost = (F.col("l_quantity") == 7) & (F.col("l_linenumber") == 5)  # some rows have lost their key
    li = spark.table("lineitem").withColumn("l_orderkey", F.when(~lost, F.col("l_orderkey")))
    return I.key_violations(li, "lineitem", ["l_orderkey", "l_linenumber"], unique=["l_extendedprice"])


@query("a3_null_violations", derived.cte("events_nulled") + """,
c AS (SELECT count(*) FILTER (WHERE event_id IS NULL) AS event_id, count(*) FILTER (WHERE ts IS NULL) AS ts,
             count(*) FILTER (WHERE user_id IS NULL) AS user_id,
             count(*) FILTER (WHERE event_type IS NULL) AS event_type,
             count(*) FILTER (WHERE value IS NULL) AS value, count(*) FILTER (WHERE props IS NULL) AS props
      FROM events_nulled)
SELECT table_name, column_name, null_count FROM (
  SELECT 'events' AS table_name, 'event_id' AS column_name, event_id AS null_count FROM c
  UNION ALL SELECT 'events', 'ts', ts FROM c
  UNION ALL SELECT 'events', 'user_id', user_id FROM c
  UNION ALL SELECT 'events', 'event_type', event_type FROM c
  UNION ALL SELECT 'events', 'value', value FROM c
  UNION ALL SELECT 'events', 'props', props FROM c) x WHERE null_count > 0""")
def q_a3(spark, sf_dir):
    _prep(spark, sf_dir, "events_nulled")
    return I.null_violations(spark.table("events_nulled"), "events",
                             ["event_id", "ts", "user_id", "event_type", "value", "props"])


@query("a4_domain_violations", """
SELECT 'orders' AS table_name, 'o_orderpriority' AS column_name, 'allowed' AS rule,
       count(*) FILTER (WHERE o_orderpriority IS NOT NULL
                        AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS violations FROM orders
UNION ALL
SELECT 'orders', 'o_orderstatus', 'allowed',
       count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL
SELECT 'customer', 'c_mktsegment', 'max_length', count(*) FILTER (WHERE length(c_mktsegment) > 9) FROM customer""")
def q_a4(spark, sf_dir):
    _prep(spark, sf_dir)
    o = I.domain_violations(spark.table("orders"), "orders",
                            allowed={"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"],
                                     "o_orderstatus": ["F", "O"]})
    c = I.domain_violations(spark.table("customer"), "customer", max_length={"c_mktsegment": 9})
    return o.unionByName(c)


@query("j6_fk_violations", """
SELECT 'lineitem.l_orderkey -> orders.o_orderkey' AS fk, CAST(l_orderkey AS VARCHAR) AS fk_value, count(*) AS rows
FROM lineitem l WHERE l_orderkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderstatus = 'F' AND o.o_orderkey = l.l_orderkey)
GROUP BY l_orderkey
UNION ALL
SELECT 'lineitem.l_partkey -> part.p_partkey', CAST(l_partkey AS VARCHAR), count(*)
FROM lineitem l WHERE l_partkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size > 10 AND p.p_partkey = l.l_partkey)
GROUP BY l_partkey
UNION ALL
SELECT 'orders.o_custkey -> customer.c_custkey', CAST(o_custkey AS VARCHAR), count(*)
FROM orders o WHERE o_custkey IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
GROUP BY o_custkey""")
def q_j6(spark, sf_dir):
    _prep(spark, sf_dir)
    li, o = spark.table("lineitem"), spark.table("orders")
    a = I.fk_violations(li, "lineitem", "l_orderkey", o.where(F.col("o_orderstatus") == "F"), "orders", "o_orderkey")
    b = I.fk_violations(li, "lineitem", "l_partkey", spark.table("part").where(F.col("p_size") > 10), "part",
                        "p_partkey")
    c = I.fk_violations(o, "orders", "o_custkey", spark.table("customer"), "customer", "c_custkey")
    return a.unionByName(b).unionByName(c)


_SERIALS = {"customer": "c_custkey", "events": "event_id", "orders": "o_orderkey", "part": "p_partkey",
            "supplier": "s_suppkey"}


@query("a9_sequence_resets", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(max({c}), 0) + 1 AS next_value FROM {t}"
    for t, c in sorted(_SERIALS.items())))
def q_a9(spark, sf_dir):
    _prep(spark, sf_dir)
    return I.sequence_resets({t: spark.table(t) for t in _SERIALS}, _SERIALS)


@query("t2_fk_load_order", derived.cte("cat_new", recursive=True) + """,
tabs AS (SELECT db_id, table_name, min(ordinal) AS input_pos FROM cat_new GROUP BY db_id, table_name),
e AS (SELECT DISTINCT c.db_id, c.table_name AS child, c.fk_table AS parent FROM cat_new c
      WHERE c.fk_table IS NOT NULL AND c.fk_table <> c.table_name AND NOT coalesce(c.nullable, false)
        AND EXISTS (SELECT 1 FROM tabs t WHERE t.db_id = c.db_id AND t.table_name = c.fk_table)),
ntab AS (SELECT db_id, count(*) AS n FROM tabs GROUP BY db_id),
depth AS (
  SELECT db_id, table_name AS t, 0 AS d FROM tabs
  UNION
  SELECT e.db_id, e.child, depth.d + 1 FROM depth
  JOIN e ON e.db_id = depth.db_id AND e.parent = depth.t
  JOIN ntab ON ntab.db_id = depth.db_id
  WHERE depth.d < ntab.n),
lv AS (SELECT db_id, t, max(d) AS md FROM depth GROUP BY db_id, t),
placed AS (SELECT lv.db_id, lv.t, lv.md, tabs.input_pos FROM lv JOIN ntab ON ntab.db_id = lv.db_id AND lv.md < ntab.n
           JOIN tabs ON tabs.db_id = lv.db_id AND tabs.table_name = lv.t),
-- positions along the longest paths to a table; the queue takes the largest path
path AS (
  SELECT db_id, t, md, [input_pos] AS k FROM placed WHERE md = 0
  UNION
  SELECT c.db_id, c.t, c.md, list_append(path.k, c.input_pos) FROM path
  JOIN e ON e.db_id = path.db_id AND e.parent = path.t
  JOIN placed c ON c.db_id = e.db_id AND c.t = e.child AND c.md = path.md + 1),
keys AS (SELECT db_id, t, max(k) AS k FROM path GROUP BY db_id, t)
SELECT tabs.db_id, tabs.table_name, tabs.input_pos,
       CASE WHEN lv.md < ntab.n THEN lv.md END AS level, lv.md >= ntab.n AS in_cycle,
       row_number() OVER (PARTITION BY tabs.db_id ORDER BY keys.k IS NULL, lv.md, keys.k, tabs.input_pos) AS place
FROM tabs JOIN lv ON lv.db_id = tabs.db_id AND lv.t = tabs.table_name
JOIN ntab ON ntab.db_id = tabs.db_id
LEFT JOIN keys ON keys.db_id = tabs.db_id AND keys.t = tabs.table_name""")
def q_t2(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    cols = spark.table("cat_new")
    tables = cols.groupBy("db_id", "table_name").agg(F.min("ordinal").alias("input_pos"))
    order = fk_load_order(C.fk_edges(cols), tables)
    queue = Window.partitionBy("db_id").orderBy(F.col("level").asc_nulls_last(), F.col("kahn_key").asc_nulls_last(), "input_pos")
    return order.withColumn("place", F.row_number().over(queue)).drop("kahn_key")
