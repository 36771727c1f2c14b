"""Registered script-corpus queries: scripts assembled from part and customer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import scripts as S
from tessera.operators.graph import fk_load_order
from tessera.operators.sequence import ordered_index
from tessera.workloads.registry import _prep, query


def _assemble(df, group, order, stmt):
    """One script per group: statements concatenated in order (bounded by the group's rows)."""
    return (df.groupBy(F.col(group).alias("script_id"))
            .agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], stmt.alias("s")))).alias("_a"))
            .select("script_id", F.array_join(F.transform("_a", lambda x: x["s"]), "\n").alias("sql")))


@query("a10_script_contract_check", """
WITH p AS (SELECT p_brand || '/' || CAST(p_partkey // 40 AS VARCHAR) AS script_id, lower(p_type) AS table_name,
             bool_or(p_size % 4 IN (0, 3)) AS has_insert, bool_or(p_size % 4 = 1) AS has_wipe,
             count(*) FILTER (WHERE p_retailprice > 950) AS rows
           FROM part GROUP BY 1, lower(p_type))
SELECT script_id, table_name, has_insert, has_wipe, has_insert AND has_wipe AS ok
FROM p WHERE rows > 0 AND table_name <> 'promo'""")
def q_a10(spark, sf_dir):
    """A corpus of scripts, one per brand and block of 40 part keys (so each script stays small and
    the number of scripts grows with the data); per part a statement chosen by size: a
    schema-qualified INSERT, a TRUNCATE, a DELETE with WHERE (not a wipe) or a commented-out
    TRUNCATE before an INSERT."""
    scripts, populated = _a10_corpus(spark, sf_dir)
    return S.script_contract_check(scripts, populated, excluded=["PROMO"])


def _a10_corpus(spark, sf_dir):
    _prep(spark, sf_dir)
    p = spark.table("part").withColumn(
        "script", F.concat(F.col("p_brand"), F.lit("/"), F.floor(F.col("p_partkey") / 40).cast("long").cast("string")))
    t = F.lower("p_type")
    k = F.col("p_partkey").cast("string")
    stmt = (F.when(F.col("p_size") % 4 == 0, F.concat(F.lit('INSERT INTO public."'), t, F.lit('" (id) VALUES ('), k,
                                                      F.lit(");")))
            .when(F.col("p_size") % 4 == 1, F.concat(F.lit("TRUNCATE TABLE "), t, F.lit(";")))
            .when(F.col("p_size") % 4 == 2, F.concat(F.lit("DELETE FROM "), t, F.lit(" WHERE id = "), k, F.lit(";")))
            .otherwise(F.concat(F.lit("-- TRUNCATE "), t, F.lit("\nINSERT INTO "), t, F.lit(" VALUES (1);"))))
    scripts = _assemble(p, "script", ["p_partkey"], stmt)
    populated = p.groupBy(F.col("script").alias("script_id"), t.alias("table_name")).agg(
        F.count_if(F.col("p_retailprice") > 950).alias("rows"))
    return scripts, populated


@query("a10_script_contract_strict", """
WITH p AS (SELECT p_brand || '/' || CAST(p_partkey // 40 AS VARCHAR) AS script_id, lower(p_type) AS table_name,
             min(CASE WHEN p_size % 4 IN (0, 3) THEN p_partkey END) AS first_insert,
             min(CASE WHEN p_size % 4 = 1 THEN p_partkey END) AS first_wipe,
             count(*) FILTER (WHERE p_retailprice > 950) AS rows
           FROM part GROUP BY 1, lower(p_type))
SELECT script_id, table_name, first_insert IS NOT NULL AS has_insert, first_wipe IS NOT NULL AS has_wipe,
       coalesce(first_wipe < first_insert, false) AS ok
FROM p WHERE rows > 0 AND table_name <> 'promo'""")
def q_a10_strict(spark, sf_dir):
    """The A10 corpus checked with the optional strict rule: each table's first wipe must come
    before its first INSERT."""
    scripts, populated = _a10_corpus(spark, sf_dir)
    return S.script_contract_check(scripts, populated, excluded=["PROMO"], strict_order=True)


def _blocks(spark):
    """Rows and their groups for the scripts: customers (in the role of nations) in blocks of 50 keys (in the role
    of regions), so scripts grow in number with the table and not in size."""
    block = F.floor(F.col("c_custkey") / 50).cast("long")
    rows = spark.table("customer").select(F.col("c_custkey").alias("n_nationkey"), F.col("c_name").alias("n_name"), block.alias("n_regionkey"))
    groups = rows.select(F.col("n_regionkey").alias("r_regionkey")).distinct()
    return rows, groups.withColumn("r_name", F.concat(F.lit("BLOCK_"), F.col("r_regionkey").cast("string")))


@query("a11_script_stats", """
WITH nation AS (SELECT c_custkey AS n_nationkey, c_name AS n_name, c_custkey // 50 AS n_regionkey FROM customer),
region AS (SELECT DISTINCT n_regionkey AS r_regionkey, 'BLOCK_' || CAST(n_regionkey AS VARCHAR) AS r_name FROM nation)
SELECT 'region-' || CAST(n_regionkey AS VARCHAR) AS script_id, 'nation' AS table_name,
       'n_nationkey,n_name' AS columns, count(*) AS row_count
FROM nation GROUP BY n_regionkey
UNION ALL
SELECT 'region-' || CAST(r_regionkey AS VARCHAR), 'region', 'r_regionkey,r_name', 1 FROM region""")
def q_a11(spark, sf_dir):
    """Per block of customers a script: a first (superseded) nation block, the region row, then one multi-row
    nation INSERT whose tuples contain nested parentheses."""
    _prep(spark, sf_dir)
    n, r = _blocks(spark)
    tuples = (n.groupBy("n_regionkey")
              .agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.format_string(
                  "(%d, '%s (n)')", F.col("n_nationkey"), F.col("n_name")).alias("t")))).alias("_t"))
              .select(F.col("n_regionkey").alias("rk"), F.array_join(F.transform("_t", lambda x: x["t"]), ", ").alias("vals")))
    sql = F.concat(F.lit('INSERT INTO "nation" ("n_nationkey") VALUES (0);\n'),
                   F.format_string('INSERT INTO "region" ("r_regionkey", "r_name") VALUES (%d, \'%s\');\n',
                                   F.col("r_regionkey"), F.col("r_name")),
                   F.lit('INSERT INTO "nation" ("n_nationkey", "n_name") VALUES '), F.col("vals"), F.lit(";"))
    scripts = r.join(tuples, r.r_regionkey == tuples.rk).select(
        F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("script_id"), sql.alias("sql"))
    return S.script_stats(scripts).select("script_id", "table_name", F.array_join("columns", ",").alias("columns"),
                                          "row_count")


@query("t3_reorder_scripts", """
WITH nation AS (SELECT c_custkey AS n_nationkey, c_name AS n_name, c_custkey // 50 AS n_regionkey FROM customer),
region AS (SELECT DISTINCT n_regionkey AS r_regionkey, 'BLOCK_' || CAST(n_regionkey AS VARCHAR) AS r_name FROM nation),
k AS (SELECT n_regionkey AS rk, count(*) AS cnt FROM nation GROUP BY n_regionkey),
st AS (
  SELECT 'region-' || CAST(r_regionkey AS VARCHAR) AS script_id, 0 AS new_pos, 'SET search_path = public;' AS statement
  FROM region
  UNION ALL
  SELECT 'region-' || CAST(r_regionkey AS VARCHAR), 1,
         'INSERT INTO "region" ("r_regionkey", "r_name") VALUES (' || CAST(r_regionkey AS VARCHAR) || ', ''' || r_name
         || '; x'');' FROM region
  UNION ALL
  SELECT 'region-' || CAST(n_regionkey AS VARCHAR),
         1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey),
         'INSERT INTO "nation" ("n_nationkey", "n_name") VALUES (' || CAST(n_nationkey AS VARCHAR) || ', ''' || n_name
         || ''');' FROM nation
  UNION ALL
  SELECT 'region-' || CAST(rk AS VARCHAR), 2 + cnt,
         'UPDATE "nation" SET n_name = lower(n_name) WHERE n_regionkey = ' || CAST(rk AS VARCHAR) || ';' FROM k)
SELECT script_id, new_pos, statement FROM st""")
def q_t3(spark, sf_dir):
    """Per block of customers a script with a preamble, nation INSERTs, an UPDATE and the region INSERT last
    (its value holds a semicolon inside quotes); reordered so region rows load before nations."""
    _prep(spark, sf_dir)
    n, r = _blocks(spark)
    stmts = (r.select(F.col("r_regionkey").alias("rk"), F.lit(0).alias("p"), F.lit(0).alias("k"),
                      F.lit("SET search_path = public;").alias("s"))
             .unionByName(n.select(F.col("n_regionkey").alias("rk"), F.lit(1).alias("p"), F.col("n_nationkey").alias("k"),
                                   F.format_string("INSERT INTO \"nation\" (\"n_nationkey\", \"n_name\") VALUES (%d, '%s');",
                                                   F.col("n_nationkey"), F.col("n_name")).alias("s")))
             .unionByName(r.select(F.col("r_regionkey").alias("rk"), F.lit(2).alias("p"), F.lit(0).alias("k"),
                                   F.format_string("UPDATE \"nation\" SET n_name = lower(n_name) WHERE n_regionkey = %d;",
                                                   F.col("r_regionkey")).alias("s")))
             .unionByName(r.select(F.col("r_regionkey").alias("rk"), F.lit(3).alias("p"), F.lit(0).alias("k"),
                                   F.format_string("INSERT INTO \"region\" (\"r_regionkey\", \"r_name\") VALUES (%d, '%s; x');",
                                                   F.col("r_regionkey"), F.col("r_name")).alias("s"))))
    stmts = stmts.withColumn("script", F.concat(F.lit("region-"), F.col("rk").cast("string")))
    scripts = _assemble(stmts, "script", ["p", "k"], F.col("s"))
    # FK graph of the scripts' schema: nation -> region; tables in first-appearance order
    parsed = S.split_statements(scripts)
    tables = (parsed.withColumn("table_name", F.regexp_extract("statement", r'(?i)^\s*INSERT\s+INTO\s+"([^"]+)"', 1))
              .where(F.col("table_name") != "").groupBy("script_id", "table_name").agg(F.min("pos").alias("input_pos"))
              .withColumnRenamed("script_id", "db_id"))
    edges = tables.select("db_id").distinct().select("db_id", F.lit("nation").alias("child"), F.lit("region").alias("parent"))
    order = fk_load_order(edges, tables).withColumnRenamed("db_id", "script_id")
    re = S.reorder_scripts(scripts, order)
    return (ordered_index(re, ["script_id"], ["sort_key"], name="new_pos")
            .select("script_id", "new_pos", F.regexp_replace("statement", r"^\s+|\s+$", "").alias("statement")))
