"""Registered catalog and drift queries over the part-derived fleet of catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.operators import drift as D
from tessera.workloads import derived
from tessera.workloads.registry import _prep, query

_B = "CASE WHEN {0} THEN 'true' ELSE 'false' END"


def _bool(c):
    return _B.format(f"coalesce({c}, false)")


# DuckDB: canonical JSON fingerprint per database of a catalog + enum view; CTEs suffixed by ``s``
def fp_ctes(cat: str, enum: str, s: str) -> str:
    return f"""
colj_{s} AS (
  SELECT db_id, table_name, column_name,
    '{{"name":"' || column_name || '","type":"' || col_type || '","nullable":' || {_bool("nullable")}
    || ',"isPrimary":' || {_bool("is_primary")} || ',"isUnique":' || {_bool("is_unique")}
    || ',"default":' || CASE WHEN col_default IS NULL THEN 'null' ELSE '"' || col_default || '"' END
    || ',"foreignKey":' || CASE WHEN fk_table IS NULL THEN 'null'
         ELSE '{{"table":"' || fk_table || '","column":"' || fk_column || '"}}' END
    || ',"enum":' || CASE WHEN enum_name IS NULL THEN 'null' ELSE '"' || enum_name || '"' END || '}}' AS j
  FROM {cat}),
tj_{s} AS (SELECT db_id, table_name,
         '{{"name":"' || table_name || '","columns":[' || string_agg(j, ',' ORDER BY column_name) || ']}}' AS j
       FROM colj_{s} GROUP BY db_id, table_name),
dbj_{s} AS (SELECT db_id, '[' || string_agg(j, ',' ORDER BY table_name) || ']' AS tables FROM tj_{s} GROUP BY db_id),
ev_{s} AS (SELECT db_id, enum_name, '{{"name":"' || enum_name || '","values":['
         || string_agg('"' || enum_value || '"', ',' ORDER BY enum_value) || ']}}' AS j
       FROM {enum} GROUP BY db_id, enum_name),
ej_{s} AS (SELECT db_id, '[' || string_agg(j, ',' ORDER BY enum_name) || ']' AS enums FROM ev_{s} GROUP BY db_id),
doc_{s} AS (SELECT d.db_id, '{{"enums":' || coalesce(e.enums, '[]') || ',"tables":' || d.tables || '}}' AS c
        FROM dbj_{s} d LEFT JOIN ej_{s} e ON d.db_id = e.db_id)"""


FP_SQL = derived.cte("cat_new", "enum_new") + "," + fp_ctes("cat_new", "enum_new", "n") + "\n"


@query("a8_schema_fingerprint", FP_SQL + """
SELECT db_id, sha256(c) AS fingerprint, substr(sha256(c), 1, 12) AS short_id, length(c) AS canonical_len FROM doc_n""")
def q_a8(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new", "enum_new")
    return C.schema_fingerprint(spark.table("cat_new"), spark.table("enum_new"))


def _disp(c):
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"


# DuckDB: structural diff cat_old -> cat_new
DIFF_CTE = derived.cte("cat_old", "cat_new") + """,
ot AS (SELECT DISTINCT db_id, table_name FROM cat_old),
nt AS (SELECT DISTINCT db_id, table_name FROM cat_new),
tc AS (
  SELECT coalesce(o.db_id, n.db_id) AS db_id,
         CASE WHEN o.db_id IS NULL THEN 'table_added' ELSE 'table_removed' END AS kind,
         coalesce(o.table_name, n.table_name) AS table_name, '' AS column_name, '' AS detail, 0 AS seq
  FROM ot o FULL JOIN nt n ON o.db_id = n.db_id AND o.table_name = n.table_name
  WHERE o.db_id IS NULL OR n.db_id IS NULL),
bt AS (SELECT o.db_id, o.table_name FROM ot o JOIN nt n ON o.db_id = n.db_id AND o.table_name = n.table_name),
oc AS (SELECT c.* FROM cat_old c JOIN bt ON c.db_id = bt.db_id AND c.table_name = bt.table_name),
nc AS (SELECT c.* FROM cat_new c JOIN bt ON c.db_id = bt.db_id AND c.table_name = bt.table_name),
j AS (
  SELECT coalesce(o.db_id, n.db_id) AS db_id, coalesce(o.table_name, n.table_name) AS table_name,
         coalesce(o.column_name, n.column_name) AS column_name,
         o.column_name IS NOT NULL AS has_o, n.column_name IS NOT NULL AS has_n,
         o.col_type AS o_type, n.col_type AS n_type,
         coalesce(o.nullable, false) AS o_null, coalesce(n.nullable, false) AS n_null,
         o.col_default AS o_def, n.col_default AS n_def,
         coalesce(o.is_primary, false) AS o_pk, coalesce(n.is_primary, false) AS n_pk,
         coalesce(o.is_unique, false) AS o_uq, coalesce(n.is_unique, false) AS n_uq,
         coalesce(o.is_generated, false) AS o_gen, coalesce(n.is_generated, false) AS n_gen,
         CASE WHEN o.fk_table IS NOT NULL THEN o.fk_table || '.' || o.fk_column END AS o_ref,
         CASE WHEN n.fk_table IS NOT NULL THEN n.fk_table || '.' || n.fk_column END AS n_ref
  FROM oc o FULL JOIN nc n
    ON o.db_id = n.db_id AND o.table_name = n.table_name AND o.column_name = n.column_name),
jb AS (
  SELECT *, concat_ws(', ',
      CASE WHEN o_type IS DISTINCT FROM n_type THEN 'type changed ' || o_type || ' -> ' || n_type END,
      CASE WHEN o_null <> n_null THEN 'nullable ' || """ + _B.format("o_null") + """ || ' -> ' || """ + _B.format("n_null") + """ END,
      CASE WHEN o_def IS DISTINCT FROM n_def THEN 'default ' || """ + _disp("o_def") + """ || ' -> ' || """ + _disp("n_def") + """ END,
      CASE WHEN o_pk <> n_pk THEN 'isPrimary ' || """ + _B.format("o_pk") + """ || ' -> ' || """ + _B.format("n_pk") + """ END,
      CASE WHEN o_uq <> n_uq THEN 'isUnique ' || """ + _B.format("o_uq") + """ || ' -> ' || """ + _B.format("n_uq") + """ END,
      CASE WHEN o_gen <> n_gen THEN 'isGenerated ' || """ + _B.format("o_gen") + """ || ' -> ' || """ + _B.format("n_gen") + """ END
    ) AS bits FROM j),
changes AS (
  SELECT * FROM tc
  UNION ALL
  SELECT db_id, 'column_added', table_name, column_name,
         n_type || ' nullable=' || """ + _B.format("n_null") + """
         || CASE WHEN n_def IS NOT NULL THEN ' default="' || n_def || '"' ELSE '' END
         || CASE WHEN n_gen THEN ' generated' ELSE '' END, 1
  FROM jb WHERE NOT has_o
  UNION ALL
  SELECT db_id, 'fk_added', table_name, column_name, n_ref, 2 FROM jb WHERE NOT has_o AND n_ref IS NOT NULL
  UNION ALL
  SELECT db_id, 'column_removed', table_name, column_name, '', 1 FROM jb WHERE NOT has_n
  UNION ALL
  SELECT db_id, 'column_changed', table_name, column_name, bits, 1 FROM jb WHERE has_o AND has_n AND bits <> ''
  UNION ALL
  SELECT db_id,
         CASE WHEN o_ref IS NULL THEN 'fk_added' WHEN n_ref IS NULL THEN 'fk_removed' ELSE 'fk_changed' END,
         table_name, column_name,
         CASE WHEN o_ref IS NULL THEN '-> ' || n_ref WHEN n_ref IS NULL THEN '(removed)'
              ELSE o_ref || ' -> ' || n_ref END, 2
  FROM jb WHERE has_o AND has_n AND coalesce(o_ref, '') <> coalesce(n_ref, ''))
"""


def _diff(spark, sf_dir, materialize=False):
    _prep(spark, sf_dir, "cat_old", "cat_new")
    old, new = spark.table("cat_old"), spark.table("cat_new")
    return old, new, (D.drift_changes(old, new) if materialize else D.schema_diff(old, new))


@query("j2_schema_diff", DIFF_CTE + "SELECT db_id, kind, table_name, column_name, detail, seq FROM changes")
def q_j2(spark, sf_dir):
    return _diff(spark, sf_dir)[2]


@query("a5_diff_summary", DIFF_CTE + """,
agg AS (SELECT db_id,
          count(*) FILTER (WHERE kind = 'table_added') AS added_tables,
          count(*) FILTER (WHERE kind = 'table_removed') AS removed_tables,
          count(*) FILTER (WHERE kind = 'column_added') AS added_columns,
          count(*) FILTER (WHERE kind = 'column_removed') AS removed_columns,
          count(*) FILTER (WHERE kind = 'column_changed') AS changed_columns
        FROM changes GROUP BY db_id)
SELECT *, CASE WHEN s = '' THEN '-' ELSE s END AS summary FROM (
  SELECT *, concat_ws(' ',
     CASE WHEN added_tables > 0 THEN '+' || added_tables || ' tbl' END,
     CASE WHEN removed_tables > 0 THEN '-' || removed_tables || ' tbl' END,
     CASE WHEN added_columns > 0 THEN '+' || added_columns || ' col' END,
     CASE WHEN removed_columns > 0 THEN '-' || removed_columns || ' col' END,
     CASE WHEN changed_columns > 0 THEN '~' || changed_columns || ' col' END) AS s FROM agg) x""".replace(
    "SELECT *, CASE WHEN s = '' THEN '-' ELSE s END AS summary FROM (",
    "SELECT db_id, added_tables, removed_tables, added_columns, removed_columns, changed_columns, "
    "CASE WHEN s = '' THEN '-' ELSE s END AS summary FROM ("))
def q_a5(spark, sf_dir):
    return D.diff_summary(_diff(spark, sf_dir)[2])


RENAME_CTE = DIFF_CTE + """,
adds AS (SELECT c.db_id, c.table_name, c.column_name AS added, n.col_type
         FROM changes c JOIN cat_new n ON c.db_id = n.db_id AND c.table_name = n.table_name
           AND c.column_name = n.column_name WHERE c.kind = 'column_added'),
drops AS (SELECT c.db_id, c.table_name, c.column_name AS dropped, o.col_type
          FROM changes c JOIN cat_old o ON c.db_id = o.db_id AND c.table_name = o.table_name
            AND c.column_name = o.column_name WHERE c.kind = 'column_removed'),
renames AS (
  SELECT a.db_id, a.table_name, a.added AS column_name, min(d.dropped) AS from_column
  FROM adds a JOIN drops d ON a.db_id = d.db_id AND a.table_name = d.table_name AND a.col_type = d.col_type
  WHERE lower(a.added) = lower(d.dropped)
     OR starts_with(lower(a.added), lower(d.dropped)) OR starts_with(lower(d.dropped), lower(a.added))
     OR ends_with(lower(a.added), lower(d.dropped)) OR ends_with(lower(d.dropped), lower(a.added))
     OR least(length(a.added), length(d.dropped)) / greatest(length(a.added), length(d.dropped)) >= 0.6
  GROUP BY a.db_id, a.table_name, a.added)
"""


@query("j3_detect_renames", RENAME_CTE + "SELECT db_id, table_name, column_name, from_column FROM renames")
def q_j3(spark, sf_dir):
    old, new, ch = _diff(spark, sf_dir, materialize=True)
    return D.detect_renames(ch)


_DEFAULT_STRATEGY_SQL = """CASE
  WHEN lower(trim(regexp_replace({d}, '::[^:]*$', ''))) LIKE '%gen_random_uuid%'
    OR lower(trim(regexp_replace({d}, '::[^:]*$', ''))) LIKE '%uuid_generate%' THEN 'uuid'
  WHEN (lower(trim(regexp_replace({d}, '::[^:]*$', ''))) LIKE '%(%'
        OR lower(trim(regexp_replace({d}, '::[^:]*$', ''))) IN
           ('current_timestamp', 'current_date', 'current_time', 'localtime', 'localtimestamp', 'now'))
   AND (lower({t}) LIKE '%time%' OR lower({t}) LIKE '%date%') THEN 'timestamp'
  ELSE 'default' END"""

CLASSIFY_CTE = RENAME_CTE + """,
cm AS (
  SELECT c.*, n.col_type AS m_type, coalesce(n.nullable, false) AS m_null, n.col_default AS m_def,
         coalesce(n.is_generated, false) AS m_gen, n.fk_table AS m_fkt, n.fk_column AS m_fkc,
         n.column_name IS NOT NULL AS has_m, r.from_column,
         """ + _DEFAULT_STRATEGY_SQL.format(d="n.col_default", t="n.col_type") + """ AS strat,
         lower(c.detail) AS d
  FROM changes c
  LEFT JOIN cat_new n ON c.db_id = n.db_id AND c.table_name = n.table_name AND c.column_name = n.column_name
  LEFT JOIN renames r ON c.db_id = r.db_id AND c.table_name = r.table_name AND c.column_name = r.column_name),
classified AS (
  SELECT db_id, kind, table_name, column_name, detail, seq,
    CASE
      WHEN kind = 'table_added' THEN 'auto'
      WHEN kind = 'table_removed' THEN 'breaking'
      WHEN kind = 'column_removed' THEN 'auto'
      WHEN kind = 'column_added' AND NOT has_m THEN 'decision'
      WHEN kind = 'column_added' AND m_gen THEN 'auto'
      WHEN kind = 'column_added' AND from_column IS NOT NULL THEN 'likely'
      WHEN kind = 'column_added' AND m_null THEN 'auto'
      WHEN kind = 'column_added' AND m_def IS NOT NULL THEN 'auto'
      WHEN kind = 'column_added' THEN 'decision'
      WHEN kind = 'column_changed' THEN CASE
        WHEN d LIKE '%isprimary%' THEN 'breaking'
        WHEN d LIKE '%type changed%' THEN CASE WHEN
             (d LIKE '%varchar%' AND d LIKE '%text%') OR (d LIKE '%character varying%' AND d LIKE '%text%')
          OR (d LIKE '%integer%' AND d LIKE '%bigint%') OR (d LIKE '%int%' AND d LIKE '%bigint%')
          OR (d LIKE '%float%' AND d LIKE '%double%') OR (d LIKE '%real%' AND d LIKE '%double precision%')
          OR (d LIKE '%timestamp without time zone%' AND d LIKE '%timestamp with time zone%')
          THEN 'likely' ELSE 'breaking' END
        WHEN d LIKE '%nullable%' THEN CASE WHEN d LIKE '%true -> false%' THEN 'decision' ELSE 'auto' END
        WHEN d LIKE '%default%' THEN 'auto'
        WHEN d LIKE '%isgenerated%' THEN 'likely'
        WHEN d LIKE '%isunique true%' THEN 'decision'
        WHEN d LIKE '%isunique false%' THEN 'auto'
        ELSE 'likely' END
      WHEN kind = 'fk_added' THEN 'decision'
      WHEN kind = 'fk_removed' THEN 'auto'
      WHEN kind = 'fk_changed' THEN 'likely'
      ELSE 'decision' END AS category,
    CASE
      WHEN kind = 'column_removed' THEN 'drop_column'
      WHEN kind = 'column_added' AND has_m AND NOT m_gen AND from_column IS NOT NULL THEN 'rename_column'
      WHEN kind = 'column_added' AND has_m AND NOT m_gen AND (m_null OR m_def IS NOT NULL) THEN 'add_column'
    END AS op,
    CASE WHEN kind = 'column_added' AND has_m AND NOT m_gen AND from_column IS NULL AND m_null THEN 'constant'
         WHEN kind = 'column_added' AND has_m AND NOT m_gen AND from_column IS NULL AND m_def IS NOT NULL THEN strat
    END AS op_strategy,
    CASE
      WHEN kind = 'table_added' THEN 'new table — no existing data affected'
      WHEN kind = 'table_removed' THEN 'table removed — possible FK references from other tables'
      WHEN kind = 'column_removed' THEN 'column removed — drop from CSV'
      WHEN kind = 'column_added' AND NOT has_m THEN 'new column — schema metadata unavailable'
      WHEN kind = 'column_added' AND m_gen THEN 'generated column — no CSV value needed'
      WHEN kind = 'column_added' AND from_column IS NOT NULL THEN 'possible rename from ' || from_column || ' (same type)'
      WHEN kind = 'column_added' AND m_null THEN 'nullable column — fill with empty'
      WHEN kind = 'column_added' AND m_def IS NOT NULL THEN 'column has a default — fill with ' || strat
      WHEN kind = 'column_added' AND m_fkt IS NOT NULL
        THEN 'required FK column references ' || m_fkt || '.' || m_fkc || ' — need a valid parent row'
      WHEN kind = 'column_added' THEN 'NOT NULL column without default — need a fill strategy'
      WHEN kind = 'fk_added' THEN 'FK added to existing column referencing ' || detail || ' — existing rows may violate constraint'
      WHEN kind = 'fk_removed' THEN 'FK removed — no CSV transformation needed'
      WHEN kind = 'fk_changed' THEN 'FK target changed to ' || detail || ' — existing references may need update'
      ELSE '' END AS reason,
    CASE WHEN kind = 'column_added' AND has_m AND NOT m_gen AND from_column IS NOT NULL THEN from_column
         WHEN kind = 'column_added' AND has_m AND NOT m_gen AND m_null THEN '' END AS op_value
  FROM cm)
"""


@query("j4_classify_drift", CLASSIFY_CTE +
       "SELECT db_id, kind, table_name, column_name, detail, seq, category, reason, op, op_strategy, op_value "
       "FROM classified")
def q_j4(spark, sf_dir):
    old, new, ch = _diff(spark, sf_dir, materialize=True)
    return D.classify_drift(ch)


@query("a6_drift_report", CLASSIFY_CTE + """,
pairs AS (SELECT DISTINCT db_id FROM cat_old UNION SELECT DISTINCT db_id FROM cat_new),
agg AS (SELECT db_id, count(*) FILTER (WHERE category = 'auto') AS n_auto,
          count(*) FILTER (WHERE category = 'likely') AS n_likely,
          count(*) FILTER (WHERE category = 'decision') AS n_decision,
          count(*) FILTER (WHERE category = 'breaking') AS n_breaking, count(*) AS n_changes
        FROM classified GROUP BY db_id)
SELECT p.db_id, coalesce(n_auto, 0) AS n_auto, coalesce(n_likely, 0) AS n_likely,
       coalesce(n_decision, 0) AS n_decision, coalesce(n_breaking, 0) AS n_breaking,
       coalesce(n_changes, 0) > 0 AS has_drift,
       coalesce(n_decision, 0) = 0 AND coalesce(n_breaking, 0) = 0 AND coalesce(n_likely, 0) = 0 AS auto_resolvable,
       coalesce(n_decision, 0) > 0 AS needs_decision, coalesce(n_breaking, 0) > 0 AS has_breaking
FROM pairs p LEFT JOIN agg a ON p.db_id = a.db_id""")
def q_a6(spark, sf_dir):
    old, new, ch = _diff(spark, sf_dir, materialize=True)
    pairs = old.select("db_id").union(new.select("db_id")).distinct()
    return D.drift_report(D.classify_drift(ch), pairs)


@query("p9_exclude_tables", derived.cte("cat_new") + """
SELECT db_id, table_name, column_name, col_type FROM cat_new
WHERE lower(table_name) NOT IN ('economy_anvil', 'promo_gear', 'small_rod')""")
def q_p9(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    out = C.exclude_tables(spark.table("cat_new"), ["ECONOMY_anvil", "promo_GEAR", "small_rod"])
    return out.select("db_id", "table_name", "column_name", "col_type")


@query("u2_key_universe", derived.cte("cat_old", "cat_new") + """
SELECT db_id, table_name FROM cat_old UNION SELECT db_id, table_name FROM cat_new""")
def q_u2(spark, sf_dir):
    _prep(spark, sf_dir, "cat_old", "cat_new")
    return C.key_universe(spark.table("cat_old"), spark.table("cat_new"), ["db_id", "table_name"])


@query("u3_column_set_delta", derived.cte("cat_old", "cat_new") + """,
bt AS (SELECT DISTINCT o.db_id, o.table_name FROM cat_old o JOIN cat_new n
       ON o.db_id = n.db_id AND o.table_name = n.table_name),
a AS (SELECT n.db_id, n.table_name, string_agg(n.column_name, ',' ORDER BY n.ordinal) AS added
      FROM cat_new n WHERE NOT EXISTS (SELECT 1 FROM cat_old o WHERE o.db_id = n.db_id
        AND o.table_name = n.table_name AND o.column_name = n.column_name) GROUP BY n.db_id, n.table_name),
r AS (SELECT o.db_id, o.table_name, string_agg(o.column_name, ',' ORDER BY o.ordinal) AS removed
      FROM cat_old o WHERE NOT EXISTS (SELECT 1 FROM cat_new n WHERE o.db_id = n.db_id
        AND o.table_name = n.table_name AND o.column_name = n.column_name) GROUP BY o.db_id, o.table_name)
SELECT bt.db_id, bt.table_name, coalesce(a.added, '') AS added, coalesce(r.removed, '') AS removed
FROM bt LEFT JOIN a ON bt.db_id = a.db_id AND bt.table_name = a.table_name
LEFT JOIN r ON bt.db_id = r.db_id AND bt.table_name = r.table_name""")
def q_u3(spark, sf_dir):
    _prep(spark, sf_dir, "cat_old", "cat_new")
    d = C.column_set_delta(spark.table("cat_old"), spark.table("cat_new"))
    return d.select("db_id", "table_name", F.array_join("added", ",").alias("added"),
                    F.array_join("removed", ",").alias("removed"))


@query("t1_fk_edges", derived.cte("cat_new") + """
SELECT DISTINCT db_id, table_name AS child, fk_table AS parent FROM cat_new
WHERE fk_table IS NOT NULL AND fk_table <> table_name AND NOT coalesce(nullable, false)""")
def q_t1(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    return C.fk_edges(spark.table("cat_new"))


INVENTORY_SQL = """
inv_{v} AS (
  SELECT DISTINCT db_id, 'table' AS kind, table_name AS name FROM cat_{v}
  UNION ALL SELECT db_id, 'fk', table_name || '_' || column_name || '_fkey' FROM cat_{v} WHERE fk_table IS NOT NULL
  UNION ALL SELECT DISTINCT db_id, 'enum', enum_name FROM enum_{v})"""


@query("u1_object_inventory", derived.cte("cat_new", "enum_new") + "," + INVENTORY_SQL.format(v="new") +
       "\nSELECT db_id, kind, name FROM inv_new")
def q_u1(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new", "enum_new")
    return C.object_inventory(spark.table("cat_new"), spark.table("enum_new"))


@query("j5_missing_objects", derived.cte("cat_old", "cat_new", "enum_old", "enum_new") + ","
       + INVENTORY_SQL.format(v="old") + "," + INVENTORY_SQL.format(v="new") + """,
tabs AS (SELECT db_id, table_name FROM cat_new UNION SELECT db_id, table_name FROM cat_old),
fkp AS (SELECT DISTINCT c.db_id, c.table_name || '_' || c.column_name || '_fkey' AS name
        FROM cat_new c JOIN tabs t ON t.db_id = c.db_id AND t.table_name = c.fk_table)
SELECT w.db_id, w.kind, w.name, 'create' AS action FROM inv_new w
LEFT JOIN inv_old e ON e.db_id = w.db_id AND e.kind = w.kind AND e.name = w.name
LEFT JOIN fkp ON fkp.db_id = w.db_id AND fkp.name = w.name
WHERE e.name IS NULL AND (w.kind <> 'fk' OR fkp.name IS NOT NULL)
UNION ALL
SELECT e.db_id, e.kind, e.name, 'truncate' FROM inv_old e
JOIN inv_new w ON w.db_id = e.db_id AND w.kind = 'table' AND w.name = e.name
WHERE e.kind = 'table'""")
def q_j5(spark, sf_dir):
    _prep(spark, sf_dir, "cat_old", "cat_new", "enum_old", "enum_new")
    old, new = spark.table("cat_old"), spark.table("cat_new")
    wanted_base = C.object_inventory(new, spark.table("enum_new"))
    fkp = C.fk_inventory_with_parents(new, old)
    wanted = (wanted_base.join(fkp.select("db_id", "kind", "name", "parent_known"), ["db_id", "kind", "name"], "left")
              .withColumn("parent_known", F.coalesce("parent_known", F.lit(True))))
    existing = C.object_inventory(old, spark.table("enum_old"))
    return C.missing_objects(wanted, existing)


@query("p10_map_column_types", derived.cte("cat_new") + """
SELECT db_id, table_name, column_name, col_type,
  CASE WHEN lower(col_type) IN ('varchar', 'character varying') AND varchar_len IS NOT NULL THEN 'VARCHAR(' || varchar_len || ')'
       WHEN lower(col_type) IN ('varchar', 'character varying') THEN 'VARCHAR(255)'
       WHEN lower(col_type) = 'char' AND varchar_len IS NOT NULL THEN 'CHAR(' || varchar_len || ')'
       WHEN lower(col_type) IN ('text', 'longtext', 'mediumtext', 'tinytext') THEN upper(col_type)
       WHEN lower(col_type) IN ('integer', 'int4') THEN 'INT'
       WHEN lower(col_type) IN ('bigint', 'int8') THEN 'BIGINT'
       WHEN lower(col_type) IN ('smallint', 'int2') THEN 'SMALLINT'
       WHEN lower(col_type) IN ('boolean', 'bool') THEN 'TINYINT(1)'
       WHEN lower(col_type) IN ('numeric', 'decimal') THEN 'DECIMAL(18,6)'
       WHEN lower(col_type) IN ('real', 'float4') THEN 'FLOAT'
       WHEN lower(col_type) IN ('double precision', 'float8') THEN 'DOUBLE'
       WHEN lower(col_type) LIKE '%timestamp%' THEN 'DATETIME(6)'
       WHEN lower(col_type) = 'date' THEN 'DATE'
       WHEN lower(col_type) = 'time' THEN 'TIME'
       WHEN lower(col_type) IN ('json', 'jsonb') THEN 'JSON'
       WHEN lower(col_type) = 'uuid' THEN 'CHAR(36)'
       WHEN lower(col_type) = 'bytea' THEN 'BLOB'
       ELSE upper(col_type) END AS mysql_type,
  CASE WHEN lower(col_type) IN ('json', 'jsonb') THEN 'string'
       WHEN lower(col_type) LIKE 'array%' OR lower(col_type) LIKE '%[]' THEN 'string'
       WHEN lower(col_type) LIKE '%time%' OR lower(col_type) LIKE '%date%' THEN
         CASE WHEN lower(col_type) = 'date' THEN 'date' ELSE 'timestamp' END
       WHEN lower(col_type) IN ('boolean', 'bool') THEN 'boolean'
       WHEN lower(col_type) LIKE '%int%' OR lower(col_type) LIKE '%serial%' THEN 'bigint'
       WHEN lower(col_type) LIKE '%float%' OR lower(col_type) LIKE '%numeric%' OR lower(col_type) LIKE '%decimal%'
         OR lower(col_type) LIKE '%double%' OR lower(col_type) = 'real' THEN 'double'
       ELSE 'string' END AS spark_type
FROM cat_new""")
def q_p10(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    return C.map_column_types(spark.table("cat_new"))


@query("p13_classify_default", derived.cte("cat_new") + """
SELECT db_id, table_name, column_name, col_type, col_default,
  """ + _DEFAULT_STRATEGY_SQL.format(d="col_default", t="col_type") + """ AS strategy
FROM cat_new WHERE col_default IS NOT NULL""")
def q_p13(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    return C.classify_defaults(spark.table("cat_new"))


@query("j1_assemble_schema", derived.cte("cat_new", "enum_new") + """,
en AS (SELECT DISTINCT db_id, enum_name FROM enum_new)
SELECT c.db_id, c.table_name, c.ordinal, c.column_name,
       CASE WHEN en.enum_name IS NOT NULL THEN 'enum' ELSE c.col_type END AS col_type,
       CAST(NULL AS INTEGER) AS varchar_len, c.nullable, c.col_default, c.is_primary, c.is_unique, c.is_generated,
       en.enum_name, c.fk_table, c.fk_column
FROM cat_new c LEFT JOIN en ON en.db_id = c.db_id AND en.enum_name = c.enum_name""")
def q_j1(spark, sf_dir):
    """Catalog tables decomposed from the derived fleet (plus a view per table) reassembled."""
    _prep(spark, sf_dir, "enum_new", "is_tables", "is_columns", "is_table_constraints", "is_key_column_usage",
          "is_constraint_column_usage")
    t = spark.table
    return C.assemble_schema(t("is_tables"), t("is_columns"), t("is_table_constraints"), t("is_key_column_usage"),
                             t("is_constraint_column_usage"), t("enum_new"))


@query("g4_sync_fingerprint", derived.cte("cat_new", "enum_new", "cat_live") + "," + fp_ctes("cat_new", "enum_new", "a")
       + "," + fp_ctes("cat_live", "enum_new", "b") + """,
d AS (SELECT DISTINCT n.db_id FROM cat_new n JOIN cat_live l
      ON n.db_id = l.db_id AND n.table_name = l.table_name AND n.column_name = l.column_name
      WHERE n.nullable <> l.nullable),
f AS (SELECT a.db_id, sha256(a.c) AS stored, sha256(b.c) AS live, d.db_id IS NOT NULL AS has_diff
      FROM doc_a a JOIN doc_b b ON a.db_id = b.db_id LEFT JOIN d ON d.db_id = a.db_id)
SELECT db_id, 'r001' AS revision,
       CASE WHEN live <> stored AND NOT has_diff THEN live ELSE stored END AS schema_fingerprint,
       live <> stored AND NOT has_diff AS fingerprint_synced
FROM f""")
def q_g4(spark, sf_dir):
    """Stored revisions fingerprinted from the fleet; the live fleet renames some enums (fingerprint
    changes, structural diff empty -> resync) and flips nullability elsewhere (real drift -> kept)."""
    _prep(spark, sf_dir, "cat_new", "enum_new", "cat_live")
    stored_cols, live_cols, enums = spark.table("cat_new"), spark.table("cat_live"), spark.table("enum_new")
    revisions = C.schema_fingerprint(stored_cols, enums).select(
        "db_id", F.lit("r001").alias("revision"), F.col("fingerprint").alias("schema_fingerprint"))
    live = C.schema_fingerprint(live_cols, enums).select("db_id", "fingerprint")
    return D.sync_fingerprint(revisions, live, D.schema_diff(stored_cols, live_cols))


_NL = "chr(10)"


@query("p10_create_table_ddl", derived.cte("cat_new") + f""",
c AS (
  SELECT db_id, table_name, ordinal, '"' || replace(column_name, '"', '""') || '"' AS qn,
         coalesce(is_primary, false) AS pk, coalesce(is_unique, false) AS uq,
         '"' || replace(column_name, '"', '""') || '" ' ||
         CASE WHEN lower(coalesce(col_default, '')) LIKE '%nextval(%' THEN
                CASE lower(col_type) WHEN 'bigint' THEN 'BIGSERIAL' WHEN 'smallint' THEN 'SMALLSERIAL' ELSE 'SERIAL' END
                || CASE WHEN NOT coalesce(nullable, false) THEN ' NOT NULL' ELSE '' END
              ELSE
                CASE WHEN col_type = 'enum' AND enum_name IS NOT NULL THEN '"' || replace(enum_name, '"', '""') || '"'
                     WHEN starts_with(col_type, 'ARRAY') THEN 'text[]'
                     WHEN col_type IN ('character varying', 'varchar') AND varchar_len IS NOT NULL
                       THEN 'varchar(' || CAST(varchar_len AS VARCHAR) || ')'
                     ELSE col_type END
                || CASE WHEN NOT coalesce(nullable, false) THEN ' NOT NULL' ELSE '' END
                || CASE WHEN coalesce(col_default, '') <> '' THEN ' DEFAULT ' || col_default ELSE '' END
         END AS def
  FROM cat_new),
t AS (
  SELECT db_id, table_name,
         string_agg(def, ',' || {_NL} || '  ' ORDER BY ordinal) AS defs,
         string_agg(CASE WHEN pk THEN qn END, ', ' ORDER BY ordinal) AS pks,
         string_agg(CASE WHEN uq AND NOT pk THEN 'UNIQUE (' || qn || ')' END, ',' || {_NL} || '  ' ORDER BY ordinal) AS uqs
  FROM c GROUP BY db_id, table_name)
SELECT db_id, table_name,
       'CREATE TABLE "' || replace(table_name, '"', '""') || '" (' || {_NL} || '  ' || defs
       || coalesce(',' || {_NL} || '  PRIMARY KEY (' || pks || ')', '')
       || coalesce(',' || {_NL} || '  ' || uqs, '') || {_NL} || ')' AS ddl
FROM t""")
def q_p10_ddl(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    return C.create_table_ddl(spark.table("cat_new"), "postgres")


@query("j1_assemble_schema_mysql", derived.cte("cat_new", "enum_new") + """,
en AS (SELECT DISTINCT db_id, enum_name FROM enum_new)
SELECT c.db_id, c.table_name, c.ordinal, c.column_name,
       CASE WHEN en.enum_name IS NOT NULL THEN 'enum' WHEN c.col_type = 'varchar(255)' THEN 'varchar'
            ELSE c.col_type END AS col_type,
       CASE WHEN c.col_type = 'varchar(255)' THEN c.varchar_len END AS varchar_len,
       c.nullable,
       CASE WHEN c.is_primary AND c.col_default = '0' THEN 'AUTO_INCREMENT' ELSE c.col_default END AS col_default,
       c.is_primary, c.is_unique AND NOT c.is_primary AS is_unique, c.is_generated,
       CASE WHEN en.enum_name IS NOT NULL THEN c.table_name || '_' || c.column_name END AS enum_name,
       c.fk_table, c.fk_column
FROM cat_new c LEFT JOIN en ON en.db_id = c.db_id AND en.enum_name = c.enum_name""")
def q_j1_mysql(spark, sf_dir):
    """The fleet decomposed into MySQL's information_schema shape (inline enum types, column keys,
    EXTRA flags) and reassembled."""
    _prep(spark, sf_dir, "my_columns", "my_key_column_usage")
    cols, _enums = C.assemble_schema_mysql(spark.table("my_columns"), spark.table("my_key_column_usage"))
    return cols


@query("p10_create_table_ddl_mysql", derived.cte("cat_new") + f""",
c AS (
  SELECT db_id, table_name, ordinal, '`' || replace(column_name, '`', '``') || '`' AS qn,
         coalesce(is_primary, false) AS pk, coalesce(is_unique, false) AS uq,
         '`' || replace(column_name, '`', '``') || '` ' ||
         CASE WHEN upper(trim(coalesce(col_default, ''))) = 'AUTO_INCREMENT' THEN 'INT AUTO_INCREMENT'
              ELSE CASE WHEN lower(col_type) IN ('text', 'longtext', 'mediumtext', 'tinytext') THEN upper(col_type)
                        WHEN lower(col_type) IN ('integer', 'int4') THEN 'INT'
                        WHEN lower(col_type) IN ('bigint', 'int8') THEN 'BIGINT'
                        WHEN lower(col_type) IN ('boolean', 'bool') THEN 'TINYINT(1)'
                        WHEN lower(col_type) IN ('numeric', 'decimal') THEN 'DECIMAL(18,6)'
                        WHEN lower(col_type) LIKE '%timestamp%' THEN 'DATETIME(6)'
                        WHEN lower(col_type) IN ('json', 'jsonb') THEN 'JSON'
                        ELSE upper(col_type) END
                   || CASE WHEN NOT coalesce(nullable, false) THEN ' NOT NULL' ELSE '' END
                   || CASE WHEN coalesce(col_default, '') <> '' THEN ' DEFAULT ' || col_default ELSE '' END
         END AS def
  FROM cat_new),
t AS (
  SELECT db_id, table_name,
         string_agg(def, ',' || {_NL} || '  ' ORDER BY ordinal) AS defs,
         string_agg(CASE WHEN pk THEN qn END, ', ' ORDER BY ordinal) AS pks,
         string_agg(CASE WHEN uq AND NOT pk THEN 'UNIQUE (' || qn || ')' END, ',' || {_NL} || '  ' ORDER BY ordinal) AS uqs
  FROM c GROUP BY db_id, table_name)
SELECT db_id, table_name,
       'CREATE TABLE `' || replace(table_name, '`', '``') || '` (' || {_NL} || '  ' || defs
       || coalesce(',' || {_NL} || '  PRIMARY KEY (' || pks || ')', '')
       || coalesce(',' || {_NL} || '  ' || uqs, '') || {_NL} || ') ENGINE=InnoDB DEFAULT CHARSET=utf8mb4' AS ddl
FROM t""")
def q_p10_ddl_mysql(spark, sf_dir):
    _prep(spark, sf_dir, "cat_new")
    return C.create_table_ddl(spark.table("cat_new"), "mysql")
