"""Operator inputs derived from the driver tables.

The reference works on schema documents, revision manifests, usage events and
snapshot files. The registered queries derive those inputs from the driver
tables with plain SQL so that their size grows with the tables. Each view is
written in the SQL subset Spark SQL and DuckDB share, so the oracle runs the
same derivation as a CTE and only the operator itself differs between the two
sides.

Derivations (no rows are dropped to make anything cheaper; every row of the
source table feeds the view):

* ``usage_events``  events -> usage sightings (state = event type, one test file per user).
* ``cat_old`` / ``cat_new``  part -> a fleet of schema catalogs, one database per
  brand and block of 2,000 part keys (so databases grow in number, not in size), one table per (type, noun), one column per part; the new version moves,
  drops, renames, retypes and re-flags columns by rules on the part attributes.
* ``enum_old`` / ``enum_new``  part -> enum definitions per database.
* revisions (in ``q_revisions``)  orders -> one revision per order, scenario per customer.
* ``observations``  events -> fingerprint sightings (db = user, fingerprint = event type).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column type of a derived catalog column, chosen by p_size % 8.
_TYPE_BY_SIZE = """CASE p_size % 8 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' WHEN 2 THEN 'varchar(255)'
      WHEN 3 THEN 'timestamp without time zone' WHEN 4 THEN 'boolean' WHEN 5 THEN 'numeric'
      WHEN 6 THEN 'bigint' ELSE 'jsonb' END"""

_CAT_BASE = f"""
SELECT p_partkey, p_name, p_type, p_size, p_retailprice,
       p_brand || '-' || CAST(p_partkey - p_partkey % 2000 AS STRING) AS db_id,
       CASE WHEN p_size >= 49 THEN lower(p_type) || '_legacy'
            ELSE lower(p_type) || '_' || split_part(p_name, ' ', 2) END AS table_name,
       split_part(p_name, ' ', 1) || '_' || CAST(p_partkey AS STRING) AS column_name,
       {_TYPE_BY_SIZE} AS col_type,
       CASE WHEN p_size % 8 = 2 THEN 255 ELSE NULL END AS varchar_len,
       (p_size % 3 = 0) AS nullable,
       CASE WHEN p_size % 7 = 0 THEN 'now()' WHEN p_size % 7 = 1 THEN '0'
            WHEN p_size % 7 = 2 THEN '''draft''::text' ELSE NULL END AS col_default,
       (p_size = 1) AS is_primary,
       (p_size % 10 = 3) AS is_unique,
       (p_size % 17 = 5) AS is_generated,
       CASE WHEN p_size % 9 = 4 THEN lower(p_type) || '_' ||
            (CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'bolt' WHEN 'bolt' THEN 'gear'
             WHEN 'gear' THEN 'gizmo' WHEN 'gizmo' THEN 'plate' WHEN 'plate' THEN 'ring'
             WHEN 'ring' THEN 'rod' WHEN 'rod' THEN 'widget' ELSE 'anvil' END)
            ELSE NULL END AS fk_table,
       CASE WHEN p_size % 9 = 4 THEN 'id' ELSE NULL END AS fk_column,
       CASE WHEN p_size % 8 = 7 AND p_retailprice > 990 THEN 'kind_' || lower(p_type) ELSE NULL END AS enum_name
FROM part
"""

_CAT_COLS = ("db_id, table_name, CAST(p_partkey AS BIGINT) AS ordinal, column_name, col_type, varchar_len, "
             "nullable, col_default, is_primary, is_unique, is_generated, enum_name, fk_table, fk_column")

VIEWS: dict[str, str] = {
    "usage_events": """
SELECT event_type AS state,
       'tests/user_' || CAST(user_id AS STRING) || '.spec.ts' AS file,
       CASE WHEN value < 10 THEN 'smoke' ELSE 'full flow' END AS title,
       'chromium' AS project,
       CASE WHEN value >= 25 THEN 'reset' ELSE 'keep' END AS reset_mode,
       ts AS last_seen_at,
       props AS test_hash
FROM events""",
    "cat_base": _CAT_BASE,
    # old version: every part except the ones that are only in the new version
    "cat_old": f"""
SELECT {_CAT_COLS} FROM cat_base
WHERE NOT (split_part(p_name, ' ', 1) = 'new' AND p_size BETWEEN 20 AND 27)""",
    # new version: legacy tables gone, some columns dropped / renamed / retyped / re-flagged
    "cat_new": """
SELECT db_id, table_name, CAST(p_partkey AS BIGINT) AS ordinal,
       CASE WHEN split_part(p_name, ' ', 1) = 'blue' AND p_size < 8 THEN column_name || '_v2'
            WHEN split_part(p_name, ' ', 1) = 'cold' AND p_size < 6 THEN 'c' || CAST(p_partkey AS STRING)
            ELSE column_name END AS column_name,
       CASE WHEN col_type = 'integer' AND p_retailprice > 950 THEN 'bigint'
            WHEN col_type = 'varchar(255)' AND p_retailprice > 980 THEN 'text'
            WHEN col_type = 'numeric' AND p_retailprice < 920 THEN 'integer'
            ELSE col_type END AS col_type,
       varchar_len,
       CASE WHEN split_part(p_name, ' ', 1) = 'small' AND p_size % 3 = 0 THEN false
            WHEN split_part(p_name, ' ', 1) = 'hot' AND p_size % 3 = 1 THEN true
            ELSE nullable END AS nullable,
       CASE WHEN split_part(p_name, ' ', 1) = 'old' AND p_size % 7 = 3 THEN 'gen_random_uuid()'
            ELSE col_default END AS col_default,
       CASE WHEN p_size = 2 AND p_retailprice > 990 THEN true ELSE is_primary END AS is_primary,
       CASE WHEN split_part(p_name, ' ', 1) = 'large' AND p_size % 10 = 3 THEN false ELSE is_unique END AS is_unique,
       CASE WHEN p_size IN (11, 22) THEN NOT is_generated ELSE is_generated END AS is_generated, enum_name,
       CASE WHEN split_part(p_name, ' ', 1) = 'red' AND p_size % 9 = 5 THEN lower(p_type) || '_anvil'
            WHEN p_size = 13 THEN NULL WHEN p_size = 31 THEN lower(p_type) || '_legacy'
            ELSE fk_table END AS fk_table,
       CASE WHEN split_part(p_name, ' ', 1) = 'red' AND p_size % 9 = 5 THEN 'id' WHEN p_size = 13 THEN NULL
            WHEN p_size = 40 THEN 'code' ELSE fk_column END AS fk_column
FROM cat_base
WHERE p_size < 49 AND NOT (split_part(p_name, ' ', 1) = 'red' AND p_size > 40)""",
    "enum_old": """
SELECT p_brand || '-' || CAST(p_partkey - p_partkey % 2000 AS STRING) AS db_id, 'kind_' || lower(p_type) AS enum_name, split_part(p_name, ' ', 2) AS enum_value
FROM part WHERE p_retailprice > 990 GROUP BY 1, 2, 3""",
    "enum_new": """
SELECT p_brand || '-' || CAST(p_partkey - p_partkey % 2000 AS STRING) AS db_id, 'kind_' || lower(p_type) AS enum_name, split_part(p_name, ' ', 2) AS enum_value
FROM part WHERE p_retailprice > 985 GROUP BY 1, 2, 3""",
    "events_nulled": """
SELECT event_id, ts,
       CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS user_id,
       NULLIF(event_type, 'view') AS event_type,
       CASE WHEN value < 5 THEN NULL ELSE value END AS value,
       props
FROM events""",
    "customer_marked": """
SELECT c_custkey, c_name,
       CASE WHEN c_acctbal > 5000 THEN '@env:SEG_' || c_mktsegment ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_nationkey < 5 THEN '@env:NATION_' || CAST(c_nationkey AS STRING)
            ELSE CAST(c_nationkey AS STRING) END AS c_nation
FROM customer""",
    "props_damaged": r"""
SELECT event_id,
       CASE WHEN event_id % 3 = 0 THEN replace(props, '"k"', 'k')
            WHEN event_id % 2 = 1 THEN replace(props, '"', '''')
            ELSE props END AS props
FROM events""",
    "array_cells": r"""
SELECT p_partkey,
       CASE WHEN p_size % 7 = 0 THEN '[' || p_brand || ', "' || p_type || '" ,]'
            WHEN p_size % 5 = 0 THEN '[' || CAST(p_size AS STRING) || ',"' || p_type || '",null]'
            WHEN p_size % 2 = 0 THEN '[''' || p_brand || ''',''' || p_type || ''']'
            WHEN p_size % 3 = 0 THEN '{' || p_brand || ',' || p_type || '}'
            ELSE '["' || p_brand || '","' || p_type || '"]' END AS cell
FROM part""",
    "check_clauses": r"""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F'
            THEN 'CHECK ((priority = ANY (ARRAY[''' || o_orderpriority || '''::text, ''' || o_orderstatus || '''::text])))'
            WHEN o_orderstatus = 'O'
            THEN 'CHECK (priority in (''' || o_orderpriority || ''', ''x''))'
            ELSE 'CHECK ((total > 0))' END AS clause
FROM orders""",
    "observations": """
SELECT 'db' || CAST(user_id AS STRING) AS db_id, event_type AS fingerprint, ts AS seen_at
FROM events""",
}

# view -> views it reads (derived ones only)
DEPENDS: dict[str, list[str]] = {
    "cat_old": ["cat_base"],
    "cat_new": ["cat_base"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def register(spark: SparkSession, *names: str) -> None:
    """Create the named derived views (and what they read) as Spark temp views."""
    for n in _closure(names):
        spark.sql(VIEWS[n]).createOrReplaceTempView(n)


def view(spark: SparkSession, name: str) -> DataFrame:
    register(spark, name)
    return spark.table(name)


def cte(*names: str, recursive: bool = False) -> str:
    """``WITH`` prefix defining the named derived views, for oracle SQL."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in _closure(names)]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# information_schema-shaped catalog tables decomposed from cat_new (input of J1); every table of
# the fleet also gets a view over it, which extraction must skip.
VIEWS.update({
    "is_tables": """
SELECT DISTINCT db_id, 'public' AS table_schema, table_name, 'BASE TABLE' AS table_type FROM cat_new
UNION ALL
SELECT DISTINCT db_id, 'public', 'v_' || table_name, 'VIEW' FROM cat_new""",
    "is_columns": """
SELECT db_id, 'public' AS table_schema, table_name, column_name, ordinal AS ordinal_position,
       CASE WHEN enum_name IS NOT NULL THEN 'USER-DEFINED' ELSE col_type END AS data_type,
       coalesce(enum_name, col_type) AS udt_name,
       CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable, col_default AS column_default,
       varchar_len AS character_maximum_length,
       CASE WHEN is_generated THEN 'ALWAYS' ELSE 'NEVER' END AS is_generated,
       CAST(NULL AS STRING) AS identity_generation
FROM cat_new
UNION ALL
SELECT db_id, 'public', 'v_' || table_name, column_name, ordinal, col_type, col_type, 'YES', NULL, NULL, 'NEVER', NULL
FROM cat_new""",
    "is_table_constraints": """
SELECT DISTINCT db_id, 'public' AS table_schema, table_name || '_pkey' AS constraint_name, table_name,
       'PRIMARY KEY' AS constraint_type FROM cat_new WHERE is_primary
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_key', table_name, 'UNIQUE' FROM cat_new WHERE is_unique
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_fkey', table_name, 'FOREIGN KEY'
FROM cat_new WHERE fk_table IS NOT NULL""",
    "is_key_column_usage": """
SELECT db_id, 'public' AS table_schema, table_name || '_pkey' AS constraint_name, table_name, column_name
FROM cat_new WHERE is_primary
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_key', table_name, column_name FROM cat_new WHERE is_unique
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_fkey', table_name, column_name
FROM cat_new WHERE fk_table IS NOT NULL""",
    "is_constraint_column_usage": """
SELECT db_id, 'public' AS table_schema, table_name || '_pkey' AS constraint_name, table_name, column_name
FROM cat_new WHERE is_primary
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_key', table_name, column_name FROM cat_new WHERE is_unique
UNION ALL
SELECT db_id, 'public', table_name || '_' || column_name || '_fkey', fk_table, fk_column
FROM cat_new WHERE fk_table IS NOT NULL""",
})
DEPENDS.update({v: ["cat_new"] for v in ("is_tables", "is_columns", "is_table_constraints", "is_key_column_usage",
                                         "is_constraint_column_usage")})


# the live side of G4: enum renamed in brands ending in 1 (fingerprint-only change), nullability
# flipped in brands ending in 2 (a structural change)
VIEWS["cat_live"] = """
SELECT db_id, table_name, ordinal, column_name, col_type, varchar_len,
       CASE WHEN db_id LIKE '%2' AND col_type = 'boolean' THEN NOT nullable ELSE nullable END AS nullable,
       col_default, is_primary, is_unique, is_generated,
       CASE WHEN db_id LIKE '%1' AND enum_name IS NOT NULL THEN enum_name || '_v2' ELSE enum_name END AS enum_name,
       fk_table, fk_column
FROM cat_new"""
DEPENDS["cat_live"] = ["cat_new"]


# MySQL-shaped information_schema.COLUMNS / KEY_COLUMN_USAGE decomposed from cat_new (input of the MySQL
# variant of J1): enum columns become inline enum(...) types over the database's enum values.
VIEWS.update({
    "my_columns": """
SELECT c.db_id, c.table_name, c.column_name, CAST(c.ordinal AS BIGINT) AS ordinal_position,
       CASE WHEN c.enum_name IS NOT NULL THEN 'enum' WHEN c.col_type = 'varchar(255)' THEN 'varchar'
            ELSE c.col_type END AS data_type,
       CASE WHEN c.enum_name IS NOT NULL THEN 'enum(' || e.vals || ')' ELSE c.col_type END AS column_type,
       CASE WHEN c.nullable THEN 'YES' ELSE 'NO' END AS is_nullable,
       CASE WHEN c.col_default = '0' AND c.is_primary THEN NULL ELSE c.col_default END AS column_default,
       CASE WHEN c.is_primary THEN 'PRI' WHEN c.is_unique THEN 'UNI' ELSE '' END AS column_key,
       CASE WHEN c.is_primary AND c.col_default = '0' THEN 'auto_increment'
            WHEN c.is_generated THEN 'STORED GENERATED' ELSE '' END AS extra,
       CAST(c.varchar_len AS BIGINT) AS character_maximum_length
FROM cat_new c
LEFT JOIN (SELECT db_id, enum_name, string_agg('''' || enum_value || '''', ',') AS vals
           FROM enum_new GROUP BY db_id, enum_name) e
  ON e.db_id = c.db_id AND e.enum_name = c.enum_name""",
    "my_key_column_usage": """
SELECT db_id, table_name, column_name, fk_table AS referenced_table_name, fk_column AS referenced_column_name
FROM cat_new WHERE fk_table IS NOT NULL""",
})
DEPENDS.update({"my_columns": ["cat_new", "enum_new"], "my_key_column_usage": ["cat_new"]})
