"""Schema catalogs as DataFrames.

A catalog is the flat ``schema_columns`` table, one row per column of a table
of a database, for whole fleets of databases at once:

    db_id, table_name, ordinal, column_name, col_type, varchar_len, nullable,
    col_default, is_primary, is_unique, is_generated, enum_name, fk_table, fk_column

and ``schema_enums(db_id, enum_name, enum_value)`` with one row per value.
Foreign keys are single-column, as in the source model. Booleans that are
absent in a document are false; absent strings are null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_COLUMNS = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("col_type", T.StringType()),
    T.StructField("varchar_len", T.IntegerType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("col_default", T.StringType()),
    T.StructField("is_primary", T.BooleanType()),
    T.StructField("is_unique", T.BooleanType()),
    T.StructField("is_generated", T.BooleanType()),
    T.StructField("enum_name", T.StringType()),
    T.StructField("fk_table", T.StringType()),
    T.StructField("fk_column", T.StringType()),
])

SCHEMA_ENUMS = T.StructType([
    T.StructField("db_id", T.StringType()),
    T.StructField("enum_name", T.StringType()),
    T.StructField("enum_value", T.StringType()),
])

_FLAGS = ("nullable", "is_primary", "is_unique", "is_generated")


def normalize(cols: DataFrame) -> DataFrame:
    """Absent flags become false (the lenient reading of the source documents)."""
    out = cols
    for f in _FLAGS:
        if f in out.columns:
            out = out.withColumn(f, F.coalesce(F.col(f), F.lit(False)))
    return out


# ----------------------------------------------------------------------- A8

def _column_struct() -> Column:
    fk = F.when(F.col("fk_table").isNotNull(),
                F.struct(F.col("fk_table").alias("table"), F.coalesce(F.col("fk_column"), F.lit("")).alias("column")))
    return F.struct(
        F.col("column_name").alias("name"),
        F.col("col_type").alias("type"),
        F.coalesce(F.col("nullable"), F.lit(False)).alias("nullable"),
        F.coalesce(F.col("is_primary"), F.lit(False)).alias("isPrimary"),
        F.coalesce(F.col("is_unique"), F.lit(False)).alias("isUnique"),
        F.col("col_default").alias("default"),
        fk.alias("foreignKey"),
        F.col("enum_name").alias("enum"),
    )


_KEEP_NULLS = {"ignoreNullFields": "false"}


def canonical_schema_json(cols: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """Per database the canonical JSON document that feeds the fingerprint.

    Field order and null handling follow the source's canonical form: enums
    and their values sorted, tables and columns sorted by name, eight column
    fields in fixed order, absent booleans false and absent strings null.
    Built in two aggregation levels (columns per table, tables per database)
    so no step holds more than one database's document.
    """
    per_table = (cols.groupBy("db_id", "table_name")
                 .agg(F.sort_array(F.collect_list(_column_struct())).alias("columns"))
                 .select("db_id", "table_name",
                         F.to_json(F.struct(F.col("table_name").alias("name"), "columns"), _KEEP_NULLS)
                         .alias("tj")))
    tables = (per_table.groupBy("db_id")
              .agg(F.sort_array(F.collect_list(F.struct("table_name", "tj"))).alias("ts"))
              .select("db_id", F.concat(F.lit("["), F.array_join(F.col("ts.tj"), ","), F.lit("]")).alias("tables_json")))
    if enums is not None:
        per_enum = (enums.groupBy("db_id", "enum_name")
                    .agg(F.sort_array(F.collect_list("enum_value")).alias("values"))
                    .select("db_id", "enum_name",
                            F.to_json(F.struct(F.col("enum_name").alias("name"), "values"), _KEEP_NULLS).alias("ej")))
        ens = (per_enum.groupBy("db_id")
               .agg(F.sort_array(F.collect_list(F.struct("enum_name", "ej"))).alias("es"))
               .select("db_id", F.concat(F.lit("["), F.array_join(F.col("es.ej"), ","), F.lit("]")).alias("enums_json")))
        tables = tables.join(ens, "db_id", "left")
    else:
        tables = tables.withColumn("enums_json", F.lit(None).cast("string"))
    doc = F.concat(F.lit('{"enums":'), F.coalesce(F.col("enums_json"), F.lit("[]")),
                   F.lit(',"tables":'), F.col("tables_json"), F.lit("}"))
    return tables.select("db_id", doc.alias("canonical_json"))


def schema_fingerprint(cols: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """SHA-256 hex fingerprint and 12-character short id per database."""
    doc = canonical_schema_json(cols, enums)
    fp = F.sha2(F.col("canonical_json"), 256)
    return doc.select("db_id", fp.alias("fingerprint"), F.substring(fp, 1, 12).alias("short_id"),
                      F.length("canonical_json").alias("canonical_len"))


# ----------------------------------------------------------------------- P9

def exclude_tables(cols: DataFrame, names, case_insensitive: bool = True) -> DataFrame:
    """Drop excluded tables. ``names`` is a list of names or a DataFrame with ``table_name``.

    Case-insensitive matching is what the drift path uses; generation uses
    exact names. A DataFrame of names is applied as an anti join (AQE
    broadcasts it when its measured size is small, else sort-merges).
    """
    key = (lambda c: F.lower(c)) if case_insensitive else (lambda c: c)
    if isinstance(names, DataFrame):
        ex = names.select(key(F.col("table_name")).alias("_ex")).distinct()
        return cols.join(ex, key(F.col("table_name")) == F.col("_ex"), "left_anti")
    wanted = [n.lower() if case_insensitive else n for n in names]
    if not wanted:
        return cols
    return cols.where(~key(F.col("table_name")).isin(wanted))


# ----------------------------------------------------------------------- T1 / U1 / U2 / U3

def fk_edges(cols: DataFrame) -> DataFrame:
    """Distinct child -> parent table edges from non-null, non-self, NOT NULL FK columns."""
    return (cols.where(F.col("fk_table").isNotNull() & (F.col("fk_table") != F.col("table_name"))
                       & ~F.coalesce(F.col("nullable"), F.lit(False)))
            .select("db_id", F.col("table_name").alias("child"), F.col("fk_table").alias("parent"))
            .distinct())


def fk_constraint_name(table: Column, column: Column) -> Column:
    return F.concat(table, F.lit("_"), column, F.lit("_fkey"))


def object_inventory(cols: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """Enum, table and FK constraint names of every database, tagged by kind."""
    tables = cols.select("db_id", F.lit("table").alias("kind"), F.col("table_name").alias("name")).distinct()
    fks = (cols.where(F.col("fk_table").isNotNull())
           .select("db_id", F.lit("fk").alias("kind"),
                   fk_constraint_name(F.col("table_name"), F.col("column_name")).alias("name")))
    out = tables.unionByName(fks)
    if enums is not None:
        out = out.unionByName(enums.select("db_id", F.lit("enum").alias("kind"),
                                           F.col("enum_name").alias("name")).distinct())
    return out


def key_universe(a: DataFrame, b: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Sorted distinct union of the keys of two catalogs."""
    keys = list(keys)
    return a.select(*keys).union(b.select(*keys)).distinct().orderBy(*keys)


def column_set_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per table present in both versions, added and removed column names in column order.

    The arrays hold one table's columns, bounded by the table's width.
    """
    o = old.select("db_id", "table_name", "column_name", "ordinal")
    n = new.select("db_id", "table_name", "column_name", "ordinal")
    both = o.select("db_id", "table_name").distinct().join(n.select("db_id", "table_name").distinct(),
                                                           ["db_id", "table_name"])
    added = (n.join(o.select("db_id", "table_name", "column_name"), ["db_id", "table_name", "column_name"], "left_anti")
             .groupBy("db_id", "table_name")
             .agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))).alias("_a")))
    removed = (o.join(n.select("db_id", "table_name", "column_name"), ["db_id", "table_name", "column_name"], "left_anti")
               .groupBy("db_id", "table_name")
               .agg(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))).alias("_r")))
    out = both.join(added, ["db_id", "table_name"], "left").join(removed, ["db_id", "table_name"], "left")
    empty = F.array().cast("array<string>")
    return out.select("db_id", "table_name",
                      F.coalesce(F.col("_a.column_name"), empty).alias("added"),
                      F.coalesce(F.col("_r.column_name"), empty).alias("removed"))


def column_note(added: Column, removed: Column) -> Column:
    """``(cols: +a, -b)`` note of a changed table; empty when nothing changed."""
    parts = F.concat(F.transform(added, lambda c: F.concat(F.lit("+"), c)),
                     F.transform(removed, lambda c: F.concat(F.lit("-"), c)))
    return F.when(F.size(parts) > 0, F.concat(F.lit("(cols: "), F.array_join(parts, ", "), F.lit(")"))).otherwise(F.lit(""))


# ----------------------------------------------------------------------- J5

def missing_objects(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Objects to create (wanted minus existing) and tables to truncate (in both).

    Inputs are :func:`object_inventory` frames. An FK is created only when
    its parent table is known in the wanted or existing catalog; that check
    is done by the caller passing ``wanted`` FK rows with ``parent`` resolved
    (column ``parent_known``), otherwise every wanted FK counts.
    """
    key = ["db_id", "kind", "name"]
    create = wanted.join(existing.select(*key), key, "left_anti")
    if "parent_known" in create.columns:
        create = create.where((F.col("kind") != "fk") | F.col("parent_known"))
    create = create.select(*key, F.lit("create").alias("action"))
    truncate = (existing.where(F.col("kind") == "table").select(*key)
                .join(wanted.where(F.col("kind") == "table").select(*key), key, "left_semi")
                .select(*key, F.lit("truncate").alias("action")))
    return create.unionByName(truncate)


def fk_inventory_with_parents(cols: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """FK constraint rows of ``cols`` with ``parent_known``: parent table in ``cols`` or ``other``."""
    tables = cols.select("db_id", F.col("table_name").alias("_pt"))
    if other is not None:
        tables = tables.union(other.select("db_id", F.col("table_name").alias("_pt")))
    tables = tables.distinct()
    fks = (cols.where(F.col("fk_table").isNotNull())
           .select("db_id", F.lit("fk").alias("kind"),
                   fk_constraint_name(F.col("table_name"), F.col("column_name")).alias("name"), "fk_table"))
    return (fks.join(tables, (fks.db_id == tables.db_id) & (fks.fk_table == tables._pt), "left")
            .select(fks.db_id, "kind", "name", F.col("_pt").isNotNull().alias("parent_known")))


# ----------------------------------------------------------------------- P10

# Catalog type (lower-cased, exact match) -> MySQL DDL type, in rule order. Varchar /
# char lengths, ``timestamp*`` (substring match) and the upper-cased fallback are handled in code.
MYSQL_DDL_TYPES = [
    (("text", "longtext", "mediumtext", "tinytext"), None),  # the type itself, upper-cased
    (("integer", "int4"), "INT"),
    (("bigint", "int8"), "BIGINT"),
    (("smallint", "int2"), "SMALLINT"),
    (("boolean", "bool"), "TINYINT(1)"),
    (("numeric", "decimal"), "DECIMAL(18,6)"),
    (("real", "float4"), "FLOAT"),
    (("double precision", "float8"), "DOUBLE"),
]
MYSQL_DDL_AFTER_TIMESTAMP = [
    (("date",), "DATE"),
    (("time",), "TIME"),
    (("json", "jsonb"), "JSON"),
    (("uuid",), "CHAR(36)"),
    (("bytea",), "BLOB"),
]


def mysql_column_ddl_type(col_type: Column, varchar_len: Column, enum_values: Column | None = None) -> Column:
    """P10: catalog type -> MySQL DDL type (``MYSQL_DDL_TYPES``), enum fixed to print its values.

    ``enum_values`` (array<string>) renders ``ENUM('a',...)`` for enum columns
    (trap Q28: the source printed the enum's name).
    """
    t = F.lower(col_type)
    varchar = t.isin("varchar", "character varying")
    expr = (F.when(varchar & varchar_len.isNotNull(), F.format_string("VARCHAR(%s)", varchar_len.cast("string")))
            .when(varchar, F.lit("VARCHAR(255)"))
            .when((t == "char") & varchar_len.isNotNull(), F.format_string("CHAR(%s)", varchar_len.cast("string"))))
    for names, ddl in MYSQL_DDL_TYPES:
        expr = expr.when(t.isin(*names), F.upper(t) if ddl is None else F.lit(ddl))
    expr = expr.when(t.contains("timestamp"), F.lit("DATETIME(6)"))
    for names, ddl in MYSQL_DDL_AFTER_TIMESTAMP:
        expr = expr.when(t.isin(*names), F.lit(ddl))
    expr = expr.otherwise(F.upper(col_type))
    if enum_values is not None:
        enum_ddl = F.concat(F.lit("ENUM("),
                            F.array_join(F.transform(enum_values, lambda v: F.concat(
                                F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))), ","),
                            F.lit(")"))
        expr = F.when((col_type == "enum") & enum_values.isNotNull(), enum_ddl).otherwise(expr)
    return expr


def spark_type_name(col_type: Column) -> Column:
    """Catalog type -> Spark SQL type name used when a snapshot is typed (§1.2 families)."""
    t = F.lower(col_type)
    return (F.when(t.isin("json", "jsonb"), F.lit("string"))
            .when(t.startswith("array") | t.endswith("[]"), F.lit("string"))
            .when(t.contains("time") | t.contains("date"),
                  F.when(t == "date", F.lit("date")).otherwise(F.lit("timestamp")))
            .when(t.isin("boolean", "bool"), F.lit("boolean"))
            .when(t.contains("int") | t.contains("serial"), F.lit("bigint"))
            .when(t.contains("float") | t.contains("numeric") | t.contains("decimal")
                  | t.contains("double") | (t == "real"), F.lit("double"))
            .otherwise(F.lit("string")))


def map_column_types(cols: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """P10 over a catalog: MySQL DDL type and Spark type per column."""
    out = cols
    ev = None
    if enums is not None:
        vals = (enums.groupBy("db_id", "enum_name")
                .agg(F.sort_array(F.collect_list("enum_value")).alias("_enum_values")))
        out = out.join(vals, ["db_id", "enum_name"], "left")
        ev = F.col("_enum_values")
    return out.select("db_id", "table_name", "column_name", "col_type",
                      mysql_column_ddl_type(F.col("col_type"), F.col("varchar_len"), ev).alias("mysql_type"),
                      spark_type_name(F.col("col_type")).alias("spark_type"))


# ----------------------------------------------------------------------- P13

# Default-expression keywords of the fill-strategy rule.
UUID_DEFAULT_FUNCTIONS = ("gen_random_uuid", "uuid_generate")
DYNAMIC_DEFAULT_KEYWORDS = ("current_timestamp", "current_date", "current_time", "localtime", "localtimestamp", "now")


def default_strategy(col_default: Column, col_type: Column) -> Column:
    """Default expression -> ``uuid`` / ``timestamp`` / ``default``.

    A trailing ``::cast`` is stripped; uuid generators give ``uuid``; any
    function call or a bare now/current_* keyword is dynamic and gives
    ``timestamp`` only on time/date columns.
    """
    from tessera.functions.parse import strip_ws

    s = F.lower(strip_ws(F.regexp_replace(col_default, r"::[^:]*$", "")))
    ct = F.lower(col_type)
    dynamic = s.contains("(") | s.isin(*DYNAMIC_DEFAULT_KEYWORDS)
    is_uuid = F.lit(False)
    for fn in UUID_DEFAULT_FUNCTIONS:
        is_uuid = is_uuid | s.contains(fn)
    return (F.when(is_uuid, F.lit("uuid"))
            .when(dynamic & (ct.contains("time") | ct.contains("date")), F.lit("timestamp"))
            .otherwise(F.lit("default")))


def classify_defaults(cols: DataFrame) -> DataFrame:
    return (cols.where(F.col("col_default").isNotNull())
            .select("db_id", "table_name", "column_name", "col_type", "col_default",
                    default_strategy(F.col("col_default"), F.col("col_type")).alias("strategy")))


# ----------------------------------------------------------------------- J1

def assemble_schema(tables: DataFrame, columns: DataFrame, table_constraints: DataFrame,
                    key_column_usage: DataFrame, constraint_column_usage: DataFrame,
                    enum_types: DataFrame | None = None, check_constraints: DataFrame | None = None,
                    schema: str = "public") -> DataFrame:
    """information_schema-shaped catalog tables of many databases -> ``schema_columns``.

    Inputs carry ``db_id``; their columns follow information_schema names
    (``table_type``, ``ordinal_position``, ``data_type``, ``udt_name``,
    ``is_nullable``, ``column_default``, ``character_maximum_length``,
    ``is_generated``, ``identity_generation``, ``constraint_type`` ...).
    Base tables only (trap Q24 fixed: views are not extracted). Columns whose
    ``udt_name`` names an enum become type ``enum``. Composite constraints are
    deduplicated to one row per column (trap Q9): an FK that fans out keeps its
    smallest target. ``check_constraints(db_id, table_name, column_name,
    check_clause)`` fills ``allowed_values`` (P11). All joins are on
    (db, table[, column]) keys; constraint sides are aggregated per column first.
    """
    from tessera.functions.parse import allowed_values

    t = tables.where((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")) \
              .select("db_id", "table_name")
    c = columns.where(F.col("table_schema") == schema).join(t, ["db_id", "table_name"], "left_semi")
    tc = table_constraints.where(F.col("table_schema") == schema).select(
        "db_id", "constraint_name", "table_name", "constraint_type")
    kcu = key_column_usage.where(F.col("table_schema") == schema).select(
        "db_id", "constraint_name", "table_name", "column_name")
    ccu = constraint_column_usage.where(F.col("table_schema") == schema).select(
        "db_id", "constraint_name", F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))

    fk = (tc.where(F.col("constraint_type") == "FOREIGN KEY").join(kcu, ["db_id", "constraint_name", "table_name"])
          .join(ccu, ["db_id", "constraint_name"])
          .groupBy("db_id", "table_name", "column_name")
          .agg(F.min(F.struct("ref_table", "ref_column")).alias("_fk")))

    def flagged(kind, name):
        return (tc.where(F.col("constraint_type") == kind)
                .join(ccu.withColumnRenamed("ref_table", "table_name").withColumnRenamed("ref_column", "column_name"),
                      ["db_id", "constraint_name", "table_name"])
                .select("db_id", "table_name", "column_name").distinct().withColumn(name, F.lit(True)))

    out = (c.join(fk, ["db_id", "table_name", "column_name"], "left")
           .join(flagged("PRIMARY KEY", "_pk"), ["db_id", "table_name", "column_name"], "left")
           .join(flagged("UNIQUE", "_uq"), ["db_id", "table_name", "column_name"], "left"))
    enum_col = F.lit(None).cast("string")
    if enum_types is not None:
        names = enum_types.select("db_id", F.col("enum_name").alias("udt_name")).distinct() \
                          .withColumn("_is_enum", F.lit(True))
        out = out.join(names, ["db_id", "udt_name"], "left")
        enum_col = F.when(F.col("_is_enum"), F.col("udt_name"))
    dt = F.col("data_type")
    res = out.select(
        "db_id", "table_name", F.col("ordinal_position").cast("long").alias("ordinal"), "column_name",
        F.when(enum_col.isNotNull(), F.lit("enum")).otherwise(dt).alias("col_type"),
        F.when(dt.isin("character varying", "varchar"), F.col("character_maximum_length").cast("int")).alias("varchar_len"),
        (F.col("is_nullable") == "YES").alias("nullable"), F.col("column_default").alias("col_default"),
        F.coalesce(F.col("_pk"), F.lit(False)).alias("is_primary"),
        F.coalesce(F.col("_uq"), F.lit(False)).alias("is_unique"),
        ((F.coalesce(F.col("is_generated"), F.lit("NEVER")) == "ALWAYS")
         | F.col("identity_generation").isNotNull()).alias("is_generated"),
        enum_col.alias("enum_name"), F.col("_fk.ref_table").alias("fk_table"), F.col("_fk.ref_column").alias("fk_column"))
    if check_constraints is not None:
        av = (check_constraints.select("db_id", "table_name", "column_name",
                                       allowed_values(F.col("check_clause")).alias("allowed_values"))
              .where(F.col("allowed_values").isNotNull())
              .groupBy("db_id", "table_name", "column_name").agg(F.first("allowed_values").alias("allowed_values")))
        res = res.join(av, ["db_id", "table_name", "column_name"], "left")
    return res


# ----------------------------------------------------------------------- P10 (table DDL)

def _quote(c: Column, q: str) -> Column:
    return F.concat(F.lit(q), F.replace(c, F.lit(q), F.lit(q + q)), F.lit(q))


def create_table_ddl(cols: DataFrame, dialect: str = "postgres", enums: DataFrame | None = None) -> DataFrame:
    """P10: one ``CREATE TABLE`` statement per (db, table) from a catalog.

    Columns in ordinal order: a ``nextval(`` default becomes SERIAL / BIGSERIAL / SMALLSERIAL
    (PostgreSQL), an ``AUTO_INCREMENT`` default INT / BIGINT / SMALLINT AUTO_INCREMENT (MySQL);
    other columns get their type (PostgreSQL: enum name, ``text[]`` for ARRAY, varchar(n);
    MySQL: :func:`mysql_column_ddl_type`), ``NOT NULL`` and ``DEFAULT``. Then ``PRIMARY KEY`` over
    the key columns and one ``UNIQUE`` per unique non-key column. One table's column list is
    collected (bounded by the table's width).
    """
    pg = dialect == "postgres"
    q = '"' if pg else "`"
    t = F.lower(F.col("col_type"))
    d = F.coalesce(F.col("col_default"), F.lit(""))
    not_null = F.when(~F.coalesce(F.col("nullable"), F.lit(False)), F.lit(" NOT NULL")).otherwise(F.lit(""))
    default = F.when(d != "", F.concat(F.lit(" DEFAULT "), d)).otherwise(F.lit(""))
    src = cols
    if pg:
        auto = F.lower(d).contains("nextval(")
        auto_type = (F.when(t == "bigint", "BIGSERIAL").when(t == "smallint", "SMALLSERIAL").otherwise("SERIAL"))
        plain = (F.when((F.col("col_type") == "enum") & F.col("enum_name").isNotNull(), _quote(F.col("enum_name"), q))
                 .when(F.col("col_type").startswith("ARRAY"), F.lit("text[]"))
                 .when(F.col("col_type").isin("character varying", "varchar") & F.col("varchar_len").isNotNull(),
                       F.format_string("varchar(%s)", F.col("varchar_len").cast("string")))
                 .otherwise(F.col("col_type")))
        col_def = F.when(auto, F.concat(auto_type, not_null)).otherwise(F.concat(plain, not_null, default))
    else:
        ev = None
        if enums is not None:
            vals = (enums.groupBy("db_id", "enum_name")
                    .agg(F.sort_array(F.collect_list("enum_value")).alias("_enum_values")))
            src = src.join(vals, ["db_id", "enum_name"], "left")
            ev = F.col("_enum_values")
        auto = F.upper(F.trim(d)) == "AUTO_INCREMENT"
        auto_type = F.when(t == "bigint", "BIGINT").when(t.isin("smallint", "tinyint"), "SMALLINT").otherwise("INT")
        col_def = (F.when(auto, F.concat(auto_type, F.lit(" AUTO_INCREMENT"), not_null))
                   .otherwise(F.concat(mysql_column_ddl_type(F.col("col_type"), F.col("varchar_len"), ev),
                                       not_null, default)))
    name = _quote(F.col("column_name"), q)
    per_col = F.struct(F.col("ordinal"), F.concat(name, F.lit(" "), col_def).alias("def"),
                       F.when(F.coalesce(F.col("is_primary"), F.lit(False)), name).alias("pk"),
                       F.when(F.coalesce(F.col("is_unique"), F.lit(False)) & ~F.coalesce(F.col("is_primary"), F.lit(False)),
                              F.concat(F.lit("UNIQUE ("), name, F.lit(")"))).alias("uq"))
    grouped = src.groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list(per_col)).alias("_c"))
    pks = F.filter(F.col("_c.pk"), lambda x: x.isNotNull())
    parts = F.concat(F.col("_c.def"),
                     F.when(F.size(pks) > 0, F.array(F.concat(F.lit("PRIMARY KEY ("), F.array_join(pks, ", "),
                                                              F.lit(")")))).otherwise(F.array().cast("array<string>")),
                     F.filter(F.col("_c.uq"), lambda x: x.isNotNull()))
    tail = F.lit("\n)") if pg else F.lit("\n) ENGINE=InnoDB DEFAULT CHARSET=utf8mb4")
    ddl = F.concat(F.lit("CREATE TABLE "), _quote(F.col("table_name"), q), F.lit(" (\n  "),
                   F.array_join(parts, ",\n  "), tail)
    return grouped.select("db_id", "table_name", ddl.alias("ddl"))


def assemble_schema_mysql(columns: DataFrame, key_column_usage: DataFrame,
                          tables: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """J1, MySQL catalog shape -> (``schema_columns``, ``schema_enums``).

    ``columns`` follow information_schema.COLUMNS (``data_type``, ``column_type``, ``is_nullable``,
    ``column_default``, ``column_key``, ``extra``, ``character_maximum_length``,
    ``ordinal_position``); ``key_column_usage`` rows with a ``referenced_table_name`` are the FKs
    (one kept per column, trap Q9). ``column_key`` PRI / UNI give the key flags; ``extra``
    auto_increment stores the ``AUTO_INCREMENT`` default sentinel and virtual / stored generated
    marks generated columns; an inline ``enum('a',...)`` becomes the synthetic enum
    ``<table>_<column>`` with its values (P12). With ``tables`` (``table_type``), only base
    tables are extracted (trap Q24 fixed).
    """
    from tessera.functions.parse import enum_values, synthetic_enum_name

    c = columns
    if tables is not None:
        c = c.join(tables.where(F.col("table_type") == "BASE TABLE").select("db_id", "table_name"),
                   ["db_id", "table_name"], "left_semi")
    fk = (key_column_usage.where(F.col("referenced_table_name").isNotNull())
          .groupBy("db_id", "table_name", "column_name")
          .agg(F.min(F.struct(F.col("referenced_table_name").alias("t"),
                              F.col("referenced_column_name").alias("c"))).alias("_fk")))
    c = c.join(fk, ["db_id", "table_name", "column_name"], "left")
    extra = F.lower(F.coalesce(F.col("extra"), F.lit("")))
    dt = F.col("data_type")
    is_enum = dt == "enum"
    enum_name = F.when(is_enum, synthetic_enum_name(F.col("table_name"), F.col("column_name")))
    cols = c.select(
        "db_id", "table_name", F.col("ordinal_position").cast("long").alias("ordinal"), "column_name",
        F.when(is_enum, F.lit("enum")).otherwise(dt).alias("col_type"),
        F.when(dt.isin("varchar", "char"), F.col("character_maximum_length").cast("int")).alias("varchar_len"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        F.when(extra.contains("auto_increment"), F.lit("AUTO_INCREMENT")).otherwise(F.col("column_default"))
        .alias("col_default"),
        (F.col("column_key") == "PRI").alias("is_primary"), (F.col("column_key") == "UNI").alias("is_unique"),
        (extra.contains("virtual generated") | extra.contains("stored generated")).alias("is_generated"),
        enum_name.alias("enum_name"), F.col("_fk.t").alias("fk_table"), F.col("_fk.c").alias("fk_column"))
    enums = (c.where(is_enum)
             .select("db_id", enum_name.alias("enum_name"),
                     F.explode_outer(F.coalesce(enum_values(F.col("column_type")), F.array().cast("array<string>")))
                     .alias("enum_value"))
             .where(F.col("enum_value").isNotNull()))
    return cols, enums
