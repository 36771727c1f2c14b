"""Constraint checks a database would enforce on restore, run as distributed jobs
(A1, A2, A3, A4, A9, J6).

Files carry no constraints, so before a snapshot is published its tables are
checked explicitly. Every check is an aggregate with map-side partial
aggregation or an anti join whose probe side is pre-aggregated, so a key that
holds a large share of the rows is combined inside each task before any
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A1: data rows per table, tables sorted by name (one job, one scan per table)."""
    frames = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
              for name, df in sorted(tables.items())]
    return _union_all(frames)


def key_violations(df: DataFrame, table: str, primary_key: Iterable[str],
                   unique: Iterable[str] = ()) -> DataFrame:
    """A2: duplicate primary keys (composite), NULLs in the primary key, and duplicate values of
    each UNIQUE column (primary-key columns excluded; NULLs never collide).

    Output: table_name, kind (``pk_duplicate`` / ``pk_null`` / ``unique_duplicate``),
    columns, key_value, dup_count.
    """
    pk = list(primary_key)

    def repeated(kind: str, cols: list[str], rows: DataFrame) -> DataFrame:
        # grouped by the columns in their own types: narrow keys, and the scan reads these columns only
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]
        found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).where("dup_count > 1")
        shown = F.concat_ws("|", *[F.coalesce(F.col(f"k{i}").cast("string"), F.lit("NULL")) for i in range(len(cols))])
        return found.select(F.lit(table).alias("table_name"), F.lit(kind).alias("kind"), F.lit(",".join(cols)).alias("columns"),
                            shown.alias("key_value"), "dup_count")

    frames = []
    if pk:
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
        frames = [repeated("pk_duplicate", pk, df),
                  df.where(any_null).agg(F.count(F.lit(1)).alias("dup_count")).where("dup_count > 0").select(
                      F.lit(table).alias("table_name"), F.lit("pk_null").alias("kind"), F.lit(",".join(pk)).alias("columns"),
                      F.lit(None).cast("string").alias("key_value"), "dup_count")]
    frames += [repeated("unique_duplicate", [c], df.where(F.col(c).isNotNull())) for c in unique if c not in pk]
    if not frames:
        raise ValueError("no key to check")
    return _union_all(frames)


def null_violations(df: DataFrame, table: str, not_null: Iterable[str]) -> DataFrame:
    """A3: NULL count per NOT NULL column, one pass over the table, then unpivoted.

    Callers pass the NOT NULL, non-generated columns (see :func:`not_null_columns`).
    Only columns with at least one NULL are returned.
    """
    cols = list(not_null)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return (counts.unpivot([], cols, "column_name", "null_count")
            .where("null_count > 0")
            .select(F.lit(table).alias("table_name"), "column_name", "null_count"))


def not_null_columns(schema_cols: DataFrame, table: str) -> list[str]:
    """NOT NULL, non-generated columns of one table (reads catalog metadata, not data)."""
    rows = (schema_cols.where((F.col("table_name") == table) & ~F.coalesce("nullable", F.lit(False))
                              & ~F.coalesce("is_generated", F.lit(False)))
            .select("column_name", "ordinal").orderBy("ordinal").collect())
    return [r.column_name for r in rows]


def domain_violations(df: DataFrame, table: str, allowed: Mapping[str, list[str]] | None = None,
                      max_length: Mapping[str, int] | None = None) -> DataFrame:
    """A4: values outside an enum / allowed-value list and strings longer than varchar(n).

    One pass: a conditional count per rule. Output: table_name, column_name,
    rule (``allowed`` / ``max_length``), violations. Allowed lists are part of
    the schema (bounded), applied as literal IN lists.
    """
    aggs, rules = [], []
    for i, (c, vals) in enumerate(sorted((allowed or {}).items())):
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(vals))).alias(f"a{i}"))
        rules.append((f"a{i}", c, "allowed"))
    for i, (c, n) in enumerate(sorted((max_length or {}).items())):
        aggs.append(F.count_if(F.length(F.col(c)) > F.lit(n)).alias(f"m{i}"))
        rules.append((f"m{i}", c, "max_length"))
    counts = df.agg(*aggs)
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rule"),
                                           F.col(a).alias("violations")) for a, c, r in rules])).alias("s")
    return counts.select(stacked).select(F.lit(table).alias("table_name"), "s.column_name", "s.rule", "s.violations")


def fk_violation_rows(child: DataFrame, fk_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """J6 (row level): child rows whose non-null FK value has no parent row."""
    keys = parent.select(F.col(parent_col).alias("_pk")).distinct()
    return child.where(F.col(fk_col).isNotNull()).join(keys, F.col(fk_col) == F.col("_pk"), "left_anti")


def fk_violations(child: DataFrame, child_table: str, fk_col: str, parent: DataFrame, parent_table: str,
                  parent_col: str) -> DataFrame:
    """Per FK value with no parent, the number of child rows holding it.

    The child side is aggregated per FK value first (map-side combine), so the
    anti join shuffles one row per distinct value instead of every child row;
    a value held by a third of the child rows costs one row.
    """
    per_value = (child.where(F.col(fk_col).isNotNull())
                 .groupBy(F.col(fk_col).alias("fk_value")).agg(F.count(F.lit(1)).alias("rows")))
    keys = parent.select(F.col(parent_col).alias("fk_value")).distinct()
    return (per_value.join(keys, "fk_value", "left_anti")
            .select(F.lit(f"{child_table}.{fk_col} -> {parent_table}.{parent_col}").alias("fk"),
                    F.col("fk_value").cast("string").alias("fk_value"), "rows"))


def sequence_resets(tables: Mapping[str, DataFrame], serial_cols: Mapping[str, str]) -> DataFrame:
    """Next sequence value ``coalesce(max(col), 0) + 1`` per serial / auto-increment column."""
    frames = [tables[t].select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"),
                               (F.coalesce(F.max(c).cast("long"), F.lit(0)) + 1).alias("next_value"))
              for t, c in sorted(serial_cols.items())]
    return _union_all(frames)


def serial_columns(schema_cols: DataFrame) -> DataFrame:
    """Columns whose default or type marks them as sequence-backed (serial / nextval / auto_increment)."""
    d, t = F.lower(F.coalesce("col_default", F.lit(""))), F.lower("col_type")
    return schema_cols.where(d.contains("nextval(") | t.contains("serial") | d.contains("auto_increment"))
