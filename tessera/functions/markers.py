"""Per-environment marker substitution (P7) and its audit.

A cell that is wholly ``@env:KEY`` (KEY in ``[A-Z0-9_]``) is replaced by the
environment's value for KEY, else by the process fallback, else the job fails
listing every missing (key, env, column). The header is never touched and the
source table is never modified (a new DataFrame is returned). ``\\z`` anchors
the end so a trailing newline does not match (trap Q5).

Environment values are secrets as often as not, so they never stand in a plan: they enter as
one row of a small local table, read by a scalar subquery. The process environment is asked only for
keys that a marker can name and that occur in the table.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage, scratch_path

MARKER_RE = r"^@env:([A-Z0-9_]+)\z"
_KEY = re.compile("[A-Z0-9_]+")


def is_marker(c: Column) -> Column:
    return F.coalesce(c.rlike(MARKER_RE), F.lit(False))


def marker_key(c: Column) -> Column:
    return F.regexp_extract(c, MARKER_RE, 1)


def _values_map(values: Mapping[str, str]) -> Column:
    """A map literal: for streams, whose plans take no subquery."""
    if not values:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))])


def values_column(spark: SparkSession, values: Mapping[str, str]) -> Column:
    """The values as one map, read from a local table: no key or value stands in the plan."""
    return spark.createDataFrame([(dict(values),)], "known map<string,string>").scalar()


def effective_values(values: Mapping[str, str], use_process_env: bool = True) -> dict[str, str]:
    """Environment values plus process fallbacks for keys that a marker can name: an empty configured value counts as
    set, an empty process variable as missing (trap Q17)."""
    if not use_process_env:
        return dict(values)
    return {k: v for k, v in os.environ.items() if v and _KEY.fullmatch(k)} | dict(values)


def marker_keys(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Distinct (column_name, key) of every marker cell, one aggregate pass."""
    cols = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, key string")
    stacked = F.explode(F.array(*[F.when(is_marker(F.col(c)), F.struct(F.lit(c).alias("column_name"),
                                                                         marker_key(F.col(c)).alias("key")))
                                  for c in cols])).alias("m")
    return df.select(stacked).where("m IS NOT NULL").select("m.column_name", "m.key").distinct()


def resolve_markers(df: DataFrame, values: Mapping[str, str], env: str = "", table: str = "",
                    columns: Iterable[str] | None = None, check_missing: bool = True,
                    use_process_env: bool = True) -> DataFrame:
    """Replace marker cells with environment values.

    Missing keys are found first with one distinct aggregate over the marker
    cells (the marker fast path: a table without markers is returned as is);
    when any is missing the job fails. All of them are written to a table that
    the error names, with its first ones; no key found in the data is collected.
    """
    cols = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string"]
    spark, known = df.sparkSession, effective_values(values, use_process_env)
    if check_missing or use_process_env:
        keys = cut_lineage(marker_keys(df, cols))  # the one pass over the cells before the replacement
        if keys.isEmpty():
            return df
        names = spark.createDataFrame([(k,) for k in known], "name string")
        if check_missing:
            missing = keys.join(names, F.col("key") == F.col("name"), "left_anti")
            first = missing.orderBy("key", "column_name").limit(20).collect()
            if first:
                path = scratch_path(spark, "missing-markers")
                missing.write.parquet(path)
                raise ValueError(missing_text([(r.key, r.column_name) for r in first], env, table, path))
        used = keys.join(names, F.col("key") == F.col("name"), "left_semi").select("key").distinct().collect()  # known keys at most
        known = {r.key: known[r.key] for r in used}
    m = values_column(spark, known)
    out = []
    for c in df.columns:
        if c in cols:
            col = F.col(c)
            out.append(F.when(is_marker(col), F.element_at(m, marker_key(col))).otherwise(col).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def missing_text(first: list[tuple[str, str]], env: str, table: str, path: str) -> str:
    """The error for markers without a value: the first of them, and where all are listed."""
    listing = "; ".join(f"key {key} (env {env or '-'}, table {table or '-'}, column {column})" for key, column in first)
    return f"missing environment values for markers: {listing}; all of them in {path}"


def marker_audit(df: DataFrame, key_cols: list[str], values: Mapping[str, str], table: str = "",
                 columns: Iterable[str] | None = None) -> DataFrame:
    """One row per replaced cell: table_name, row key, column_name, key, value.

    The row is identified by the snapshot's key columns rather than a file
    position, which has no meaning on a distributed store.
    """
    cols = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string" and c not in key_cols]
    m = values_column(df.sparkSession, values)
    stacked = F.explode(F.array(*[F.when(is_marker(F.col(c)), F.struct(F.lit(c).alias("column_name"),
                                                                         marker_key(F.col(c)).alias("key")))
                                  for c in cols])).alias("m")
    return (df.select(*key_cols, stacked).where("m IS NOT NULL")
            .select(F.lit(table).alias("table_name"), *key_cols, "m.column_name", "m.key",
                    F.element_at(m, F.col("m.key")).alias("value")))


def has_any_marker(df: DataFrame, columns: Iterable[str] | None = None) -> bool:
    """True when any cell of the table is a marker (stops at the first hit)."""
    cols = [c for c in (columns or df.columns) if dict(df.dtypes)[c] == "string"]
    if not cols:
        return False
    cond = None
    for c in cols:
        cond = is_marker(F.col(c)) if cond is None else (cond | is_marker(F.col(c)))
    return df.where(cond).limit(1).count() > 0
