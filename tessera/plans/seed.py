"""Restore a revision into one or more targets (S8): resolve -> guard -> write and check -> validate -> publish,
all-or-nothing per target.

Per target: the revision's schema fingerprint must equal the target's (when the target's is known). Then one pass a
table resolves ``@env:`` markers with the target's environment values, types CSV cells with the catalog's
column types, writes the good rows to a new version folder and counts the others: rows with a wrong number of cells,
markers without a value, cells that their type can't hold. Any such row fails the target; only then a second pass lists
all of them in a folder that the error names. Optional checks (key, null, FK violations) run on the tables just written, and any
violation fails the target. The target's pointer is flipped last, once (trap Q16 fixed: no target ever
holds a half-restored table set). Targets run in order and the first failure stops the rest unless
``continue_on_error``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.coerce import coerce_table
from tessera.functions.markers import effective_values, is_marker, marker_key, missing_text, values_column
from tessera.sources import store


def _fail_on_rows(bad: DataFrame, target: str, what: str) -> None:
    """Raise when ``bad`` has rows, after writing all of them beside the target."""
    if bad.isEmpty():
        return
    path = f"{target.rstrip('/')}-problems/{uuid.uuid4().hex[:12]}"
    bad.write.parquet(path)
    raise ValueError(f"{what}: {bad.sparkSession.read.parquet(path).count()} listed in {path}")


_PROBLEM = "struct<kind:string,column_name:string,raw:string>"


def _checked(df: DataFrame, values: Mapping[str, str], types: Mapping[str, str] | None, dialect: str) -> DataFrame:
    """The restored columns, and in ``_problems`` what is wrong with the row."""
    def problem(kind: str, column: str | None, raw: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column_name"), raw.alias("raw")).cast(_PROBLEM)

    columns = df.dtypes
    df = df.withColumn("_known", values_column(df.sparkSession, effective_values(values)))  # a subquery can't stand inside a lambda
    known, cols, found = F.col("_known"), [], []
    for name, kind in columns:
        c = F.col(f"`{name}`")
        if name == store.CORRUPT:
            found.append(F.when(c.isNotNull(), problem("ragged", None, c)))
            continue
        if kind == "string":
            value = F.element_at(known, marker_key(c))
            found.append(F.when(is_marker(c) & value.isNull(), problem("marker", name, c)))
            c = F.when(is_marker(c), value).otherwise(c)
        cols.append(c.alias(name))
    problems = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast(f"array<{_PROBLEM}>")
    out = df.select(*cols, problems.alias(store.PROBLEMS))
    if types is None:
        return out
    typed = coerce_table(out, types, dialect)
    rejects = F.transform("_rejects", lambda r: problem("cell", None, r["raw"]).withField("column_name", r["column_name"]))
    return typed.withColumn(store.PROBLEMS, F.concat(store.PROBLEMS, rejects)).drop("_rejects")


def _problem_text(table: str, checked: DataFrame, target: str) -> str:
    """The error for a table with bad rows, after writing all problems beside the target."""
    path = f"{target.rstrip('/')}-problems/{uuid.uuid4().hex[:12]}"
    listed = checked.select(F.explode(store.PROBLEMS).alias("p")).select(F.lit(table).alias("table_name"), "p.*")
    listed.write.partitionBy("kind").parquet(path)
    written = checked.sparkSession.read.parquet(path)
    kinds = {r.kind: r["count"] for r in written.groupBy("kind").count().collect()}
    if "ragged" in kinds:
        return f"table {table}: rows with a wrong number of cells: {kinds['ragged']} listed in {path}"
    if "marker" in kinds:
        first = written.where("kind = 'marker'").select(marker_key(F.col("raw")).alias("key"), "column_name").distinct().orderBy("key", "column_name").limit(20)
        return missing_text([tuple(r) for r in first.collect()], target, table, path)
    return f"table {table}: cells that their type can't hold: {kinds['cell']} listed in {path}"


Check = Callable[[Mapping[str, DataFrame]], DataFrame]


def restore_snapshot(spark: SparkSession, root: str, scenario: str, targets: list[str],
                     revision: str | None = None,
                     env_values: Mapping[str, Mapping[str, str]] | None = None,
                     target_fingerprints: Mapping[str, str] | None = None,
                     types: Mapping[str, Mapping[str, str]] | None = None, dialect: str = "postgres",
                     checks: list[Check] | None = None, continue_on_error: bool = False) -> DataFrame:
    """Returns one status row per target: target, status (ok / failed / skipped), revision,
    tables, rows, error."""
    rev, manifest = store.resolve(spark, root, scenario, revision)
    source_tables = store.read_revision(spark, root, scenario, rev)
    results, stop = [], False
    for target in targets:
        if stop:
            results.append((target, "skipped", rev, 0, 0, "previous target failed"))
            continue
        try:
            live = (target_fingerprints or {}).get(target)
            stored = manifest.get("schemaFingerprint") or ""
            if live and live != stored:
                raise ValueError(f"schema mismatch: revision {stored or 'without fingerprint'} vs target {live}")
            typed = manifest.get("format") == "csv"
            prepared = {name: _checked(df, (env_values or {}).get(target, {}), (types or {}).get(name) if typed else None, dialect)
                        for name, df in source_tables.items()}

            def verify(tables: Mapping[str, DataFrame], place: str = target) -> None:
                for check in checks or []:
                    _fail_on_rows(check(tables), place, "validation failed")

            try:
                _, counts = store.publish_tables(spark, target, prepared, verify)
            except store.BadRows as bad:
                raise ValueError(_problem_text(bad.table, prepared[bad.table], target)) from bad
            results.append((target, "ok", rev, len(counts), sum(counts.values()), ""))
        except Exception as e:  # noqa: BLE001 - reported per target
            results.append((target, "failed", rev, 0, 0, str(e)))
            stop = not continue_on_error
    return spark.createDataFrame(results, "target string, status string, revision string, tables int, rows long, "
                                          "error string")
