"""Deterministic data generation and refresh.

G1 builds rows from an index ``i`` (``spark.range``) with column expressions
only: cycled value pools, formatted strings, timestamps stepping by an
interval, index-derived UUID literals and foreign keys that hit existing
parents. Parents are indexed once (hot-group-safe ordered index) and each
child picks index ``pmod(i * multiplier, n_parents)``; the pick is an
equi-join on that index, so no parent key list is collected or broadcast
beyond what the join planner decides from measured sizes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sequence import ordered_index

PICK_MULTIPLIER = 2654435761  # Knuth multiplicative hash constant, spreads consecutive i over parents


@dataclass
class ColumnSpec:
    name: str
    kind: str  # pool | skewed | format | timestamp | uuid | ref | expr
    values: Sequence = field(default_factory=list)
    weights: Sequence[float] = field(default_factory=list)
    fmt: str = ""
    start: str = "2024-01-01 00:00:00"
    step_seconds: int = 60
    parent: DataFrame | None = None
    parent_key: str = ""
    expr: str = ""


def uuid_from_index(i: Column, salt: int = 0) -> Column:
    """A UUID-shaped literal derived from the index (stable across runs)."""
    j = i + F.lit(salt)
    bits = lambda c, shift, n: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    return F.format_string("%08x-%04x-4%03x-8%03x-%012x", bits(j, 0, 32), bits(j, 32, 16), bits(j, 48, 12), bits(i, 48, 12), bits(i, 0, 48))


def _expr(spec: ColumnSpec, i: Column) -> Column:
    if spec.kind == "pool":
        arr = F.array(*[F.lit(v) for v in spec.values])
        return F.element_at(arr, ((i - 1) % F.lit(len(spec.values)) + 1).cast("int"))
    if spec.kind == "skewed":
        # weighted pick: a hash of i mapped to [0, 1) against the cumulative weights (pool-sized)
        total = float(sum(spec.weights))
        cum, acc = [], 0.0
        for w in spec.weights:
            acc += w / total
            cum.append(acc)
        u = F.pmod(F.xxhash64(i, F.lit(spec.name)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        idx = F.size(F.filter(F.array(*[F.lit(c) for c in cum[:-1]]), lambda c: c <= u)) + 1
        return F.element_at(F.array(*[F.lit(v) for v in spec.values]), idx)
    if spec.kind == "format":
        return F.format_string(spec.fmt, i)
    if spec.kind == "timestamp":
        return F.timestamp_seconds(F.unix_timestamp(F.lit(spec.start)) + (i - 1) * F.lit(spec.step_seconds))
    if spec.kind == "uuid":
        return uuid_from_index(i)
    if spec.kind == "expr":
        return F.expr(spec.expr)
    raise ValueError(f"unknown column kind {spec.kind}")


def generate_rows(spark: SparkSession, n: int, columns: Sequence[ColumnSpec], partitions: int | None = None) -> DataFrame:
    """G1: ``n`` deterministic rows (``i`` = 1..n) with the given column specs."""
    base = spark.range(1, n + 1, numPartitions=partitions).withColumnRenamed("id", "i")
    out = base.select("i", *[_expr(c, F.col("i")).alias(c.name) for c in columns if c.kind != "ref"])
    for c in columns:
        if c.kind != "ref":
            continue
        keys = c.parent.select(F.col(c.parent_key).alias("_pk")).distinct()
        indexed = ordered_index(keys.withColumn("_g", F.lit(0)), ["_g"], ["_pk"], name="_pidx").drop("_g")
        n_parents = indexed.count()
        if n_parents == 0:
            out = out.withColumn(c.name, F.lit(None).cast(c.parent.schema[c.parent_key].dataType))
            continue
        # both factors reduced first: the product stays below 2^63 for up to 3e9 parents, any i
        pick = F.pmod(F.pmod(F.col("i"), F.lit(n_parents)) * F.lit(PICK_MULTIPLIER % n_parents), F.lit(n_parents))
        out = (out.withColumn("_pidx", pick).join(indexed, "_pidx", "left")
               .withColumnRenamed("_pk", c.name).drop("_pidx"))
    return out


def derive_revision(spark: SparkSession, base: Mapping[str, DataFrame], statements: Mapping[str, str],
                    populated: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Base tables under their names; each statement (a SELECT) defines the full new content of its
    table. Every populated base table must be redefined (the script contract as a plan check);
    a missing one or a failing statement raises before anything is written. Tables not
    redefined and empty are carried over unchanged."""
    # the names are bound inside each statement, so the session's own views stay as they are
    views = {name: f"base_{uuid.uuid4().hex[:12]}" for name in base}
    for name, df in base.items():
        df.createOrReplaceTempView(views[name])
    bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    required = list(populated) if populated is not None else list(base)
    missing = sorted(t for t in required if t not in statements)
    if missing:
        raise ValueError(f"statements do not redefine populated tables: {', '.join(missing)}")
    def run(sql: str) -> DataFrame:
        if not views:
            return spark.sql(sql)
        own = re.match(r"\s*with\s+(?!recursive\b)", sql, re.I)
        return spark.sql(f"WITH {bound}, {sql[own.end():]}" if own else f"WITH {bound} {sql}")

    out = {name: run(sql) for name, sql in statements.items()}
    for name, df in out.items():
        df.schema  # analysis errors surface here, before any write  # noqa: B018
    for view in views.values():
        spark.catalog.dropTempView(view)  # the analysed statements hold their inputs
    for name, df in base.items():
        out.setdefault(name, df)
    return out


def apply_refresh_plan(tables: Mapping[str, DataFrame], plan: Sequence[Mapping], key_cols: Mapping[str, list[str]]
                       | None = None, now: str = "2024-01-01 00:00:00") -> dict[str, DataFrame]:
    """Execute drift suggestions on table data.

    ``plan`` rows (from J4 for one database, collected: schema-sized, with the
    new columns' types and defaults from :func:`typed_plan`) carry table_name,
    column_name, category, op, op_strategy, op_value, ``spark_type`` and
    ``col_default``. Supported: drop_column, rename_column (from ``op_value``),
    add_column (constant / default / timestamp / uuid, in the column's type; an
    empty constant is null but for text), and type widening (``widen``). A
    default that isn't a literal can't be evaluated here and raises. A
    change without an operation in category decision or breaking raises,
    listing them. UUID fills derive from the row key so re-runs give the same
    values.
    """
    unresolved = [p for p in plan if not p.get("op") and p.get("category") in ("decision", "breaking")]
    if unresolved:
        listing = "; ".join(f"{p['table_name']}.{p.get('column_name', '')} ({p['category']})" for p in unresolved)
        raise ValueError(f"unresolved drift changes: {listing}")
    out = dict(tables)
    plan = _one_rename_per_source(plan)
    # a rename consumes its dropped source column (trap Q13: the pair becomes one rename)
    renamed_from = {(p["table_name"], p.get("op_value")) for p in plan if p.get("op") == "rename_column"}
    rank = {"rename_column": 0, "drop_column": 1, "widen": 2, "add_column": 3}
    for p in sorted(plan, key=lambda x: rank.get(x.get("op") or "", 9)):
        t, c, op = p["table_name"], p.get("column_name"), p.get("op")
        if t not in out or not op:
            continue
        if op == "drop_column" and (t, c) in renamed_from:
            continue
        df = out[t]
        if op == "drop_column":
            df = df.drop(c)
        elif op == "rename_column":
            df = df.withColumnRenamed(p["op_value"], c)
        elif op == "add_column":
            strat = p.get("op_strategy") or "constant"
            kind = p.get("spark_type") or "string"
            if strat == "timestamp":
                v = F.to_timestamp(F.lit(now))
            elif strat == "uuid":
                keys = (key_cols or {}).get(t) or df.columns
                h = F.sha2(F.concat_ws("\u0000", *[F.col(k).cast("string") for k in keys]), 256)
                v = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                F.substring(h, 17, 4), F.substring(h, 21, 12))
            elif strat == "default":
                v = F.lit(static_default(p.get("col_default"), f"{t}.{c}")).cast(kind)
            else:
                v = F.lit(p.get("op_value") or ("" if kind == "string" else None)).cast(kind)
            df = df.withColumn(c, v)
        elif op == "widen":
            df = df.withColumn(c, F.col(c).cast(p.get("spark_type") or "string"))
        out[t] = df
    return out


def typed_plan(classified: DataFrame, new: DataFrame, db_id: str | None = None) -> list[dict]:
    """J4's rows of one database with the new columns' Spark type and default, ready to apply: a likely
    change of a column's type becomes a ``widen``."""
    from tessera.operators.catalog import map_column_types

    keys = ["db_id", "table_name", "column_name"]
    types = map_column_types(new).select(*keys, "spark_type").join(new.select(*keys, "col_default"), keys)
    widen = (F.col("kind") == "column_changed") & (F.col("category") == "likely") & F.col("detail").contains("type changed")
    rows = classified.join(types, keys, "left").withColumn("op", F.when(widen, "widen").otherwise(F.col("op")))
    if db_id is not None:
        rows = rows.where(F.col("db_id") == db_id)
    return [r.asDict() for r in rows.orderBy(*keys, "seq").collect()]


def static_default(default: str | None, column: str = "") -> str | None:
    """Text of a literal default: casts and quotes taken off; null for NULL."""
    text = re.sub(r"(?:::[A-Za-z_ \[\]\".0-9]+(?:\([0-9, ]*\))?)+\s*$", "", default or "").strip()
    while text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    if text.upper() in ("", "NULL"):
        return None
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if re.fullmatch(r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false|[tfyn01]", text, re.I):
        return text
    raise ValueError(f"default of {column} isn't a literal: {default}")


def _affinity(a: str, b: str) -> int:
    """Common prefix + common suffix length (case-insensitive)."""
    a, b = a.lower(), b.lower()
    pre = 0
    while pre < min(len(a), len(b)) and a[pre] == b[pre]:
        pre += 1
    suf = 0
    while suf < min(len(a), len(b)) and a[-1 - suf] == b[-1 - suf]:
        suf += 1
    return pre + suf


def _one_rename_per_source(plan: Sequence[Mapping]) -> list[dict]:
    """One dropped column can be suggested as the source of several added columns; the refresh keeps
    the closest name (largest common prefix + suffix, then name order) and adds the others as
    nullable constants."""
    best: dict[tuple, str] = {}
    for p in plan:
        if p.get("op") == "rename_column":
            k = (p["table_name"], p["op_value"])
            cur = best.get(k)
            cand = p["column_name"]
            rank = lambda name: (-_affinity(name, k[1]), name)
            if cur is None or rank(cand) < rank(cur):
                best[k] = cand
    out = []
    for p in plan:
        p = dict(p)
        if p.get("op") == "rename_column" and best.get((p["table_name"], p["op_value"])) != p["column_name"]:
            p.update(op="add_column", op_strategy="constant", op_value="")
        out.append(p)
    return out
