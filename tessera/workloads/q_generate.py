"""Registered generation / refresh queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import drift as D
from tessera.operators import generate as G
from tessera.operators.catalog import SCHEMA_COLUMNS
from tessera.session import scratch_path
from tessera.sources import store
from tessera.workloads.registry import _prep, query


@query("g1_generate_rows", """
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS idx FROM (SELECT DISTINCT c_custkey FROM customer)),
np AS (SELECT count(*) AS np FROM p),
r AS (SELECT row_number() OVER () AS i FROM orders)
SELECT r.i, printf('%08x-0000-4000-8000-%012x', r.i, r.i) AS o_id,
       ['F', 'O', 'P'][((r.i - 1) % 3) + 1] AS o_status,
       TIMESTAMP '2024-01-01 00:00:00' + (r.i - 1) * INTERVAL 60 SECOND AS o_created,
       printf('ORD-%06d', r.i) AS o_ref, p.c_custkey AS o_custkey
FROM r CROSS JOIN np JOIN p ON p.idx = ((r.i * 2654435761) % np.np + np.np) % np.np""")
def q_g1(spark, sf_dir):
    """As many generated orders as the orders table holds, each referencing an existing customer."""
    _prep(spark, sf_dir)
    n = spark.table("orders").count()
    specs = [G.ColumnSpec("o_id", "uuid"), G.ColumnSpec("o_status", "pool", values=["F", "O", "P"]),
             G.ColumnSpec("o_created", "timestamp", start="2024-01-01 00:00:00", step_seconds=60),
             G.ColumnSpec("o_ref", "format", fmt="ORD-%06d"),
             G.ColumnSpec("o_custkey", "ref", parent=spark.table("customer"), parent_key="c_custkey")]
    return G.generate_rows(spark, n, specs)


@query("g2_derive_revision", """
SELECT 'lineitem' AS table_name, count(*) AS row_count FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderstatus <> 'P'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus <> 'P'""")
def q_g2(spark, sf_dir):
    """A new revision whose tables are defined by SQL over the base revision, then written."""
    _prep(spark, sf_dir)
    base = {"orders": spark.table("orders"), "lineitem": spark.table("lineitem")}
    new = G.derive_revision(spark, base, {
        "orders": "SELECT * FROM orders WHERE o_orderstatus <> 'P'",
        "lineitem": "SELECT l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey "
                    "WHERE o.o_orderstatus <> 'P'"})
    return store.write_snapshot(spark, scratch_path(spark, "store"), "shop/derived", new, source="generate")


@query("g3_apply_refresh_plan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority AS o_priority, '' AS o_comment,
       CAST(7 AS BIGINT) AS o_retries, 'it''s new' AS o_label, CAST(NULL AS BIGINT) AS o_weight,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
         || substr(h, 21, 12) AS o_uid,
       TIMESTAMP '2024-01-01 00:00:00' AS o_synced_at
FROM (SELECT *, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) x""")
def q_g3(spark, sf_dir):
    """The orders table's schema drifts (price dropped, priority renamed, customer key widened, columns
    added with each kind of fill: constant, null, literal default, UUID, time); J4's suggestions are
    applied to the data."""
    _prep(spark, sf_dir)
    orders = spark.table("orders")
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "numeric",
             "o_orderdate": "timestamp without time zone", "o_orderpriority": "text"}

    def row(col, ordinal, t, nullable=False, default=None):
        return ("shop", "orders", ordinal, col, t, None, nullable, default, col == "o_orderkey", False, False,
                None, None, None)
    old = spark.createDataFrame([row(c, i, types[c]) for i, c in enumerate(orders.columns)], SCHEMA_COLUMNS)
    kept = [c for c in orders.columns if c not in ("o_totalprice", "o_orderpriority")]
    old = old.withColumn("col_type", F.when(F.col("column_name") == "o_custkey", "integer").otherwise(F.col("col_type")))
    new_rows = [row(c, i, types[c]) for i, c in enumerate(kept)]
    new_rows += [row("o_priority", 10, "text"), row("o_comment", 11, "text", nullable=True),
                 row("o_uid", 12, "uuid", default="gen_random_uuid()"),
                 row("o_synced_at", 13, "timestamp with time zone", default="now()"),
                 row("o_retries", 14, "integer", default="7"), row("o_label", 15, "text", default="'it''s new'::text"),
                 row("o_weight", 16, "bigint", nullable=True)]
    new = spark.createDataFrame(new_rows, SCHEMA_COLUMNS)
    changes = D.schema_diff(old, new)
    plan = G.typed_plan(D.classify_drift(changes, old, new), new, "shop")  # one table's changes
    out = G.apply_refresh_plan({"orders": orders}, plan, key_cols={"orders": ["o_orderkey"]})
    return out["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_priority",
                                "o_comment", "o_uid", "o_synced_at", "o_retries", "o_label", "o_weight")


#: table: (driver table whose number of rows it takes, key columns, columns: name, type, null, unique, enum, reference)
_SHOP = {
    "customer": ("customer", ["c_custkey"], [("c_custkey", "bigint"), ("c_name", "varchar", False, True), ("c_segment", "enum", False, False, "Segment"), ("c_referrer", "bigint", True, False, None, "customer.c_custkey")]),
    "supplier": ("supplier", ["s_suppkey"], [("s_suppkey", "integer"), ("s_email", "text", False, True)]),
    "part": ("part", ["p_partkey"], [("p_partkey", "uuid"), ("p_name", "text"), ("p_size", "integer", True)]),
    "orders": ("orders", ["o_orderkey"], [("o_orderkey", "bigint"), ("o_custkey", "bigint", False, False, None, "customer.c_custkey"), ("o_date", "date")]),
    "order_note": ("orders", ["n_id"], [("n_id", "bigint"), ("n_orderkey", "bigint", False, True, None, "orders.o_orderkey"), ("n_text", "text", True)]),
    "lineitem": ("lineitem", ["l_orderkey", "l_linenumber"], [
        ("l_orderkey", "bigint", False, False, None, "orders.o_orderkey"), ("l_linenumber", "integer"),
        ("l_partkey", "uuid", False, False, None, "part.p_partkey"), ("l_suppkey", "integer", True, False, None, "supplier.s_suppkey")]),
}
_REFERENCES = [(t, c[0], *c[5].split(".")) for t, (_, _, cols) in _SHOP.items() for c in cols if len(c) > 5]


@query("g1_generate_schema", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, count(*) AS distinct_keys, 0 AS duplicates, 0 AS nulls, 0 AS lost_references FROM {like}"
    for t, (like, _, _) in _SHOP.items()))
def q_g1_schema(spark, sf_dir):
    """A whole schema generated at the sizes of the driver tables, with the violations of its keys, required columns and references."""
    from tessera.operators import integrity as I
    from tessera.operators.generate_schema import generate_schema

    _prep(spark, sf_dir)
    rows = {t: spark.table(like).count() for t, (like, _, _) in _SHOP.items()}
    schema = []
    for t, (_, keys, cols) in _SHOP.items():
        for i, c in enumerate(cols):
            name, kind, null, unique, enum, ref = (*c, *(False, False, None, None)[len(c) - 2:])
            target = ref.split(".") if ref else (None, None)
            schema.append(("shop", t, i, name, kind, 25 if kind == "varchar" else None, null, None, name in keys, unique, False, enum, *target))
    tables = generate_schema(spark, spark.createDataFrame(schema, SCHEMA_COLUMNS), rows, {"Segment": ["AUTO", "FURNITURE", "TRAVEL"]})
    measures = ("row_count", "distinct_keys", "duplicates", "nulls", "lost_references")
    found = None
    for t, df in tables.items():
        _, keys, cols = _SHOP[t]
        unique = [c[0] for c in cols if len(c) > 3 and c[3]]
        needed = [c[0] for c in cols if len(c) < 3 or not c[2]]
        number = lambda name, n: {m: n if m == name else F.lit(0) for m in measures}
        one = F.count(F.lit(1))
        parts = [df.groupBy(*keys).agg(one.alias("n")).agg(*[c.alias(m) for m, c in {**number("", 0), "row_count": F.sum("n"), "distinct_keys": one}.items()])]
        parts += [bad.agg(*[c.alias(m) for m, c in number(name, one).items()]) for name, bad in (
            ("duplicates", I.key_violations(df, t, keys, unique)), ("nulls", I.null_violations(df, t, needed)),
            *(("lost_references", I.fk_violations(df, t, c, tables[p], p, pc)) for table, c, p, pc in _REFERENCES if table == t))]
        for part in parts:
            part = part.select(F.lit(t).alias("table_name"), *measures)
            found = part if found is None else found.unionByName(part)
    return found.groupBy("table_name").agg(*[F.sum(m).alias(m) for m in measures])
