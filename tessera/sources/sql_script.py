"""Deterministic SQL text export of snapshot tables.

Per table (tables by name): one ``TRUNCATE TABLE "t" RESTART IDENTITY CASCADE;``
then one ``INSERT INTO "t" ("c1", ...) VALUES (...);`` per row, literals by
P6. Statements come out as rows ``(table_name, seq, row_key, statement)``;
ordering by those columns gives the script, and ``write_sql_script`` writes
it as text part files (one table after another) without funnelling the rows
through one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.render import quote_ident, render_cells, sql_literal

ROW_WARN_THRESHOLD = 5000  # rows above which the source warns that the script is large


def sql_statements(spark: SparkSession, tables: Mapping[str, DataFrame], types: Mapping[str, Mapping[str, str]],
                   order_by: Mapping[str, list[str]] | None = None) -> DataFrame:
    frames = []
    for name in sorted(tables):
        df = tables[name]
        keys = (order_by or {}).get(name) or df.columns[:1]
        text = render_cells(df)
        cols = ", ".join(quote_ident(c) for c in df.columns)
        values = F.concat_ws(", ", *[sql_literal(F.col(c), (types.get(name) or {}).get(c, "")) for c in df.columns])
        ins = text.select(F.lit(name).alias("table_name"), F.lit(1).alias("seq"),
                          F.concat_ws("|", *[F.col(k) for k in keys]).alias("row_key"),
                          F.concat(F.lit(f"INSERT INTO {quote_ident(name)} ({cols}) VALUES ("), values,
                                   F.lit(");")).alias("statement"))
        trunc = spark.createDataFrame([(name, 0, "", f"TRUNCATE TABLE {quote_ident(name)} RESTART IDENTITY CASCADE;")],
                                      "table_name string, seq int, row_key string, statement string")
        frames += [trunc, ins]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_sql_script(statements: DataFrame, path: str) -> dict:
    """Range-partitioned global sort, then text part files in script order. Returns the number of
    INSERT rows and whether it exceeds the size at which the source warns."""
    from pyspark.sql import Observation

    obs = Observation("sql_script_rows")
    # observed after the sort: the range partitioner's sampling job re-runs the sort's input, so a
    # metric placed below the sort would count rows twice
    (statements.orderBy("table_name", "seq", "row_key")
     .observe(obs, F.count_if(F.col("seq") == 1).alias("rows"))
     .select("statement").write.mode("error").text(path))
    rows = int(obs.get["rows"])
    return {"rows": rows, "warning": rows > ROW_WARN_THRESHOLD}
