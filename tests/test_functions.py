"""Coercion, markers, parsers and scripts: reference unit-test values."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import coerce as CO
from tessera.functions import markers as M
from tessera.functions import parse as P
from tessera.operators import scripts as S

PG = [("NULL", "integer", None), ("null", "text", None), ("", "integer", None), ("", "text", ""),
      ("", "character varying", ""), ("", "char", ""), ("true", "boolean", True), ("t", "boolean", True),
      ("yes", "boolean", True), ("1", "boolean", True), ("FALSE", "boolean", False), ("n", "boolean", False),
      ("42", "integer", 42), ("abc", "integer", None), (" 42 ", "integer", None), ("3.14", "numeric", 3.14)]


@pytest.mark.parametrize("value,typ,want", PG)
def test_postgres_scalars(spark, value, typ, want):
    got = spark.createDataFrame([(value,)], "v string").select(CO.coerce_value(F.col("v"), typ).alias("x")).collect()[0].x
    assert got == want


def test_mysql_bool_is_int_and_no_yn(spark):
    df = spark.createDataFrame([("true",), ("0",), ("y",)], "v string")
    got = [r.x for r in df.select(CO.coerce_value(F.col("v"), "tinyint", "mysql").alias("x")).collect()]
    assert got == [1, 0, None]


def test_timestamps(spark):
    df = spark.createDataFrame([("2026-04-18 00:15:14",), ("2026-04-18",), ("2026-04-18T00:15:14Z",),
                                ("2026-04-18 02:15:14.5 +0200 UTC",)], "v string")
    got = [str(r.x) for r in df.select(CO.coerce_value(F.col("v"), "timestamp without time zone").alias("x")).collect()]
    assert got == ["2026-04-18 00:15:14", "2026-04-18 00:00:00", "2026-04-18 00:15:14", "2026-04-18 00:15:14.500000"]


def test_json_repair_and_arrays(spark):
    df = spark.createDataFrame([("{'a': 1}",), ('{"a":1}',), ("{a:1}",)], "v string")
    assert [r.x for r in df.select(CO.repair_json(F.col("v")).alias("x")).collect()] == ['{"a": 1}', '{"a":1}', "{a:1}"]
    arr = spark.createDataFrame([('a,b,"c,d"',), ('["x","y"]',), ("{p,q}",)], "v string")
    got = [r.x for r in arr.select(CO.to_pg_array(F.col("v")).alias("x")).collect()]
    assert got == ['a,b,"c,d"', '{"x","y"}', "{p,q}"]


def test_rejects_are_reported(spark):
    df = spark.createDataFrame([("1", "x"), ("abc", "y")], "id string, name string")
    typed = CO.coerce_table(df, {"id": "integer", "name": "text"})
    clean, rejects = CO.split_rejects(typed, ["name"], "t")
    assert [r.id for r in clean.collect()] == [1, None]
    assert [(r.name, r.column_name, r.raw) for r in rejects.collect()] == [("y", "id", "abc")]


def test_markers(spark):
    df = spark.createDataFrame([(1, "@env:API_KEY", "plain"), (2, "@env:API_KEY\n", "@env:OTHER")],
                               "id int, a string, b string")
    out = M.resolve_markers(df, {"API_KEY": "k1", "OTHER": ""}, env="dev", use_process_env=False)
    assert [(r.a, r.b) for r in out.orderBy("id").collect()] == [("k1", "plain"), ("@env:API_KEY\n", "")]
    with pytest.raises(ValueError, match="MISSING"):
        M.resolve_markers(spark.createDataFrame([("@env:MISSING",)], "a string"), {}, use_process_env=False)
    audit = M.marker_audit(df, ["id"], {"API_KEY": "k1", "OTHER": ""}, table="t").collect()
    assert sorted((r.id, r.column_name, r.key) for r in audit) == [(1, "a", "API_KEY"), (2, "b", "OTHER")]


def test_parsers(spark):
    row = spark.range(1).select(
        P.allowed_values(F.lit("CHECK ((status = ANY (ARRAY['a'::text, 'b'::text])))")).alias("a"),
        P.allowed_values(F.lit("CHECK (x IN ('p', 'q'))")).alias("b"),
        P.allowed_values(F.lit("CHECK (x > 0)")).alias("c"),
        P.enum_values(F.lit("enum('x', 'y','')")).alias("e"),
        P.enum_values(F.lit("varchar(10)")).alias("f")).collect()[0]
    assert row.a == ["a", "b"] and row.b == ["p", "q"] and row.c is None
    assert row.e == ["x", "y"] and row.f is None


def test_script_contract(spark):
    sql = """-- TRUNCATE c;
    TRUNCATE TABLE public."a", b RESTART IDENTITY;
    INSERT INTO a VALUES (1); INSERT INTO "B" VALUES (2);
    DELETE FROM c WHERE id = 1; INSERT INTO c VALUES (3);
    DELETE FROM d; INSERT INTO public.d VALUES (4);
    /* INSERT INTO e VALUES (5); */"""
    scripts = spark.createDataFrame([("s", sql)], "script_id string, sql string")
    pop = spark.createDataFrame([("s", t, 1) for t in "abcde"], "script_id string, table_name string, rows int")
    got = {r.table_name: r.ok for r in S.script_contract_check(scripts, pop).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False}


def test_script_stats_and_split(spark):
    sql = ('INSERT INTO "t" ("a", "b") VALUES (1, 2);\nINSERT INTO "t" ("a") VALUES (1), (2), ((3));'
           "\nSELECT 'x;y';")
    sc = spark.createDataFrame([("s", sql)], "script_id string, sql string")
    st = S.script_stats(sc).collect()[0]
    assert st.columns == ["a"] and st.row_count == 3
    assert S.split_statements(sc).count() == 3


def test_mysql_date_reads_export_form(spark):
    df = spark.createDataFrame([("2026-04-18",), ("2026-04-18 00:00:00 +0000 UTC",), ("x",)], "v string")
    got = [str(r.x) for r in df.select(CO.coerce_value(F.col("v"), "date", "mysql").alias("x")).collect()]
    assert got == ["2026-04-18", "2026-04-18", "None"]


def test_csv_scan_warnings_and_ragged_rows(spark):
    from tessera.session import scratch_path
    from tessera.sources import store

    path = scratch_path(spark, "csv")
    spark.createDataFrame([("id,name,extra\n1,a,x\n2,b\n3,\"multi\nline\",z\n,,\n",)], "v string") \
        .coalesce(1).write.text(path)
    typed, rejects, warn = store.read_snapshot(spark, path, "t", {"id": "integer", "name": "text", "age": "integer"})
    rows = sorted(((r.id if r.id is not None else -1), r.name) for r in typed.collect())
    assert rows == [(-1, ""), (1, "a"), (3, "multi\nline")]
    kinds = sorted((r.kind, r.detail) for r in warn.collect() if r.kind != "ragged_row")
    assert kinds == [("missing_column", "age"), ("unknown_column", "extra")]
    assert [r.kind for r in warn.collect()].count("ragged_row") == 1
    assert rejects.count() == 0


def test_script_contract_strict_order(spark):
    sql = "INSERT INTO a VALUES (1); TRUNCATE a; TRUNCATE b; INSERT INTO b VALUES (2);"
    scripts = spark.createDataFrame([("s", sql)], "script_id string, sql string")
    pop = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "script_id string, table_name string, rows int")
    loose = {r.table_name: r.ok for r in S.script_contract_check(scripts, pop).collect()}
    strict = {r.table_name: r.ok for r in S.script_contract_check(scripts, pop, strict_order=True).collect()}
    assert loose == {"a": True, "b": True} and strict == {"a": False, "b": True}


def test_marker_env_fallback_rules(spark, monkeypatch):
    """Trap Q17: an empty configured value counts as set; an empty process variable is missing."""
    monkeypatch.setenv("FROM_PROCESS", "p")
    monkeypatch.setenv("EMPTY_PROCESS", "")
    df = spark.createDataFrame([("@env:FROM_PROCESS", "@env:EMPTY_CONFIG")], "a string, b string")
    out = M.resolve_markers(df, {"EMPTY_CONFIG": ""}).collect()[0]
    assert (out.a, out.b) == ("p", "")
    with pytest.raises(ValueError, match="EMPTY_PROCESS"):
        M.resolve_markers(spark.createDataFrame([("@env:EMPTY_PROCESS",)], "a string"), {})
    assert M.has_any_marker(df) and not M.has_any_marker(spark.createDataFrame([("@env:lower",)], "a string"))
    untouched = spark.createDataFrame([("plain",)], "a string")
    assert M.resolve_markers(untouched, {}) is untouched            # marker fast path: input reused


def test_sql_script_writer_and_hashes(spark):
    from tessera.session import scratch_path
    from tessera.sources import sql_script as SQ

    df = spark.range(6000).select(F.col("id"), F.lit("it's").alias("name"))
    st = SQ.sql_statements(spark, {"t": df}, {"t": {"id": "bigint", "name": "text"}})
    info = SQ.write_sql_script(st, scratch_path(spark, "sql"))
    assert info == {"rows": 6000, "warning": True}
    first = st.where("seq = 1").orderBy("row_key").first().statement
    assert first == 'INSERT INTO "t" ("id", "name") VALUES (0, \'it\'\'s\');'
    h = spark.range(1).select(P.content_hash(F.lit("abc")).alias("h")).first().h
    assert h == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_strict_json_validity(spark):
    cases = {'{"a":1}': True, ' [1, 2] ': True, "null": True, '"x"': True, '{"a":1} x': False, "[1]]": False,
             "1 2": False, "{'a':1}": False, "NaN": False, "": False, '{"a":1,}': False}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.ok for r in df.select("v", CO.json_valid(F.col("v")).alias("ok")).collect()}
    assert got == cases
    arr = spark.createDataFrame([("[1]]",)], "v string").select(CO.to_pg_array(F.col("v")).alias("x")).first().x
    assert arr == "{1]}"   # not a JSON array: quote-aware split of the inner text, as the source


def test_whitespace_trimming_covers_tabs_and_newlines(spark):
    sql = "TRUNCATE a,\n\tb;\nINSERT INTO a VALUES (1);\nINSERT INTO b VALUES (1);"
    scripts = spark.createDataFrame([("s", sql)], "script_id string, sql string")
    pop = spark.createDataFrame([("s", "a", 1), ("s", "b", 1)], "script_id string, table_name string, rows int")
    assert all(r.ok for r in S.script_contract_check(scripts, pop).collect())
    e = spark.range(1).select(P.enum_values(F.lit("enum(\t'x',\n'y' )")).alias("e")).first().e
    assert e == ["x", "y"]
    arr = spark.createDataFrame([('[a,\t"b,c"\n]',)], "v string").select(CO.to_pg_array(F.col("v")).alias("x")).first().x
    assert arr == '{a,"b,c"}'


def test_trailing_newline_is_not_a_number(spark):
    df = spark.createDataFrame([("42\n",), ("1.5\n",), ("42",)], "v string")
    got = [r.x for r in df.select(CO.coerce_value(F.col("v"), "bigint").alias("x")).collect()]
    assert got == [None, None, 42]
    got = [r.x for r in df.select(CO.coerce_value(F.col("v"), "numeric").alias("x")).collect()]
    assert got == [None, None, 42.0]
    from tessera.sources.store import parse_revision_id
    assert parse_revision_id("r007") == 7 and parse_revision_id("r007\n") is None


def test_float_range_and_special_values(spark):
    vals = ["inf", "-Infinity", "NaN", ".5", "5.", "1E+5", "1e400", "-1e400", "0x10"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = {r.v: r.x for r in df.select("v", CO.coerce_value(F.col("v"), "numeric").alias("x")).collect()}
    assert got["inf"] == float("inf") and got["-Infinity"] == float("-inf") and got["NaN"] != got["NaN"]
    assert (got[".5"], got["5."], got["1E+5"]) == (0.5, 5.0, 100000.0)
    assert got["1e400"] is None and got["-1e400"] is None and got["0x10"] is None


def test_plain_timestamp_with_fraction(spark):
    df = spark.createDataFrame([("2026-04-18 00:15:14.123",), ("2026-04-18 00:15:14.5",)], "v string")
    for dialect, typ in (("postgres", "timestamp"), ("mysql", "datetime")):
        got = [str(r.x) for r in df.select(CO.coerce_value(F.col("v"), typ, dialect).alias("x")).collect()]
        assert got == ["2026-04-18 00:15:14.123000", "2026-04-18 00:15:14.500000"]
