"""Order-dependent operators against brute force, snapshot round trips, and every registered query
against its DuckDB oracle on the smallest driver tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators.graph import fk_load_order
from tessera.operators.history import schema_history, versions_behind
from tessera.operators.sequence import ordered_index, previous_value
from tessera.session import DRIVER_TABLES, scratch_path
from tessera.sources import store

SF = "/root/testdata/sf0.001"


def test_ordered_index_hot_group(spark):
    rows = [("hot", i) for i in range(300)] + [(f"g{i % 7}", i) for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int")
    got = {(r.g, r.k): (r.idx, r.prev) for r in
           previous_value(ordered_index(df, ["g"], ["k"], partitions=6), ["g"], ["k"], "k", partitions=5).collect()}
    for g in {r[0] for r in rows}:
        ks = sorted(k for gg, k in rows if gg == g)
        for i, k in enumerate(ks):
            assert got[(g, k)] == (i, ks[i - 1] if i else None)


def test_fk_load_order_parents_first_and_cycles(spark):
    tables = spark.createDataFrame([("d", t, i) for i, t in enumerate(["c", "b", "a", "x", "y", "z"])],
                                   "db_id string, table_name string, input_pos int")
    edges = spark.createDataFrame([("d", "c", "b"), ("d", "b", "a"), ("d", "x", "y"), ("d", "y", "x"),
                                   ("d", "z", "x"), ("d", "a", "missing")], "db_id string, child string, parent string")
    out = [(r.table_name, r.level) for r in fk_load_order(edges, tables).collect()]
    assert out == [("a", 0), ("b", 1), ("c", 2), ("x", None), ("y", None), ("z", None)]


def test_schema_history_and_behind(spark):
    obs = spark.createDataFrame([("db", "A", 1), ("db", "B", 2), ("db", "A", 3), ("db", "C", 4)],
                                "db_id string, fingerprint string, seen_at int")
    h = schema_history(obs)
    got = {r.fingerprint: (r.version, r.previous, r.last_seen) for r in h.collect()}
    assert got == {"A": (1, None, 3), "B": (2, "A", 2), "C": (3, "A", 4)}
    pairs = spark.createDataFrame([("db", "A", "C"), ("db", "C", "A"), ("db", "A", "A"), ("db", "Q", "Q")],
                                  "db_id string, from_fp string, to_fp string")
    b = {(r.from_fp, r.to_fp): r.behind for r in versions_behind(h, pairs).collect()}
    assert b == {("A", "C"): 2, ("C", "A"): None, ("A", "A"): 0, ("Q", "Q"): None}


def test_snapshot_round_trip_and_revision_numbers(spark):
    root = scratch_path(spark, "test-store")
    df = spark.createDataFrame([(1, "Carol's", None), (2, 'multi\nline "q"', 3.5)], "id long, name string, x double")
    counts = store.write_snapshot(spark, root, "a/b", {"t": df}, fmt="csv").collect()
    assert [(r.table_name, r.row_count) for r in counts] == [("t", 2)]
    store.write_snapshot(spark, root, "a/b", {"t": df})
    assert store.latest_revision(spark, root, "a/b") == "r002"
    back = store.read_revision(spark, root, "a/b", "r001")["t"]
    rows = sorted((r.id, r.name, r.x) for r in back.collect())
    assert rows == [("1", "Carol's", "NULL"), ("2", 'multi\nline "q"', "3.5")]
    with pytest.raises(LookupError):
        store.resolve(spark, root, "a/b", "r009")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    import __spark_entry__ as E
    return sorted(E.queries())


@pytest.mark.parametrize("name", _names())
def test_registered_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from tools.oracle_check import digest

    sdf = E.queries()[name](spark, SF).toPandas()
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no oracle")
    assert digest(sdf) == digest(duck.execute(sql).df())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "state" in df.columns
    assert F is not None


def test_stream_usage_equals_batch_under_any_split_and_compaction(spark):
    from tessera.operators.usage import latest_usage
    from tessera.streaming import jobs

    rows = [("s1", "f", f"t{i % 5}", "p", "keep", f"2024-01-0{1 + i % 9} 00:00:00", f"h{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "state string, file string, title string, project string, reset_mode string, "
                                     "ts string, test_hash string") \
        .withColumn("last_seen_at", F.to_timestamp("ts")).drop("ts")
    want = sorted(tuple(r) for r in latest_usage(df).collect())
    for n in (1, 3):
        src = scratch_path(spark, "t-src")
        df.repartition(n).write.parquet(src)
        out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
        jobs.stream_usage(spark, src, df.schema, out, ck).awaitTermination()
        assert sorted(tuple(r) for r in jobs.read_usage_latest(spark, out).collect()) == want
        jobs.compact_usage(spark, out)
        assert sorted(tuple(r) for r in jobs.read_usage_latest(spark, out).collect()) == want


def test_hot_key_third_of_rows(spark):
    """One FK value / key / state holds a third of all rows: results stay whole and exact."""
    from tessera.operators import integrity as I
    from tessera.operators.usage import usage_by_state

    n = 3000
    child = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") + 100000)
                                  .alias("fk"), F.col("id").alias("pk"), (F.col("id") % 2).alias("line"))
    parent = spark.range(0, 50).select(F.col("id").alias("k"))  # 7 is present, the rest are orphans
    v = {r.fk_value: r.rows for r in I.fk_violations(child, "c", "fk", parent, "p", "k").collect()}
    assert "7" not in v and len(v) == n - n // 3 and set(v.values()) == {1}
    dup = I.key_violations(child.select(F.col("fk").alias("a"), F.lit(1).alias("b")), "c", ["a", "b"])
    hot = [r for r in dup.collect() if r.key_value == "7|1"]
    assert hot and hot[0].dup_count == n // 3
    ev = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.lit("cold")).alias("state"),
                               (F.col("id") % 500).cast("string").alias("file"), F.lit("t").alias("title"),
                               F.lit("p").alias("project"), F.lit("keep").alias("reset_mode"),
                               F.timestamp_seconds(F.col("id")).alias("last_seen_at"),
                               F.col("id").cast("string").alias("test_hash"))
    u = {(r.state, r.file): (r.test_hash, r.state_n_tests) for r in usage_by_state(ev).collect()}
    assert len(u) == 1000
    assert u[("hot", "0")] == ("1500", 500)   # hot sightings of file 0 are ids 0 and 1500


def test_generate_pools_refs_and_preview_bytes(spark):
    from tessera.operators import generate as G

    parent = spark.range(10, 20).select(F.col("id").alias("pid"))
    out = G.generate_rows(spark, 3000, [
        G.ColumnSpec("status", "pool", values=["a", "b", "c"]),
        G.ColumnSpec("tier", "skewed", values=["gold", "silver", "bronze"], weights=[1, 3, 6]),
        G.ColumnSpec("ref", "ref", parent=parent, parent_key="pid"),
        G.ColumnSpec("id", "uuid")])
    rows = out.collect()
    assert len(rows) == 3000 and len({r.id for r in rows}) == 3000
    assert {r.ref for r in rows} <= set(range(10, 20)) and len({r.ref for r in rows}) == 10
    assert [r.status for r in sorted(rows, key=lambda r: r.i)[:4]] == ["a", "b", "c", "a"]
    share = {t: sum(r.tier == t for r in rows) / 3000 for t in ("gold", "silver", "bronze")}
    assert 0.07 < share["gold"] < 0.13 and 0.54 < share["bronze"] < 0.66
    again = G.generate_rows(spark, 3000, [G.ColumnSpec("tier", "skewed", values=["gold", "silver", "bronze"],
                                                       weights=[1, 3, 6])]).orderBy("i").collect()
    assert [r.tier for r in again] == [r.tier for r in sorted(rows, key=lambda r: r.i)]

    prev = store.preview_snapshot({"nation": spark.read.parquet(f"{SF}/nation.parquet")}, {"nation": ["n_nationkey"]})
    r = prev.collect()
    assert len(r) == 5 and r[0].row_count == 25 and r[0].truncated and r[0].bytes > 0


def test_restore_csv_types_checks_and_failure_modes(spark):
    from tessera.operators import integrity as I
    from tessera.plans.seed import restore_snapshot

    root = scratch_path(spark, "rs")
    a, b = scratch_path(spark, "ta"), scratch_path(spark, "tb")
    df = spark.createDataFrame([(1, "@env:NAME"), (2, "x"), (2, "y")], "id long, name string")
    store.write_snapshot(spark, root, "s", {"t": df}, fmt="csv", schema_fingerprint="f" * 64)
    pk = lambda tables: I.key_violations(tables["t"], "t", ["id"])
    st = restore_snapshot(spark, root, "s", [a, b], env_values={a: {"NAME": "n"}, b: {"NAME": "n"}},
                          types={"t": {"id": "integer", "name": "text"}}, checks=[pk])
    got = [(r.target, r.status) for r in st.collect()]
    assert got == [(a, "failed"), (b, "skipped")]                      # duplicate key stops the run
    st = restore_snapshot(spark, root, "s", [a, b], env_values={a: {"NAME": "n"}},
                          types={"t": {"id": "integer", "name": "text"}}, continue_on_error=True,
                          target_fingerprints={b: "0" * 64})
    got = {r.target: r.status for r in st.collect()}
    assert got == {a: "ok", b: "failed"}                               # b: schema mismatch guard
    back = store.read_published(spark, a, "t")
    assert dict(back.dtypes)["id"] == "bigint"
    assert sorted((r.id, r.name) for r in back.collect()) == [(1, "n"), (2, "x"), (2, "y")]


def test_export_then_refresh_flow(spark):
    from tessera.operators.catalog import SCHEMA_COLUMNS
    from tessera.plans.export import export_revision
    from tessera.plans.refresh import refresh_revision

    def c(t, name, typ, o, nullable=False, default=None):
        return ("db", t, o, name, typ, None, nullable, default, name == "id", False, False, None, None, None)
    old = spark.createDataFrame([c("users", "id", "integer", 1), c("users", "fullName", "text", 2),
                                 c("users", "age", "integer", 3)], SCHEMA_COLUMNS)
    live = spark.createDataFrame([c("users", "id", "integer", 1), c("users", "name", "text", 2),
                                  c("users", "bio", "text", 3, nullable=True),
                                  c("users", "seen", "timestamp", 4, default="now()")], SCHEMA_COLUMNS)
    users = spark.createDataFrame([(1, "Ann", 30), (2, "Bo", 40)], "id int, fullName string, age int")
    root, obs = scratch_path(spark, "flow"), scratch_path(spark, "obs")
    counts = export_revision(spark, root, "app/main", {"users": users}, old, observations_path=obs)
    assert [(r.table_name, r.row_count) for r in counts.collect()] == [("users", 2)]
    assert spark.read.parquet(obs).count() == 1

    report, new_counts = refresh_revision(spark, root, "app/main", old, live)
    rep = report.collect()[0]
    assert rep.has_drift and not rep.needs_decision and not rep.has_breaking
    assert [(r.table_name, r.row_count) for r in new_counts.collect()] == [("users", 2)]
    assert store.latest_revision(spark, root, "app/main") == "r002"
    t = store.read_revision(spark, root, "app/main")["users"]
    assert sorted(t.columns) == ["bio", "id", "name", "seen"]
    assert sorted((r.id, r.name, r.bio) for r in t.collect()) == [(1, "Ann", ""), (2, "Bo", "")]

    same_report, nothing = refresh_revision(spark, root, "app/main", live, live)
    assert nothing is None and not same_report.collect()[0].has_drift


def test_sync_plan_rules(spark):
    from tessera.operators.revisions import sync_plan

    local = spark.createDataFrame([
        ("a", "s1", "d1", "t1"),    # stable id match, same dataset and time -> up to date
        ("b", "s2", "d2", "t0"),    # stable id match, remote newer -> push
        ("c", "", "", ""),          # no id, one remote named c -> push (first sync)
        ("dup", None, None, None),  # two remotes named dup -> ambiguous
        ("new", None, None, None),  # nothing -> missing
    ], "name string, remote_scenario_id string, remote_id string, remote_updated_at string")
    remote = spark.createDataFrame([("d1", "s1", "a", "t1"), ("d2", "s2", "b-renamed", "t2"), ("d3", "s3", "c", "t3"),
                                    ("d4", "s4", "dup", "t4"), ("d5", "s5", "dup", "t5")],
                                   "id string, scenario_id string, name string, updated_at string")
    got = {r.name: (r.action, r.renamed, r.matched_remote_id) for r in sync_plan(local, remote).collect()}
    assert got == {"a": ("up_to_date", False, "d1"), "b": ("push", True, "d2"), "c": ("push", False, "d3"),
                   "dup": ("ambiguous", False, None), "new": ("missing", False, None)}


def test_resolve_revision_outcomes(spark):
    from tessera.operators.revisions import resolve_revisions

    scen = spark.createDataFrame([("a",), ("b",), ("c",)], "scenario string")
    revs = spark.createDataFrame([("a", "r001"), ("a", "r002"), ("c", "draft")], "scenario string, revision string")
    req = spark.createDataFrame([(1, "a", None), (2, "a", " r001 "), (3, "a", "r009"), (4, "b", None),
                                 (5, "c", "draft"), (6, "zz", None), (7, "c", None)],
                                "request_id int, scenario string, revision string")
    got = {r.request_id: (r.status, r.resolved) for r in resolve_revisions(req, scen, revs).collect()}
    assert got == {1: ("ok", "r002"), 2: ("ok", "r001"), 3: ("unknown_revision", None), 4: ("no_revisions", None),
                   5: ("ok", "draft"), 6: ("missing_scenario", None), 7: ("no_revisions", None)}


def test_revision_catalog_bad_manifests_and_sql_presence(spark):
    from tessera.operators.revisions import revision_history

    root = scratch_path(spark, "cat")
    df = spark.createDataFrame([(1,)], "id int")
    store.write_snapshot(spark, root, "a/x", {"t": df})
    store.write_snapshot(spark, root, "a/x", {"t": df}, source="generate")
    store.write_snapshot(spark, root, "b", {"t": df})
    fs = store.FS(spark)
    fs.write_text(f"{store.revision_dir(root, 'a/x', 'r002')}/{store.DATASET_SQL}", "INSERT INTO t VALUES (1);")
    fs.write_text(f"{root}/broken/revisions/r001/manifest.json", "{oops")
    good, bad = store.read_revision_catalog(spark, root)
    rows = sorted((r.scenario, r.revision, r.n, r.has_sql, r.row_counts["t"]) for r in good.collect())
    assert rows == [("a/x", "r001", 1, False, 1), ("a/x", "r002", 2, True, 1), ("b", "r001", 1, False, 1)]
    assert [r.path.endswith("broken/revisions/r001/manifest.json") for r in bad.collect()] == [True]
    hist = revision_history(good.withColumn("schema_fingerprint", F.lit("f" * 64))).collect()
    assert [(r.scenario, r.revision, r.is_latest, r.has_sql) for r in hist] == [
        ("a/x", "r002", True, True), ("a/x", "r001", False, False), ("b", "r001", True, False)]


def test_schema_lookup_rules(spark):
    from tessera.operators.revisions import lookup_schema

    inv = spark.createDataFrame([("abc123def456", "abc123def456" + "0" * 52, "Main"),
                                 ("abd999000111", "abd999000111" + "1" * 52, "")],
                                "short_id string, fingerprint string, display_name string")
    def found(ref, inventory=inv):
        kind, rows = lookup_schema(inventory, ref)
        return kind, sorted(r.short_id for r in rows.collect())

    assert found(" ABC ") == ("one", ["abc123def456"])
    assert found("ab")[0] == "many" and len(found("ab")[1]) > 1
    assert found("main") == ("one", ["abc123def456"])
    assert found("zzz") == ("none", [])
    assert found("")[0] == "many"
    assert lookup_schema(inv.limit(1), "")[0] == "one"


def test_failed_write_leaves_no_revision(spark):
    root = scratch_path(spark, "atomic")
    ok = spark.createDataFrame([(1,)], "id int")
    store.write_snapshot(spark, root, "s", {"t": ok})
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("id"))
                                 .alias("id"))
    with pytest.raises(Exception):
        store.write_snapshot(spark, root, "s", {"a": ok, "b": bad})
    assert store.latest_revision(spark, root, "s") == "r001"
    good, _ = store.read_revision_catalog(spark, root)
    assert [r.revision for r in good.collect()] == ["r001"]
    assert not store.FS(spark).exists(store.revision_dir(root, "s", "r002"))
    store.write_snapshot(spark, root, "s", {"t": ok})          # numbering continues cleanly
    assert store.latest_revision(spark, root, "s") == "r002"


def test_stream_usage_reads_event_json_files(spark):
    from tessera.operators.usage import latest_usage
    from tessera.sources.usage_events import read_usage_events
    from tessera.streaming import jobs

    src = scratch_path(spark, "ev-json")
    lines = ['{"testId":"a","state":"s1","file":"f","title":"t","project":"p","lastSeenAt":"2024-01-01T00:00:00Z",'
             '"testHash":"h1"}',
             '{"testId":"a","state":"s1","file":"f","title":"t","project":"p","lastSeenAt":"2024-01-02T00:00:00Z",'
             '"testHash":"h2"}',
             '{"testId":"b","state":"","file":"g","title":"t","lastSeenAt":"2024-01-03T00:00:00Z"}',
             '{not json']
    spark.createDataFrame([(line,) for line in lines], "v string").coalesce(1).write.text(src)
    out, ck = scratch_path(spark, "ev-out"), scratch_path(spark, "ev-ck")
    jobs.stream_usage(spark, src, None, out, ck, fmt="event-json").awaitTermination()
    got = [(r.state, r.file, r.test_hash) for r in jobs.read_usage_latest(spark, out).collect()]
    assert got == [("s1", "f", "h2")]
    batch = latest_usage(read_usage_events(spark, src).drop("test_id"))
    assert [(r.state, r.file, r.test_hash) for r in batch.collect()] == got


def test_stream_restore_from_csv_snapshot(spark):
    from pyspark.sql import types as T

    from tessera.streaming import jobs

    root = scratch_path(spark, "xs")
    df = spark.createDataFrame([(1, "@env:K", " pad "), (2, "x", None)], "id long, v string, w string")
    store.write_snapshot(spark, root, "s", {"t": df}, fmt="csv")
    src = f"{store.revision_dir(root, 's', 'r001')}/tables/t"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "v", "w")])
    out, ck = scratch_path(spark, "xs-out"), scratch_path(spark, "xs-ck")
    jobs.stream_restore(spark, src, schema, out, ck, {"K": "key"}, types={"id": "bigint", "v": "text", "w": "text"},
                        fmt="csv").awaitTermination()
    got = sorted(tuple(r) for r in jobs.read_restored(spark, out).select("id", "v", "w").collect())
    assert got == [(1, "key", " pad "), (2, "x", None)]


def test_usage_event_reader_modes(spark):
    from tessera.sources.usage_events import read_usage_events

    src = scratch_path(spark, "ev-modes")
    lines = ['{"testId":"a","state":"s","file":"f","title":"t","lastSeenAt":"2024-01-01T00:00:00Z"}',
             '{"testId":"b","state":null,"file":"g","title":"t","lastSeenAt":"2024-01-01T00:00:00Z"}',
             '{"state":"s","file":"h","title":"t","lastSeenAt":"2024-01-01T00:00:00Z"}',
             '{"testId":"c","state":"","file":"i","title":"t"}', '{broken']
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(src)
    go = sorted(r.file for r in read_usage_events(spark, src, mode="go").collect())
    ts = sorted(r.file for r in read_usage_events(spark, src, mode="ts").collect())
    assert go == ["f", "h"] and ts == ["f", "g", "i"]
    assert read_usage_events(spark, scratch_path(spark, "missing")).count() == 0


def test_schema_documents_keep_allowed_values_and_report_bad_ones(spark, tmp_path):
    from tessera.sources import schema_docs as SD

    schema = ("db_id string, table_name string, ordinal long, column_name string, col_type string, varchar_len int, nullable boolean, "
              "col_default string, is_primary boolean, is_unique boolean, is_generated boolean, enum_name string, fk_table string, "
              "fk_column string, allowed_values array<string>")
    rows = [("d", "t", 1, "s", "text", None, False, None, False, False, False, None, None, None, ["a", "b"])]
    path = str(tmp_path / "docs")
    SD.write_schema_docs(spark.createDataFrame(rows, schema), path)
    (tmp_path / "docs" / "broken.json").write_text("{not json\n")
    cols, _, bad = SD.read_schema_docs(spark, path)
    assert [(r.column_name, r.allowed_values) for r in cols.collect()] == [("s", ["a", "b"])]
    got = bad.collect()
    assert len(got) == 1 and got[0].path.endswith("broken.json") and got[0].document == "{not json"


def test_a_slow_writer_never_moves_the_pointer_back(spark, monkeypatch):
    """The first writer of a scenario finishes after a second one, which has written two newer revisions."""
    root = scratch_path(spark, "store")
    df = spark.range(3)
    real, inside = store._write_tables, []

    def slow(tables, base, fmt, parallel=4):
        if not inside:
            inside.append(1)
            for _ in range(2):
                store.write_snapshot(spark, root, "s", {"t": df})
            assert store.latest_revision(spark, root, "s") == "r003"
        return real(tables, base, fmt, parallel)

    monkeypatch.setattr(store, "_write_tables", slow)
    store.write_snapshot(spark, root, "s", {"t": df})
    assert store.latest_revision(spark, root, "s") == "r003"
    assert (store.FS(spark).read_text(f"{store.scenario_dir(root, 's')}/latest") or "").strip() == "r003"
    assert [r.revision for r in store.read_revision_catalog(spark, root)[0].orderBy("n").collect()] == ["r001", "r002", "r003"]


def test_the_catalog_walk_never_lists_tables(spark, monkeypatch):
    root = scratch_path(spark, "store")
    for scenario in ("a", "a/b+c", "a/b+c/d"):
        store.write_snapshot(spark, root, scenario.replace("+", "."), {"t": spark.range(3)})
    seen = []
    real = store.FS.list_names
    monkeypatch.setattr(store.FS, "list_names", lambda self, path: seen.append(path) or real(self, path))
    good, bad = store.read_revision_catalog(spark, root)
    assert sorted((r.scenario, r.revision, r.has_sql) for r in good.collect()) == [("a", "r001", False), ("a/b.c", "r001", False), ("a/b.c/d", "r001", False)]
    assert bad.count() == 0 and seen and not any("/tables" in p for p in seen)
    empty, none = store.read_revision_catalog(spark, scratch_path(spark, "nothing"))
    assert empty.count() == 0 and none.count() == 0
