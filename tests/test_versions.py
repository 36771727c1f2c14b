"""Differences between stored schema versions, and the incremental schema history."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import versions as V
from tessera.operators.catalog import SCHEMA_COLUMNS
from tessera.operators.history import schema_history
from tessera.streaming import jobs
from tests.test_bruteforce import _column


def _store(spark, versions):
    frames = [spark.createDataFrame(columns, SCHEMA_COLUMNS).withColumn("fingerprint", F.lit(fp)) for fp, columns in versions.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return V.schema_store(out)


def _versions():
    users = _column("users", 0, "id", "integer", primary=True)
    orders = [_column("orders", 0, "id", "integer", primary=True), _column("orders", 1, "user_id", "integer", fk=("users", "id"))]
    return {"one": [users], "two": [users, *orders], "three": [users, orders[0], _column("orders", 1, "user_id", "integer"), _column("users", 1, "name", "text")]}


def test_summaries_and_changes_between_versions(spark):
    pairs = spark.createDataFrame([("one", "two"), ("two", "one"), ("two", "three"), ("two", "two"), ("two", "gone"), (None, "one"), ("one", "two")],
                                  "from_fp string, to_fp string")
    got = {(r.from_fp, r.to_fp): (r.summary, r.changes) for r in V.version_summaries(_store(spark, _versions()), pairs).collect()}
    assert got == {("one", "two"): ("+1 tbl", ["+ table orders added"]), ("two", "one"): ("-1 tbl", ["- table orders removed"]),
                   ("two", "three"): ("+1 col", ["- orders.user_id FK removed", "+ users.name added text nullable=false"]),
                   ("two", "two"): ("-", [])}


def test_history_carries_the_diff_from_the_previous_version(spark):
    seen = spark.createDataFrame([("db", "one", 1), ("db", "two", 2), ("db", "gone", 3), ("db", "three", 4), ("db", "one", 5)],
                                 "db_id string, fingerprint string, seen_at int")
    got = {r.fingerprint: (r.version, r.previous, r.diff_from_previous) for r in V.history_with_diffs(seen, _store(spark, _versions())).collect()}
    assert got == {"one": (1, None, None), "two": (2, "one", "+1 tbl"), "gone": (3, "two", None), "three": (4, "gone", None)}


def test_check_reports_status_behind_and_drift(spark):
    latest = spark.createDataFrame([("s1", "a", "r001", "one"), ("s2", "a", "r002", "two"), ("s3", "a", "r003", None), ("s4", "a", "r004", "gone"), ("s5", "b", "r001", "one")],
                                   "scenario string, db_id string, revision string, schema_fingerprint string")
    live = spark.createDataFrame([("a", "two")], "db_id string, fingerprint string")
    history = schema_history(spark.createDataFrame([("a", "one", 1), ("a", "gone", 2), ("a", "two", 3)], "db_id string, fingerprint string, seen_at int"))
    got = {r.scenario: (r.status, r.behind, r.drift, r.changes) for r in V.status_with_drift(latest, live, history, _store(spark, _versions())).collect()}
    assert got == {"s1": ("outdated", 2, "+1 tbl", ["+ table orders added"]), "s2": ("current", None, None, None), "s3": ("noschema", None, None, None),
                   "s4": ("noschema", 1, None, None), "s5": ("unknown", None, None, None)}


@pytest.mark.parametrize("late", [False, True])
def test_any_split_of_the_stream_gives_the_batch_history(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(jobs, "FOLD_EVERY", 2)
    rnd = random.Random(4)
    rows = sorted({(f"db{rnd.randint(0, 5)}", rnd.choice("ABCDEF"), rnd.randint(0, 300)) for _ in range(160)}, key=lambda r: r[2])
    cuts = [rows[i::5] if late else rows[i * len(rows) // 5:(i + 1) * len(rows) // 5] for i in range(5)]
    schema = "db_id string, fingerprint string, seen_at int"
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    reads = []
    real = jobs._merged_history
    monkeypatch.setattr(jobs, "_merged_history", lambda seen, state, log: real(seen, state, lambda: reads.append(1) or log()))
    for i, cut in enumerate(cuts):
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_schema_history(spark, src, spark.createDataFrame([], schema).schema, out, ckpt).awaitTermination()
        want = schema_history(spark.createDataFrame([r for c in cuts[: i + 1] for r in c], schema))
        assert sorted(jobs.read_schema_history(spark, out).collect(), key=str) == sorted(want.select(*jobs._HISTORY).collect(), key=str)
    assert bool(reads) == late  # the log is read for late sightings only


def test_a_repeated_batch_changes_nothing(spark):
    schema = "db_id string, fingerprint string, seen_at int"
    state = schema_history(spark.createDataFrame([("a", "X", 1), ("a", "Y", 2)], schema))
    seen = spark.createDataFrame([("a", "Y", 2), ("b", "Z", 1)], schema)
    got = sorted(tuple(r) for r in jobs._merged_history(seen, state, None).select(*jobs._HISTORY).collect())
    assert got == [("b", "Z", 1, 1, 1, None)]
