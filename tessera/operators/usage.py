"""Usage events folded into per-state views.

Input shape (``USAGE_COLUMNS``): one row per sighting of a test using a
state. The fold keeps the newest sighting per (state, file, title, project)
and summarises each state. Everything is a hash aggregate with map-side
partial aggregation, so a state or test that holds a large share of all
events is pre-combined in every task before the shuffle; no group is ever
collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USAGE_COLUMNS = ["state", "file", "title", "project", "reset_mode", "last_seen_at", "test_hash"]
USAGE_KEY = ["state", "file", "title", "project"]


def latest_usage(events: DataFrame) -> DataFrame:
    """Newest sighting per test key (state, file, title, project).

    Ties on ``last_seen_at`` are broken by ``test_hash`` then ``reset_mode``
    (the source keeps the first file in directory order, which has no
    meaning on a distributed store; trap Q21).
    """
    newest = F.max(F.struct("last_seen_at", "test_hash", "reset_mode")).alias("_n")
    return (events.groupBy(*USAGE_KEY).agg(newest)
            .select(*USAGE_KEY,
                    F.col("_n.reset_mode").alias("reset_mode"),
                    F.col("_n.last_seen_at").alias("last_seen_at"),
                    F.col("_n.test_hash").alias("test_hash")))


def state_summary(latest: DataFrame) -> DataFrame:
    """Per state: newest use and number of distinct tests using it."""
    return latest.groupBy("state").agg(
        F.max("last_seen_at").alias("state_last_used_at"),
        F.count(F.lit(1)).alias("state_n_tests"))


def usage_by_state(events: DataFrame, ordered: bool = True) -> DataFrame:
    """The used-by list of every state, one row per test, with state totals.

    The nested per-state list of the source is represented flat and ordered by
    (state, file, title); ordering is a range-partitioned global sort, so a hot
    state is split over many tasks instead of being collected into one list.
    """
    latest = latest_usage(events)
    out = latest.join(state_summary(latest), "state")
    if ordered:
        out = out.orderBy("state", "file", "title", "project")
    return out


def annotate_usage(scenarios: DataFrame, latest: DataFrame, scenario_col: str = "scenario") -> DataFrame:
    """Each scenario with its distinct test count and last use (0 / null when unused).

    ``latest`` is the output of :func:`latest_usage`; its ``state`` is the
    scenario name. The usage side is aggregated before the join, so the join
    is one row per state at most.
    """
    per_state = state_summary(latest).withColumnRenamed("state", scenario_col)
    return (scenarios.join(per_state, scenario_col, "left")
            .select(*scenarios.columns,
                    F.coalesce(F.col("state_n_tests"), F.lit(0)).alias("tests_using"),
                    F.col("state_last_used_at").alias("last_used_at")))


def explode_contract_handles(contracts: DataFrame, env_values: DataFrame | None = None,
                             env: str | None = None) -> DataFrame:
    """``provides map<handle, map<key, value>>`` exploded to rows.

    A key ending in ``Env`` (longer than three characters) names an
    environment value: the suffix is dropped and the value is looked up in
    ``env_values(env, key, value)`` for ``env``. Unresolved lookups keep a
    null value and ``resolved = false``.
    """
    rows = (contracts
            .select("state", F.explode("provides").alias("handle", "kv"))
            .select("state", "handle", F.explode("kv").alias("raw_key", "raw_value")))
    is_env = (F.col("raw_key").endswith("Env")) & (F.length("raw_key") > 3)
    rows = rows.withColumn("is_env", is_env).withColumn(
        "key", F.when(is_env, F.expr("substring(raw_key, 1, length(raw_key) - 3)")).otherwise(F.col("raw_key")))
    if env_values is None:
        return rows.select("state", "handle", "key", F.col("raw_value").alias("value"),
                           F.lit(True).alias("resolved"))
    vals = env_values
    if env is not None:
        vals = vals.where(F.col("env") == F.lit(env))
    vals = vals.select(F.col("key").alias("_ek"), F.col("value").alias("_ev"))
    joined = rows.join(vals, (F.col("is_env")) & (F.col("raw_value") == F.col("_ek")), "left")
    value: Column = F.when(F.col("is_env"), F.col("_ev")).otherwise(F.col("raw_value"))
    return joined.select("state", "handle", "key", value.alias("value"),
                         (~F.col("is_env") | F.col("_ev").isNotNull()).alias("resolved"))
