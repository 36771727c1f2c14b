"""Registered streaming queries: driver-table data split into several files, consumed by a file
stream with one file per micro-batch (``availableNow``), final state compared with the batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.usage import state_summary
from tessera.session import scratch_path
from tessera.streaming import jobs
from tessera.workloads.shared import env_values
from tessera.workloads.registry import _prep, query


def _split_files(df, path, n=4, key=None):
    """Write ``df`` as ``n`` files (by a hash of ``key``) to feed a file stream."""
    (df.repartition(n, key) if key else df.repartition(n)).write.mode("error").parquet(path)
    return path


@query("x1_stream_usage", same_oracle_as="a7_usage_by_state")
def q_x1(spark, sf_dir):
    _prep(spark, sf_dir, "usage_events")
    ev = spark.table("usage_events")
    src = _split_files(ev, scratch_path(spark, "usage-src"), key="last_seen_at")
    out, ckpt = scratch_path(spark, "usage-out"), scratch_path(spark, "usage-ckpt")
    jobs.stream_usage(spark, src, ev.schema, out, ckpt).awaitTermination()
    latest = jobs.read_usage_latest(spark, out)
    return latest.join(state_summary(latest), "state")


@query("x2_stream_schema_history", same_oracle_as="w4_schema_history")
def q_x2(spark, sf_dir):
    _prep(spark, sf_dir, "observations")
    obs = spark.table("observations")
    src = _split_files(obs, scratch_path(spark, "obs-src"), key="seen_at")
    out, ckpt = scratch_path(spark, "hist-out"), scratch_path(spark, "hist-ckpt")
    jobs.stream_schema_history(spark, src, obs.schema, out, ckpt).awaitTermination()
    return jobs.read_schema_history(spark, out)


@query("x3_stream_restore", same_oracle_as="p7_resolve_markers")
def q_x3(spark, sf_dir):
    _prep(spark, sf_dir, "customer_marked")
    cm = spark.table("customer_marked")
    src = _split_files(cm, scratch_path(spark, "crm-src"), key="c_custkey")
    out, ckpt = scratch_path(spark, "crm-out"), scratch_path(spark, "crm-ckpt")
    jobs.stream_restore(spark, src, cm.schema, out, ckpt, env_values()).awaitTermination()
    return jobs.read_restored(spark, out).select(*[F.col(c) for c in cm.columns])
