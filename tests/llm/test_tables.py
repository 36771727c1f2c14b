"""Durable cuts: what they return, and what they leave on the executors' disks."""

import time

from pyspark.sql import functions as F

from tessera.llm.tables import SHUFFLE_CLEANUP, durable


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {x for x in names if x.startswith("shuffle_")}


def test_a_durable_cut_leaves_no_shuffle_files(spark):
    ids = spark.range(3000).select("id", (F.col("id") % 7).alias("k"))
    total = ids.groupBy("k").agg(F.sum("id").alias("total")).hint("merge")
    before = shuffle_files(spark)
    cut = durable(ids.join(total, "k").groupBy("total").agg(F.count(F.lit(1)).alias("n")), "cut")
    for _ in range(50):  # files go in the background
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert {(r.total, r.n) for r in cut.collect()} == {(sum(range(k, 3000, 7)), len(range(k, 3000, 7))) for k in range(7)}


def test_a_durable_cut_keeps_the_sessions_setting(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    try:
        for value in (None, "false", "true"):
            spark.conf.unset(SHUFFLE_CLEANUP) if value is None else spark.conf.set(SHUFFLE_CLEANUP, value)
            durable(spark.range(3), "cut")
            assert spark.conf.get(SHUFFLE_CLEANUP, None) == value
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
