"""Foreign-key load order for many schemas at once.

Delta iteration: a round joins only the tables that the round before placed with the edges that leave them. Every edge carries its
child's number of parents, so a child is placed in the round in which its last parent has been: the round adds up, for the
children it reaches and those that still wait, how many of their parents are placed. Each edge is used once in all. The edges are dealt by
(database, parent) once and keep that partitioning; the number of rounds is the depth of the deepest
FK chain (a schema property, tens at most). Each round's result is checkpointed to the shared folder, so
a lost executor only recomputes one round. Tables caught in (or below) a cycle are never reached by all their parents and are
appended last in input order, as the source does. Each placed table also carries the key that reproduces the source's
exact FIFO queue order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def fk_load_order(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """``tables(db_id, table_name, input_pos)``, ``edges(db_id, child, parent)`` ->
    ``(db_id, table_name, input_pos, level, in_cycle, kahn_key)`` in load order.

    Parents come before children. The order is exactly the source's FIFO Kahn
    order (trap Q12): FIFO processing is level-monotone, and within a level a
    table is released by its last-processed parent, tables released by the same
    parent in input order. So each placed table carries ``kahn_key`` = its last
    parent's key + [own input position] (roots: [input position]); ordering by
    (level, kahn_key) reproduces the queue order. The key's length is the
    table's level + 1, bounded by the FK depth. Self edges and edges to tables
    outside ``tables`` are ignored; tables in or below a cycle get a null level
    and come last in input order.
    """
    t = tables.select("db_id", "table_name", "input_pos")
    e = (edges.where(F.col("child") != F.col("parent"))
         .join(t.select("db_id", F.col("table_name").alias("child")), ["db_id", "child"], "left_semi")
         .join(t.select("db_id", F.col("table_name").alias("parent")), ["db_id", "parent"], "left_semi")
         .select("db_id", "child", "parent").distinct())
    parents = e.groupBy("db_id", "child").agg(F.count(F.lit(1)).alias("n_parents"))
    of_child = t.select("db_id", F.col("table_name").alias("child"), F.col("input_pos").cast("long").alias("child_pos"))
    edges = cut_lineage(e.join(parents, ["db_id", "child"]).join(of_child, ["db_id", "child"]).repartition("db_id", "parent"))

    # (n, key): the length makes a later level's key the larger one
    first = t.join(parents.withColumnRenamed("child", "table_name"), ["db_id", "table_name"], "left_anti").select(
        "db_id", "table_name", F.array(F.col("input_pos").cast("long")).alias("kahn_key"))
    newest, waiting, placed = cut_lineage(first), None, []
    while not newest.isEmpty():
        placed.append(newest.select("db_id", "table_name", "kahn_key"))
        reached = edges.join(newest.withColumnRenamed("table_name", "parent"), ["db_id", "parent"]).select(
            "db_id", "child", "child_pos", "n_parents", F.lit(1).cast("long").alias("n"), F.struct(F.size("kahn_key").alias("n"), "kahn_key").alias("last"))
        if waiting is not None:
            reached = reached.unionByName(waiting)
        state = cut_lineage(reached.groupBy("db_id", "child", "child_pos", "n_parents").agg(F.sum("n").alias("n"), F.max("last").alias("last")))
        newest = state.where("n = n_parents").select(
            "db_id", F.col("child").alias("table_name"), F.concat("last.kahn_key", F.array("child_pos")).alias("kahn_key"))
        waiting = state.where("n < n_parents")
    keys = reduce(DataFrame.unionByName, placed) if placed else first
    return (t.join(keys, ["db_id", "table_name"], "left").withColumn("level", F.size("kahn_key") - 1)
            .withColumn("level", F.when(F.col("kahn_key").isNotNull(), F.col("level"))).withColumn("in_cycle", F.col("level").isNull())
            .select("db_id", "table_name", "input_pos", "level", "in_cycle", "kahn_key")
            .orderBy("db_id", F.col("level").asc_nulls_last(), F.col("kahn_key").asc_nulls_last(), "input_pos"))
