"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

A uniform random permutation sends a random number of a partition's rows to each shard; these counts
follow a multivariate hypergeometric law whose margins are the partition sizes and the shard sizes.
So the matrix of counts is drawn first: the partitions are halved again and again, and at every
halving the rows that the left half sends to each shard are drawn given what the node as a whole
sends. Then each partition's rows are permuted locally and its first rows go to shard 0, the next ones to shard 1
and so on by its row of the matrix; every shard permutes what it got. Shard sizes differ
by one row at most, and all of it is DataFrame expressions.

The counts are drawn by inversion: the probabilities of the values within twelve standard deviations
of the mean follow from one another, so their running sum needs no factorials. The draws are a hash of
seed, node and shard, so a retried task draws the same.

The input is first written to the shared folder with its partition numbers, which fixes them. Null
texts or ids are rows as any other; repeated rows are told apart by their place. An empty table
gives no rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbering import chunk_bits, numbered
from tessera.llm.tables import durable

SHARDS = 40
SEED = 20240117
_TWO53 = 1 << 53


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _draw(total: str, good: str, draws: str, uniform: str) -> str:
    """SQL of one hypergeometric draw: how many of ``draws`` rows out of ``total`` are among ``good``."""
    low = "greatest(0L, p.d - (p.t - p.g), cast(floor(p.m - 12 * p.s - 12) as bigint))"
    high = "least(p.d, p.g, cast(ceil(p.m + 12 * p.s + 12) as bigint))"
    ratio = ("(cast(q.g - k as double) * cast(q.d - k as double)) / "
             "(cast(k + 1 as double) * cast(q.t - q.g - q.d + k + 1 as double))")
    steps = "if(q.hi > q.lo, sequence(q.lo, q.hi - 1L), cast(array() as array<bigint>))"
    one = "cast(1 as double)"
    total_weight = (f"aggregate({steps}, named_struct('w', {one}, 's', {one}), (a, k) -> "
                    + _let(f"a.w * {ratio}", "w", "named_struct('w', w, 's', a.s + w)") + ", a -> a.s)")
    walk = (f"aggregate({steps}, named_struct('w', {one}, 's', {one}, 'x', q.lo), (a, k) -> "
            + _let(f"a.w * {ratio}", "w", "named_struct('w', w, 's', a.s + w, 'x', if(a.s <= c, k + 1L, a.x))") + ", a -> a.x)")
    mean = f"cast({draws} as double) * {good} / {total}"
    spread = (f"sqrt(greatest(cast(0 as double), cast({draws} as double) * {good} / {total} * (1 - cast({good} as double) / {total}) "
              f"* ({total} - {draws}) / greatest(1L, {total} - 1)))")
    p = f"named_struct('t', {total}, 'g', {good}, 'd', {draws}, 'm', {mean}, 's', {spread})"
    q = f"named_struct('t', p.t, 'g', p.g, 'd', p.d, 'lo', {low}, 'hi', {high})"
    return f"if({total} = 0L, 0L, " + _let(p, "p", _let(q, "q", _let(f"{total_weight} * {uniform}", "c", walk))) + ")"


def _split(shards: str, draws: str, node: str, seed: int) -> str:
    """SQL: how many of ``draws`` rows go to each shard, given the rows each shard still takes."""
    uniform = f"(cast(pmod(xxhash64({seed}L, {node}, j), {_TWO53}L) as double) / {_TWO53})"
    x = _draw("a.total", "g", "a.left", uniform)
    step = _let(f"element_at({shards}, j)", "g", _let(x, "x", "named_struct('left', a.left - x, 'total', a.total - g, 'xs', concat(a.xs, array(x)))"))
    total = f"aggregate({shards}, 0L, (n, v) -> n + v)"
    return (f"aggregate(sequence(1, size({shards})), named_struct('left', {draws}, 'total', {total}, 'xs', cast(array() as array<bigint>)), "
            f"(a, j) -> {step}, a -> a.xs)")


def communication_matrix(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(block, counts): the rows that each block sends to each shard. ``blocks``: (block, n).

    One row holds the sizes of all blocks (one number for each input partition); after that the
    tree of halves spreads over rows."""
    root = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "n"))).alias("blocks"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    depth = max(0, (int(root.first()["k"]) - 1).bit_length())
    sizes = f"transform(sequence(0, {shards - 1}), j -> total div {shards} + if(j < total % {shards}, 1L, 0L))"
    node = root.where("k > 0").select("blocks", F.expr(sizes).alias("counts"), F.lit(1).cast("long").alias("node"))
    for _ in range(depth):
        halves = node.select("node", "counts", F.expr("slice(blocks, 1, (size(blocks) + 1) div 2)").alias("left"),
                             F.expr("slice(blocks, (size(blocks) + 1) div 2 + 1, size(blocks))").alias("right"))
        halves = halves.withColumn("rows", F.expr("aggregate(left, 0L, (n, b) -> n + b.n)"))
        halves = halves.withColumn("one", F.expr(f"if(size(right) = 0, counts, {_split('counts', 'rows', 'node', seed)})"))
        halves = halves.withColumn("two", F.expr("zip_with(counts, one, (a, b) -> a - b)"))
        node = halves.select(F.explode(F.expr(
            "array(named_struct('blocks', left, 'counts', one, 'node', node * 2), named_struct('blocks', right, 'counts', two, 'node', node * 2 + 1))")).alias("h")).select("h.*").where("size(blocks) > 0")
    return node.select(F.expr("blocks[0].block").alias("block"), "counts")


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The input's rows with ``shard`` and ``slot`` (gapless from 0 within the shard)."""
    docs = docs.drop("shard", "slot")
    placed = durable(docs.withColumn("_block", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "placed")
    rows = placed.select("_row", F.col("_block").alias("block"), F.xxhash64(F.lit(seed), "_row").alias("local"), F.xxhash64(F.lit(seed + 1), "_row").alias("final"))
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    matrix = durable(communication_matrix(sizes, shards, seed), "matrix")
    n = rows.count()

    permuted = numbered(rows, "block", "local", "at", chunk_bits(n))
    ends = F.expr("transform(sequence(1, size(counts)), j -> aggregate(slice(counts, 1, j), 0L, (n, c) -> n + c))")
    sent = permuted.join(matrix.select("block", ends.alias("ends")), "block").select(
        "_row", "final", F.expr("size(filter(ends, e -> e <= at))").cast("int").alias("shard"))
    slots = numbered(durable(sent, "sent"), "shard", "final", "slot", chunk_bits(n)).select("_row", "shard", "slot")
    return placed.join(slots, "_row").drop("_row", "_block")
