"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks. With weight w the source's i-th block (from 0) may be
taken from slot floor(i / w) on and has to be taken by slot ceil((i + 1) / w); in each slot the open
block with the earliest deadline is taken. As the weights sum to one, every block meets its deadline,
so at any slot t a source has had its w * t blocks to within less than one.

Weights are taken as whole parts of ``CYCLE`` = 2**80, finer than the floats that they come from, and windows are
computed in whole numbers over the whole table, so nothing repeats and no error adds up. The schedule takes one step for
each block of the table, not for each slot: a source that runs out leaves its slots empty, which doesn't move another
source's windows. The driver walks through it once and keeps the state at every ``STRIDE``-th block (one number for
each source); from there the slots are made in parallel and joined to the documents by source and block.

``mix`` marks as kept what lies before the horizon, the slot at which the last block of the first source to run out is
due: up to there no slot is empty, so every source has its target weight of the kept blocks to within less than a block.
This is the largest set with the target weights in which no document repeats. With the default weights, size ** 0.7, a source of n blocks keeps
(m / n) ** 0.3 of them, m being the blocks of the smallest source. With ``alive`` < 1 the horizon is where sources of less than that weight are left, the others
are over and what is kept no longer has the weights; ``alive=0`` keeps everything.

A null source is a source of its own. Null ids and texts and repeated rows are rows as any other. Sources without a
given weight get none and are not kept; an empty table gives no rows. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.numbering import chunk_bits, numbered

CYCLE = 1 << 80
STRIDE = 1 << 16
BLOCK_ROWS = 16
ALIVE = 1.0
TEMPERATURE = 0.7
SEED = 7


def apportion(weights: dict, cycle: int = CYCLE) -> dict:
    """Whole shares of a cycle, from the weights' exact values, largest remainders first."""
    names = sorted((s for s, w in weights.items() if w > 0), key=lambda s: (s is not None, s or ""))
    total = sum(Fraction(weights[s]) for s in names)
    exact = {s: Fraction(weights[s]) / total * cycle for s in names}
    share = {s: int(exact[s]) for s in names}
    for s in sorted(names, key=lambda s: share[s] - exact[s])[: cycle - sum(share.values()) if names else 0]:
        share[s] += 1
    return {s: n for s, n in share.items() if n}


def steps(share: list, blocks: list, slot: int = 0, taken: list | None = None) -> Iterator[tuple[int, int, int]]:
    """(slot, source, block) of every block, earliest deadline first among released blocks. Goes on at ``slot`` with
    the blocks in ``taken`` done."""
    cycle = sum(share)
    coming = [(i * cycle // share[k], k, i) for k, i in enumerate(taken or [0] * len(share)) if i < blocks[k]]
    heapq.heapify(coming)
    ready: list = []
    while coming or ready:
        if not ready:
            slot = max(slot, coming[0][0])
        while coming and coming[0][0] <= slot:
            _, k, i = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(i + 1) * cycle // share[k]), k, i))
        _, k, i = heapq.heappop(ready)
        yield slot, k, i
        if i + 1 < blocks[k]:
            heapq.heappush(coming, ((i + 1) * cycle // share[k], k, i + 1))
        slot += 1


def schedule(share: dict) -> dict:
    """Slots of each source's blocks within one cycle."""
    slots: dict = {s: [] for s in share}
    for slot, k, _ in steps(list(share.values()), list(share.values())):
        slots[list(share)[k]].append(slot)
    return slots


def states(share: list, blocks: list) -> list[tuple[int, list]]:
    """(slot, blocks taken from each source) before every STRIDE-th block."""
    out, taken = [], [0] * len(share)
    for j, (slot, k, i) in enumerate(steps(share, blocks)):
        if j % STRIDE == 0:
            out.append((slot, list(taken)))
        taken[k] = i + 1
    return out


def horizon_of(share: list, blocks: list, alive: float) -> int:
    """The slot before which sources of at least ``alive`` of the weight still have blocks."""
    cycle = sum(share)
    due = [-(-n * cycle // w) for n, w in zip(blocks, share, strict=True)]  # a source's last deadline
    left = 0
    for k in sorted(range(len(due)), key=lambda k: -due[k]):
        left += share[k]
        if left >= Fraction(alive) * cycle:
            return due[k] if alive > 0 else max(due)
    return 0


def held(share: list, blocks: list, horizon: int) -> list:
    """Blocks of each source before the horizon."""
    taken = [0] * len(share)
    for slot, k, i in steps(share, blocks):
        if slot >= horizon:
            break
        taken[k] = i + 1
    return taken


def temperature_weights(counts: dict, power: float = TEMPERATURE) -> dict:
    """Target weights in proportion to a power of the sources' sizes (1: as they are, 0: all alike)."""
    return {s: n**power for s, n in counts.items()}


def _placed(docs: DataFrame, weights: dict | None, block_rows: int, seed: int) -> tuple[DataFrame, list, list]:
    """The rows with ``_at`` and ``_block`` in their source and its number ``_k``; shares and blocks of the sources."""
    spark = docs.sparkSession
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    share = apportion(temperature_weights(counts) if weights is None else {s: weights.get(s, 0) for s in counts})
    table = spark.createDataFrame([(s, k) for k, s in enumerate(share)], "_source string, _k int")
    key = docs.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "source", "text"))
    placed = numbered(key, "source", "_key", "_at", chunk_bits(sum(counts.values()))).withColumn("_block", F.expr(f"_at div {block_rows}"))
    # one row for each source
    found = placed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")), "left")
    return found.drop("_key", "_source"), list(share.values()), [-(-counts[s] // block_rows) for s in share]


def _slots(share: list, blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, taken in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [x for x, _ in zip(steps(share, blocks, slot, taken), range(STRIDE), strict=False)]
                slots, source, block = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(source, pa.int32()), pa.array(block, pa.int64()), pa.array(slots, pa.int64())], names=["_k", "_block", "slot"])
    return run


def mix(docs: DataFrame, weights: dict | None = None, alive: float = ALIVE, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """The input's rows with ``block`` (within the source), ``slot``, ``place`` (the order of the mix) and ``kept``.

    ``weights``: target weight of each source; by default a power of the sources' sizes. The driver sees
    one number for each source and stride."""
    docs = docs.drop("block", "slot", "place", "kept")
    found, share, blocks = _placed(docs, weights, block_rows, seed)
    start = docs.sparkSession.createDataFrame(states(share, blocks), "slot long, taken array<long>")
    slots = start.mapInArrow(_slots(share, blocks), "_k int, _block long, slot long")
    return (found.join(slots, ["_k", "_block"], "left").withColumnRenamed("_block", "block")
            .withColumn("place", F.expr(f"slot * {block_rows} + _at % {block_rows}"))
            .withColumn("kept", F.coalesce(F.col("slot") < F.lit(horizon_of(share, blocks, alive)), F.lit(False)))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "block", "slot", "place", "kept"))


def keep_mixed(docs: DataFrame, weights: dict | None = None, alive: float = ALIVE) -> DataFrame:
    """The input's rows, its columns, that the mix keeps."""
    found, share, blocks = _placed(docs, weights, BLOCK_ROWS, SEED)
    taken = held(share, blocks, horizon_of(share, blocks, alive))
    table = docs.sparkSession.createDataFrame(list(enumerate(taken)), "_of int, _held long")
    kept = found.join(F.broadcast(table), F.col("_k") == F.col("_of")).where("_block < _held")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
