"""Whitening of embeddings by shifted Cholesky QR.

The fit list is every distinct vector once. Its centred rows X are never gathered: each pass streams them
through triangular solves with the factors found so far and adds up the Gram matrix of what comes out, one d x d sum
a task, summed by rows over the cluster. The first Gram matrix is shifted before its Cholesky factor is taken, so that it
always exists; the passes go on until the rows are orthonormal where they have any length. With R the
product of the factors and G the last Gram matrix, X'X = R'GR, so the singular values and right singular
vectors of root(G)R are those of X: the variances and components, without squaring the condition of X.

Entries become integers before anything is fitted, so the sums are exact. The driver holds d x d matrices only.

Left out: rows whose vector is null or empty, holds a null or non-finite entry or one of 2 ** 50 or more, or has another
length than most vectors (of equally frequent lengths the longer). Ties and repeated rows get the same
results. Where the table's vectors have less than ``components`` directions, ``whitened`` is null for the rest (so for
every component if all vectors are equal; ``explained`` is null there if there is no variance at all). ``deviation`` is null
where it exceeds a long. An empty table has no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import durable
from tessera.llm.words import column

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Rows of a block times the dimension.
BLOCK_VALUES = 1 << 20
#: Sums of a matrix row are added up in so many groups first.
LANES = 64
#: Orthogonalising passes; two do for all but extreme condition numbers, and the result doesn't depend on the number.
PASSES = 5
_UNIT = 2.0 ** -53


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # Python integers
    components: np.ndarray  # d x k, unit columns by falling variance
    variance: np.ndarray  # k
    explained: np.ndarray  # k
    rank: int
    identity_error: float | None = None


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows that take part, with ``x``: the integer vector."""
    entry_ok = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0 ** 50))
    rows = (vectors.withColumn("x", F.col(embedding).cast("array<double>")).where((F.size("x") > 0) & entry_ok)
            .withColumn("x", F.transform("x", lambda c: F.floor(c * SCALE) + OFFSET)))
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("x") == F.lit(length.d if length else 0))


def _blocks(batches):
    """The vectors of a task as integer matrices of bounded size, with the batch part they come from."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = column(batch, "x")
        d = len(x[0])
        step = max(1, BLOCK_VALUES // d)
        for lo in range(0, batch.num_rows, step):
            part = x.slice(lo, step)
            yield batch.slice(lo, step), part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: as longs where they hold it, else as Python integers."""
    top = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    if top < 2 ** 62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def _solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """a times the inverse of the upper triangle r, by substitution."""
    q = np.empty_like(a)
    for j in range(len(r)):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def _matrix(rows: DataFrame, of_block, d: int) -> np.ndarray:
    """The sum of ``of_block(x)`` (k x d) over all blocks of the table."""
    def partial(batches):
        total = None
        for _, x in _blocks(batches):
            g = of_block(x)
            total = g if total is None else total + g
        if total is not None:
            lane = TaskContext.get().partitionId() % LANES
            yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array([lane] * len(total), pa.int32()),
                                   pa.array([row.tobytes() for row in total], pa.binary())], names=["i", "lane", "row"])

    def add(table):
        total = np.sum([np.frombuffer(x) for x in table.column("row").to_pylist()], axis=0)
        return pa.table({c: table.column(c)[:1] if c != "row" else pa.array([total.tobytes()], pa.binary()) for c in table.column_names})

    parts = rows.mapInArrow(partial, "i int, lane int, row binary")
    parts = parts.groupBy("i", "lane").applyInArrow(add, "i int, lane int, row binary")
    sums = parts.select("i", "row").groupBy("i").applyInArrow(add, "i int, row binary").collect()
    out = np.zeros((len(sums), d))
    for r in sums:
        out[r.i] = np.frombuffer(r.row)
    return out


def _sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """(number of vectors, exact sum of each dimension): sums of the halves of each number can't overflow."""
    def partial(batches):
        n, high, low = 0, 0, 0
        for _, x in _blocks(batches):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.record_batch([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    total = fit.mapInArrow(partial, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = sorted(total.collect())
    return (rows[0].n if rows else 0), np.array([(r.high << 32) + r.low for r in rows], object)


def _factor(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """A square matrix T with T'T = X'X of the centred fit list X."""
    d = len(sums)
    factors: list[np.ndarray] = []

    def gram(x):
        q = _centred(x, n, sums)
        for r in factors:
            q = _solve(q, r)
        return q.T @ q

    composed = np.eye(d)
    for done in range(PASSES + 1):
        g = _matrix(fit, gram, d)
        g = (g + g.T) / 2
        value, vector = np.linalg.eigh(g)
        if not value[-1] > 0:
            return np.zeros((d, d))
        # orthonormal, but for directions in which the vectors don't differ
        if done == PASSES or (done and np.minimum(abs(value - 1), abs(value)).max() <= 1e-12 * d):
            break
        shift = 0.0 if value[0] > 0.5 else 11 * (n * d + d * (d + 1)) * _UNIT * value[-1]
        r = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors.append(r)
        composed = r @ composed
    return np.sqrt(np.maximum(value, 0))[:, None] * (vector.T @ composed)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``; None without rows."""
    listed = durable(rows.select("x").distinct(), "vectors")
    n, sums = _sums(listed)
    if not n:
        return None
    d = len(sums)
    _, length, right = np.linalg.svd(_factor(listed, n, sums))
    k = min(components, d)
    v = right[:k].T
    v = v * np.where(np.take_along_axis(v, abs(v).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    total = (length ** 2).sum()
    model = Whitening(n, sums, v, length[:k] ** 2 / n, length[:k] ** 2 / total if total > 0 else np.full(k, np.nan),
                      int((length[:k] > length[0] * d * n ** 0.5 * _UNIT).sum()) if total > 0 else 0)
    if model.rank:
        def moments(x):
            z = project(x, model)
            return z.T @ z
        model.identity_error = float(abs(_matrix(listed, moments, model.rank) / n - np.eye(model.rank)).max())
    return model


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of integer vectors."""
    r = model.rank
    return _centred(x, model.n, model.sums) @ model.components[:, :r] / np.sqrt(model.variance[:r])


def _deviation(x: np.ndarray, model: Whitening) -> list[int | None]:
    w = _scaled(x, model.n, model.sums)
    if w.dtype != object and float(abs(w).max()) ** 2 * w.shape[1] < 2.0 ** 62:
        return (w * w).sum(axis=1).tolist()
    exact = (w.astype(object) ** 2).sum(axis=1)
    return [v if v < 2 ** 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = model.components.shape[1] if model else 0

    def run(batches):
        for batch, x in _blocks(batches):
            m = len(x)
            z = np.zeros((m, k))
            z[:, : model.rank] = project(x, model)
            beyond = np.tile(np.arange(k) >= model.rank, m)
            repeat = np.repeat(np.arange(m), k)
            yield pa.record_batch([
                column(batch, "vec_id").take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(_deviation(x, model), pa.int64()).take(pa.array(repeat)), pa.array(z.ravel(), mask=beyond),
                pa.array(np.tile(model.explained, m), from_pandas=True), pa.array([model.identity_error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
