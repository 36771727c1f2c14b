"""Embedding whitening against a decomposition of all rows on one machine, exact sums and the awkward tables."""

import math

import numpy as np
import pytest

from tessera.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "clash", "clash") for i, v in vectors], SCHEMA).repartition(3)


def whitened(spark, vectors, components=whitening.COMPONENTS):
    rows = whitening.usable(frame(spark, vectors))
    model = whitening.fit(rows, components)
    out = {}
    for r in whitening.whiten(rows, model).collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return model, out


def plain(vectors, components):
    """Exact deviations, variances and whitened coordinates (up to the sign of a component)."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in vectors}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = lambda v: [(n * c - s) / n for c, s in zip(v, sums, strict=True)]
    a = np.array([centre(v) for v in fit])
    _, length, right = np.linalg.svd(a, full_matrices=False)
    e, vec = length[:components] ** 2 / n, right[:components].T
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    return n, deviation, e * n / (length ** 2).sum(), {i: np.array(centre(v)) @ vec / np.sqrt(e) for i, v in x.items()}


def close(model, out, vectors, components):
    n, deviation, explained, z = plain(vectors, components)
    assert model.n == n and set(out) == set(z)
    k = len(explained)
    got = np.array([[out[i][c].whitened for c in range(1, k + 1)] for i in z])
    want = np.array(list(z.values()))
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-7
    assert all(out[i][1].deviation == deviation[i] and out[i][1].n == n for i in z)
    assert np.allclose(model.explained, explained, rtol=1e-9) and model.identity_error < 1e-9


def test_equals_a_local_decomposition(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(300, 20)) * np.linspace(3, 0.3, 20)
    vectors = [(i, v) for i, v in enumerate(base)] + [(1000 + i, base[0]) for i in range(200)] + [(5000, base[7])]
    odd = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [math.nan] + [0] * 19), (2004, [math.inf] + [0] * 19),
           (2005, [1.0] * 19), (2006, [1e30] + [0] * 19)]
    model, out = whitened(spark, vectors + odd)
    close(model, out, vectors, 16)
    assert max(len(v) for v in out.values()) == 16


def test_ill_conditioned_vectors(spark):
    rnd = np.random.default_rng(4)
    line = rnd.normal(size=(400, 1)) * 5000
    vectors = list(enumerate(line + rnd.normal(size=(400, 6)) * np.array([0.1, 0.1, 0.2, 0.3, 0.4, 0.5])))
    model, out = whitened(spark, vectors)
    close(model, out, vectors, 6)


def test_fewer_directions_than_components(spark):
    rnd = np.random.default_rng(5)
    two = rnd.integers(-50, 50, size=(60, 2))
    vectors = list(enumerate(np.concatenate([two, two, np.full((60, 1), 7)], axis=1)))
    model, out = whitened(spark, vectors)
    assert model.rank == 2 and model.identity_error < 1e-9
    assert all([out[i][c].whitened is None for c in range(1, 6)] == [False, False, True, True, True] for i in out)
    assert abs(sum(model.explained) - 1) < 1e-12


@pytest.mark.parametrize("copies", [1, 5])
def test_equal_vectors_have_no_components(spark, copies):
    model, out = whitened(spark, [(i, [1.0, 2.0]) for i in range(copies)])
    assert model.n == 1 and model.rank == 0
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for v in out.values() for r in v.values())


def test_large_numbers_are_exact_or_null(spark):
    vectors = [(0, [2.0 ** 40, 0.0]), (1, [0.0, 1.0]), (2, [5.0, 2.0 ** 20])]
    _, out = whitened(spark, vectors)
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for (i, _), v in zip(vectors, x, strict=True):
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert out[i][1].deviation == (exact if exact < 2 ** 63 else None)


def test_empty_table(spark):
    model, out = whitened(spark, [])
    assert model is None and out == {}
    assert whitened(spark, [(1, None), (2, [])])[1] == {}
