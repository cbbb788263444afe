"""Sparse plus low-rank matrices and fits of sparse patterns against dense arithmetic."""

import numpy as np
import pytest

from fieldspark.operators import matrix
from fieldspark.operators.composite import SparsePlusLowRank


def _entries(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")


def _rows(spark, f):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(f)], "i long, row array<double>")


def _vector(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


def _numpy(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.i] += r.v
    return out


def _made(spark, rng, n, m, rank):
    s = rng.random((n, m)) * (rng.random((n, m)) < 0.2)
    x, y = rng.normal(size=(n, rank)), rng.normal(size=(m, rank))
    return SparsePlusLowRank(_entries(spark, s), (_rows(spark, x), _rows(spark, y))), s + x @ y.T


def test_sparse_plus_low_rank(spark):
    rng = np.random.default_rng(3)
    a, da = _made(spark, rng, 12, 9, 2)
    b, db = _made(spark, rng, 9, 7, 3)
    x, y = rng.normal(size=7), rng.normal(size=12)
    product = a.times(b).recompressed(1e-12)
    assert np.allclose(_numpy(product.apply(_vector(spark, x)), 12), da @ db @ x)
    assert np.allclose(_numpy(product.transposed().apply(_vector(spark, y)), 7), (da @ db).T @ y)
    assert len(product.factors[0].first()["row"]) == 5  # the ranks of both operands, and the entries beside them
    assert product.sparse.count() <= 12 * 7
    twice = a.plus(a.scaled(0.5)).recompressed(1e-10)
    assert len(twice.factors[0].first()["row"]) == 2
    z = rng.normal(size=9)
    assert np.allclose(_numpy(twice.apply(_vector(spark, z)), 12), 1.5 * da @ z)
    left, right = rng.normal(size=(12, 2)), rng.normal(size=(9, 2))
    weights = _rows(spark, left), _rows(spark, right)
    want = (da * (left @ right.T)) @ z
    assert np.allclose(_numpy(a.weighted_apply(weights, _vector(spark, z)), 12), want)
    assert np.allclose(_numpy(a.weighted(weights, 1e-12).apply(_vector(spark, z)), 12), want)


def test_composites_with_one_part(spark):
    """No factors, factors without rows, no entries, and a vector without rows."""
    rng = np.random.default_rng(4)
    a, da = _made(spark, rng, 6, 6, 1)
    none = spark.createDataFrame([], "i long, j long, v double")
    empty = spark.createDataFrame([], "i long, row array<double>")
    x = rng.normal(size=6)
    v = _vector(spark, x)
    sparse, low = SparsePlusLowRank(a.sparse), SparsePlusLowRank(none, a.factors)
    s = da - np.outer(*(np.array([r.row[0] for r in f.orderBy("i").collect()]) for f in a.factors))
    assert np.allclose(_numpy(sparse.times(sparse).apply(v), 6), s @ s @ x)
    assert np.allclose(_numpy(sparse.times(low).plus(low).apply(v), 6), (s @ (da - s) + da - s) @ x)
    assert SparsePlusLowRank(none, (empty, empty)).recompressed(1e-6).factors is None
    assert a.apply(v.limit(0)).count() == 0 or np.allclose(_numpy(a.apply(v.limit(0)), 6), 0)


@pytest.mark.parametrize("kind", ["long row", "long column", "dense", "cross", "lengths"])
def test_fit_sparse(spark, kind):
    """A row, a column or both as long as the matrix cost as many probes as short ones; a dense core widens them."""
    rng = np.random.default_rng(5)
    n = 30 if kind == "dense" else 400
    m = rng.normal(size=(n, n)) * (rng.random((n, n)) < (1 if kind == "dense" else 3 / n))
    if kind in ("long row", "cross"):
        m[7] = rng.normal(size=n)
    if kind in ("long column", "cross"):
        m[:, 9] = rng.normal(size=n)
    if kind == "lengths":  # most rows are found in the second turn, which asks for no new probes; the others widen them
        m = rng.normal(size=(n, 90)) * (np.arange(90) < np.where(np.arange(n) % 9, 25, 90)[:, None])
    a, ids = _entries(spark, m), spark.range(n).toDF("i")
    pattern = a.select("i", "j")
    got, probes = matrix.fit_sparse(pattern.union(pattern.limit(5)), matrix.operator(a), matrix.operator(a, True), ids, ids, width=14)
    rows = got.collect()
    assert len(rows) == np.count_nonzero(m) and all(abs(m[r.i, r.j] - r.v) < 1e-6 for r in rows)
    assert probes <= (200 if kind == "lengths" else 116 if kind == "dense" else 32)


def test_fit_sparse_without_entries(spark):
    """An empty pattern has an empty answer; a pattern entry that the matrix lacks is zero."""
    none = spark.createDataFrame([], "i long, j long, v double")
    ids = spark.range(3).toDF("i")
    assert matrix.fit_sparse(none, matrix.operator(none), matrix.operator(none, True), ids, ids)[0].count() == 0
    a = spark.createDataFrame([(0, 1, 2.0)], "i long, j long, v double")
    asked = spark.createDataFrame([(0, 1), (2, 2)], "i long, j long")
    got = {(r.i, r.j): round(r.v, 9) + 0.0 for r in matrix.fit_sparse(asked, matrix.operator(a), matrix.operator(a, True), ids, ids)[0].collect()}
    assert got == {(0, 1): 2.0, (2, 2): 0.0}
