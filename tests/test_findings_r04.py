"""Cases of the findings of round 4."""

import numpy as np
from pyspark.sql import functions as F


def test_block_tree_writes_places(spark, monkeypatch):
    """Copies of a place are one place of the tree; neither entries nor inverses are written, and all points get their sum."""
    from fieldspark.operators import blocktree

    at = np.random.default_rng(4).random((300, 2)) * [50, 900]
    p = np.repeat(at, 5, axis=0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, x double, y double")
    bell = lambda u, v: F.exp(-((u[0] - v[0]) * (u[0] - v[0]) / 900.0 + (u[1] - v[1]) * (u[1] - v[1]) / 90000.0))
    written, keep = [], blocktree.stored

    def counted(table):
        got = keep(table)
        written.append(got.count())
        return got

    monkeypatch.setattr(blocktree, "stored", counted)
    tree = blocktree.compress(df, ["x", "y"], bell, min_size=40, size=24)
    x = 1.0 + np.arange(len(p)) % 3
    got = {r.i: r.v for r in blocktree.apply(tree, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")).collect()}
    dense = np.exp(-((p[:, :1] - p[:, 0]) ** 2 / 900 + (p[:, 1:] - p[:, 1]) ** 2 / 90000)) @ x
    assert len(got) == len(p) and np.abs(np.array([got[i] for i in range(len(p))]) - dense).max() < 1e-4 * dense.max()
    assert max(written) <= len(p)


def test_fit_sparse_passes_don_t_grow_with_the_ids(spark, monkeypatch):
    """An index too long to be sent as probe tables costs no more passes: the probes are made beside the entries."""
    from fieldspark.operators import matrix

    rng = np.random.default_rng(6)
    m = np.zeros((120, 50))
    for i in range(120):
        m[i, rng.permutation(50)[: 12 + i % 9] if i else slice(None)] = rng.normal(size=12 + i % 9 if i else 50)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(m)))], "i long, j long, v double")
    steps, keep = [], matrix.stored
    monkeypatch.setattr(matrix, "SENT", 50)  # a probe at a time
    monkeypatch.setattr(matrix, "stored", lambda table: steps.append(1) or keep(table))
    got, _ = matrix.fit_sparse(a.select("i", "j"), matrix.operator(a), matrix.operator(a, True), spark.range(120).toDF("i"), spark.range(50).toDF("i"))
    rows = got.collect()
    assert len(rows) == np.count_nonzero(m) and all(abs(m[r.i, r.j] - r.v) < 1e-9 for r in rows)
    assert len(steps) <= 12
