"""Steps that grew too fast on larger tables (FINDINGS_r03.md)."""

import numpy as np

from fieldspark.operators import aggregates, cross, lowrank, matrix


def _entries(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(m)))], "i long, j long, v double")


def test_fit_sparse_asks_each_side_for_what_it_needs(spark):
    """Rows of 20 entries and one full row, whose entries are found by columns with one open entry: 44 and 6 probes."""
    rng = np.random.default_rng(3)
    m = np.zeros((300, 60))
    for i in range(300):
        m[i, rng.permutation(60)[:20] if i else slice(None)] = rng.normal(size=20 if i else 60)
    a, asked = _entries(spark, m), [[], []]

    def counted(side):
        def run(x):
            asked[side] += [r["k"] for r in x.select("k").distinct().collect()]
            return matrix.apply(a, x, bool(side))

        return run

    got, probes = matrix.fit_sparse(a.select("i", "j"), counted(0), counted(1), spark.range(300).toDF("i"), spark.range(60).toDF("i"))
    rows = got.collect()
    assert len(rows) == np.count_nonzero(m) and all(abs(m[r.i, r.j] - r.v) < 1e-6 for r in rows)
    assert (len(asked[0]), len(asked[1]), probes) == (44, 6, 44)


def test_row_tables_in_place_of_long_ones(spark):
    """Operators on row tables give what those on (i, k, v) give, with one row an index instead of one a probe."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 9)) * (rng.random((12, 9)) < 0.5)
    a, ids = _entries(spark, m), spark.range(9).toDF("i")
    z = aggregates.probe_rows(ids, 0, 3, 1)
    assert sorted(map(tuple, lowrank.from_row_table(z).collect())) == sorted(map(tuple, aggregates.probes(ids, 3, 1).collect()))
    chain = matrix.Chain(matrix.operator(a, transpose=True), matrix.operator(a))
    both = [lowrank.row_products(f, z, 3) for f in (chain, lambda x: matrix.apply(a, matrix.apply(a, x), transpose=True))]
    x, y = ({r.i: r.row for r in t.collect()} for t in both)
    assert x.keys() == y.keys() and all(np.allclose(x[i], y[i]) for i in x)
    d = {r.i: r.d for r in aggregates.hutchinson_diagonal(chain, ids, 3, 1).collect()}
    w = np.array([r.row for r in z.orderBy("i").collect()])
    assert np.allclose([d[i] for i in range(9)], (w * (m.T @ m @ w)).sum(axis=1) / 3)


def test_joins_of_index_tables_are_not_broadcast(spark):
    """Row tables are as long as the matrix, however small their files are."""
    x = spark.range(50).select("id", "id").toDF("i", "v").selectExpr("i", "array(cast(v % 2 as double)) AS row")
    y = lowrank._apart(x.selectExpr("i", "row AS b"))
    assert "BroadcastHashJoin" not in x.join(y, "i")._jdf.queryExecution().toString()


def test_patches_share_groups(spark):
    """Patches of several sizes, changed together, equal each on its own; there are far fewer groups than patches."""
    rng = np.random.default_rng(6)
    rows = [(p, 3 * p + int(i), 3 * p + int(j), float(v)) for p in range(200) for i, j, v in zip(*rng.integers(0, 1 + p % 3, (2, 4)), rng.normal(size=4))]
    made = matrix.patch_positive(spark.createDataFrame(rows, "patch_id long, i long, j long, v double"))
    got = {(r.patch_id, r.i, r.j): r.v for r in made.collect()}
    want = {}
    for p in range(200):
        mine = [r for r in rows if r[0] == p]
        ids = sorted({x for r in mine for x in r[1:3]})
        m = np.zeros((len(ids), len(ids)))
        for _, i, j, v in mine:
            m[ids.index(i), ids.index(j)] += v
        w, u = np.linalg.eigh((m + m.T) / 2)
        m = (u * np.maximum(w, 0)) @ u.T
        want |= {(p, i, j): m[a, b] for a, i in enumerate(ids) for b, j in enumerate(ids)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "patch_id" not in made._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].split("]")[0]  # grouped by a hash of them


def test_alternate_keeps_rows_together(spark, monkeypatch):
    """The entries that all sweeps read are stored with each row in one file."""
    kept = []
    monkeypatch.setattr(lowrank, "stored", lambda df, keep=lowrank.stored: kept.append(keep(df)) or kept[-1])
    a = spark.range(400).selectExpr("id % 40 AS i", "id div 40 AS j", "cast(1 + (id % 40) * (id div 40) as double) AS v")
    lowrank.alternate(a.repartition(4, "j"), 2, sweeps=1)
    files = kept[0].selectExpr("i", "input_file_name() AS f").distinct()
    assert kept[0].columns == ["i", "j", "v"] and files.count() == 40


def test_kernel_entries_need_no_join(spark):
    """A kernel's row is a column over the factor's own table."""
    places = spark.range(30).selectExpr("id AS i", "cast(id as double) AS x")
    _, col_of = cross.kernel_access(places, places, ["x"], lambda x, y: 1 / (1 + x[0] + y[0]))
    got = cross._grown(places.selectExpr("*", "cast(array() AS array<double>) AS row"), col_of(3), [], 2.0)
    assert {r.i: r.row for r in got.collect()} == {i: [1.0 / (1 + i + 3) / 2.0] for i in range(30)}
