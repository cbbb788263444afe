"""Golden values, identities and numpy comparisons of the operators that SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.functions import complexes, curves
from fieldspark.operators import clusters, geofit, grid, iterate, knn, lowrank, matrix, mesh, ordering
from fieldspark.plans import registry
from fieldspark.sources import readers


def vec(spark, x):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, v double")


def dense(df, n):
    out = np.zeros(n)
    for r in df.collect():
        out[r.i] = r.v
    return out


def rows(df):
    return np.array([r.row for r in df.orderBy("i").collect()])


def test_threshold_golden(spark):
    s = spark.createDataFrame([(1, k, y) for k, y in enumerate([1000.0, 100.0, 10.0, 1.0, 0.1])], "series_id int, k long, y double")
    got = {r.threshold: r.first for r in ordering.threshold_crossings(s, [2000, 1000, 999, 333, 8, 0.5, 0.001]).collect()}
    assert [got[float(t)] for t in (2000, 1000, 999, 333, 8, 0.5, 0.001)] == [0, 1, 1, 1, 3, 4, -1]


def test_offset_errors(spark):
    b = spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "batch long, length long")
    s = ordering.offsets(b, ranges=2)
    got = {r.ind: (r.batch, r.offset) for r in ordering.to_batch(spark.createDataFrame([(x,) for x in (-1, 0, 2, 3, 6, 7)], "ind long"), s).collect()}
    assert got == {-1: (None, None), 0: (0, 0), 2: (0, 2), 3: (2, 0), 6: (2, 3), 7: (None, None)}
    with pytest.raises(Exception, match="out of range"):
        ordering.to_global(spark.createDataFrame([(0, 3)], "batch long, offset long"), s).collect()


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_nearest(spark, dim):
    rng = np.random.default_rng(dim)
    p, q = np.concatenate([rng.normal(size=(150, dim)), np.zeros((3, dim))]), np.concatenate([rng.normal(size=(30, dim)), np.full((1, dim), 40.0)])
    axes = ["x", "y", "z"][:dim]
    make = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id long, " + ", ".join(f"{x} double" for x in axes))
    for k in (1, 4, 200):
        got = knn.nearest(make(p), make(q), axes, k).collect()
        d = ((q[:, None] - p[None]) ** 2).sum(2)
        want = {i: [j for _, j in sorted((round(v, 12), j) for j, v in enumerate(row))][:k] for i, row in enumerate(d)}
        by = {}
        for r in sorted(got, key=lambda r: (r.q, r.rank)):
            by.setdefault(r.q, []).append(r.id)
        assert all(np.allclose(d[i][by[i]], d[i][want[i]]) for i in want) and all(len(by[i]) == min(k, len(p)) for i in want)


def test_ellipsoids(spark):
    rng = np.random.default_rng(3)
    mu, sig = rng.uniform(size=(25, 2)), []
    for _ in range(25):
        a = rng.normal(size=(2, 2))
        sig.append((a @ a.T + 0.2 * np.eye(2)) * 0.01)
    e = spark.createDataFrame([(i, m.tolist(), s.tolist()) for i, (m, s) in enumerate(zip(mu, sig))], "ell_id long, mu array<double>, sigma array<array<double>>")
    hits = set()
    for i in range(25):
        for j in range(i):
            ts = np.linspace(1e-6, 1 - 1e-6, 4000)
            d = mu[i] - mu[j]
            k = [1 - d @ np.linalg.solve(sig[i] / t + sig[j] / (1 - t), d) / 1.3**2 for t in ts]
            if min(k) >= 0:
                hits.add((j, i))
    got = {(r.a, r.b) for r in clusters.ellipsoid_pairs(e, 1.3).collect()}
    assert got == hits
    want = _batches(mu, hits)
    assert {r.ell_id: r.batch for r in clusters.ellipsoid_batches(e, 1.3).collect()} == want


def _batches(mu, hits):
    """The sequential rule; hits: pairs of linked rows."""
    near, left, far, want, batch = hits | {(b, a) for a, b in hits}, list(range(len(mu))), dict.fromkeys(range(len(mu)), math.inf), {}, 0
    while left:
        taken = []
        for i in sorted(left, key=lambda i: (-far[i], i)):
            if all((i, t) not in near for t in taken):
                taken.append(i)
                want[i] = batch
        left = [i for i in left if i not in want]
        for i in left:
            far[i] = min(far[i], *(((mu[i] - mu[t]) ** 2).sum() for t in taken))
        batch += 1
    return want


@pytest.mark.parametrize("finish", [1 << 16, 12, 0])
def test_ellipsoid_copies(spark, finish):
    """Copies in any order, lone ones among them, against the sequential rule; with small components fitted in groups, with
    some of them in groups, and with none."""
    rng = np.random.default_rng(8)
    places = [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (9.0, 0.0), (9.5, 0.5), (30.0, 0.0)]
    which = rng.permutation([0] * 6 + [1] * 4 + [2] * 2 + [3] * 3 + [4] + [5] * 7)
    sigma = [[[0.09, 0.0], [0.0, 0.09]], [[0.16, 0.0], [0.0, 0.16]]]
    wide = rng.integers(0, 2, len(which)) * (which == 0)
    mu = np.array([places[k] for k in which])
    reach = 2.0 * (0.3 + 0.1 * wide)
    hits = {(i, j) for j in range(len(mu)) for i in range(j) if np.linalg.norm(mu[i] - mu[j]) <= reach[i] + reach[j]}
    e = spark.createDataFrame([(i, mu[i].tolist(), sigma[int(w)]) for i, w in enumerate(wide)], "ell_id long, mu array<double>, sigma array<array<double>>")
    e = e.union(spark.createDataFrame([(99, None, None)], e.schema))
    want = _batches(mu, hits)
    assert {r.ell_id: r.batch for r in clusters.ellipsoid_batches(e, 2.0, finish=finish).collect()} == want
    if finish == 12:
        assert {r.ell_id: r.batch for r in clusters.ellipsoid_batches(e, 2.0, max_batches=3, finish=finish).collect()} == {i: b for i, b in want.items() if b < 3}


def test_ellipsoid_batches_whole(spark, tmp_path):
    """Suppliers with one centre need a batch each; the registered query gives all of them one."""
    spark.createDataFrame([(k,) for k in (1, 1001, 2001, 3001, 500)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.ell_id: r.batch for r in registry.QUERIES["win7_ellipsoid_batches"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 500: 0, 1001: 1, 2001: 2, 3001: 3}


def test_radial_functions_whole(spark, tmp_path):
    """The registered query interpolates through all suppliers' places, repeated ones once."""
    spark.createDataFrame([(k,) for k in [*range(1, 151), 1001, 1060]], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    parts = [(k, k * 13 % 50, 900 + (k * 37 % 1000) / 10) for k in range(1, 200)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    c = np.array([(k * 7 % 50, k * 131 % 1000) for k in range(1, 151)], float)
    p = np.array([(x, round(v * 10) - 9000) for _, x, v in parts], float)

    def phi(a, b):
        d = ((a[:, None] - b[None]) ** 2).sum(2)
        return np.where(d <= 1600, np.exp(-d / 72), 0.0)

    want = phi(p, c) @ np.linalg.solve(phi(c, c), c[:, 0])
    got = {r.id: r.value for r in registry.QUERIES["geo4_radial_functions"](spark, str(tmp_path)).collect()}
    assert got.keys() == {k for (k, _, _), near in zip(parts, phi(p, c)) if near.any()}
    assert all(abs(got[k] - want[k - 1]) < 1e-6 for k in got)


def test_cluster_orders(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double")
    want = clusters._numpy_sort(p, np.arange(200), 0)
    got = [r.id for r in clusters.geometric_sort(df, ["x", "y"], finish=32).orderBy("place").collect()]
    assert got == want.tolist()
    tree, members = clusters.cluster_tree(df, ["x", "y"], min_size=16)
    sizes = {r.cluster: r["count"] for r in members.groupBy("cluster").count().collect()}
    assert max(sizes.values()) <= 16 and sum(sizes.values()) == 200
    pairs = clusters.block_pairs(tree).collect()
    points = {c: [r.id for r in members.where(F.col("cluster") == c).collect()] for c in sizes}
    inside = lambda c: [i for leaf, ids in points.items() for i in ids if str(bin(leaf))[2:].startswith(bin(c)[2:])]
    assert sum(len(inside(r.row)) * len(inside(r.col)) for r in pairs) == 200 * 200 and {r.kind for r in pairs} == {"near", "far"}


def test_grid_identities(spark):
    n, h = (21, 17), (0.25, 0.25)
    x, y = np.mgrid[0 : n[0], 0 : n[1]]
    v = np.exp(-((x - 10) ** 2 + (y - 8) ** 2) * 0.05)
    df = spark.createDataFrame([(int(i), int(j), float(v[i, j])) for i in range(n[0]) for j in range(n[1])], "i long, j long, v double")
    f = grid.Grid(df, (0.0, 0.0), ((n[0] - 1) * h[0], (n[1] - 1) * h[1]), n)
    c = grid.convolve(f, f)
    assert c.shape == (41, 33)
    got = np.zeros(c.shape)
    for r in c.df.collect():
        got[r.i, r.j] = r.v
    want = np.fft.irfft2(np.fft.rfft2(v, (41, 33)) ** 2, (41, 33)) * 0.0625
    assert np.allclose(got, want)
    with pytest.raises(TypeError):
        grid.divide(f, f)
    with pytest.raises(ValueError):
        grid.add(f, grid.translate(f, [0.1, 0.0]))
    lap = grid.laplacian(spark, [5, 4], [1.0, 0.5], [("dirichlet", "neumann"), ("periodic", "periodic")])
    k1 = np.diag([2.0, 2, 2, 2, 1]) - np.eye(5, k=1) - np.eye(5, k=-1)
    k2 = (2 * np.eye(4) - np.eye(4, k=1) - np.eye(4, k=-1)) * 4
    k2[0, 3] = k2[3, 0] = -4
    a = np.zeros((20, 20))
    for r in lap.collect():
        a[r.i, r.j] = r.v
    assert np.allclose(a, np.kron(k1, np.eye(4)) + np.kron(np.eye(5), k2))


def test_mosaic(spark):
    def make(lo, hi, n, fn):
        xs, ys = (np.linspace(a, b, m) for a, b, m in zip(lo, hi, n))
        return grid.Grid(spark.createDataFrame([(i, j, float(fn(x, y))) for i, x in enumerate(xs) for j, y in enumerate(ys)], "i long, j long, v double"), lo, hi, n)

    a = make((0.0, 0.0), (1.0, 1.0), (11, 11), lambda x, y: x + y if x < 0.55 else math.nan)
    b = make((0.0, 0.0), (2.0, 1.0), (21, 21), lambda x, y: 10.0)
    m = {(r.i, r.j): r.v for r in grid.mosaic([a, b]).df.collect()}
    assert len(m) == 21 * 11 and abs(m[3, 4] - 0.7) < 1e-9 and m[15, 5] == 10.0 and m[6, 0] == 10.0


def test_mesh_3d(spark):
    vertices, cells = mesh.box_mesh(spark, [0.0] * 3, [1.0, 2.0, 3.0], [3, 3, 3])
    assert mesh.check_mesh(vertices, cells).count() == 0
    assert abs(mesh.cell_volumes(cells, vertices, 3).agg(F.sum("vol")).first()[0] - 6) < 1e-12
    assert abs(mesh.mass_matrix(cells, vertices, 3).agg(F.sum("v")).first()[0] - 6) < 1e-12
    maps = mesh.affine_maps(cells, vertices, "cell_id")
    pts = spark.createDataFrame([(0, [0.3, 0.7, 1.1]), (1, [2.0, 1.0, 1.0]), (2, [-1.0, -1.0, -1.0])], "id long, p array<double>")
    q = {r.id: r.q for r in mesh.closest_points(pts, vertices, cells, maps, 3).collect()}
    assert np.allclose(q[0], [0.3, 0.7, 1.1]) and np.allclose(q[1], [1, 1, 1]) and np.allclose(q[2], [0, 0, 0])
    values = vertices.select(F.lit(0).alias("fn_id"), "v_id", (F.col("p")[0] + 2 * F.col("p")[2]).alias("value"))
    got = {r.id: r.value for r in mesh.evaluate(pts, maps, values, 3).collect()}
    assert abs(got[0] - 2.5) < 1e-12 and got[1] == 0


def test_low_rank(spark):
    a = 1.0 / (1 + np.add.outer(np.arange(60.0), np.arange(40.0)))
    t = coo(spark, a)
    rows_, cols_ = (spark.range(n).select(F.col("id").alias("i")) for n in a.shape)
    u, s, v = lowrank.random_svd(matrix.operator(t), matrix.operator(t, True), rows_, cols_, 5)
    assert np.allclose(s[:4], np.linalg.svd(a)[1][:4], rtol=1e-6)
    assert np.linalg.norm((rows(u) * s) @ rows(v).T - a) < 1e-2 * np.linalg.norm(a)
    x, y = lowrank.recompress(lowrank.times(u, np.diag(s)), v, 1e-2)
    assert np.linalg.norm(rows(x) @ rows(y).T - a) < 3e-2 * np.linalg.norm(a)
    assert abs(lowrank.norm_squared((x, y)) - np.linalg.norm(rows(x) @ rows(y).T) ** 2) < 1e-9
    pivots = lowrank.cross_full(t, 1e-2)
    px, py = lowrank.cross_factors(t, pivots)
    assert lowrank.cur_error(t, (px, py)) < 1.1e-2 and 3 <= len(pivots) <= 8
    b = np.outer(np.arange(1, 13), np.arange(1, 9)) + np.outer(np.ones(12), np.arange(8) ** 2)
    ax, ay = lowrank.alternate(coo(spark, b), 2, sweeps=6)
    assert np.linalg.norm(rows(ax) @ rows(ay).T - b) < 1e-3 * np.linalg.norm(b)
    table = lowrank.to_row_table(t.select("i", F.col("j").alias("k"), "v"), 40)
    _, s2, _ = lowrank.dense_svd(table, rtol=1e-3)
    assert np.allclose(s2, np.linalg.svd(a)[1][: len(s2)], rtol=1e-6)
    q, err = lowrank.range_finder(matrix.operator(t), cols_, 1e-3, 30)
    qq = rows(q)
    assert err < 1e-3 and np.linalg.norm(a - qq @ (qq.T @ a)) < 5e-3 * np.linalg.norm(a)


def test_conjugate_gradient(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(20, 20))
    a = m @ m.T + 20 * np.eye(20)
    b, x = rng.normal(size=20), None
    x, hist, code = iterate.conjugate_gradient(matrix.operator(coo(spark, a)), vec(spark, b), 1e-8, 40, known=vec(spark, np.linalg.solve(a, b)))
    assert code == 0 and np.allclose(dense(x, 20), np.linalg.solve(a, b), atol=1e-6) and hist[-1]["error"] < 1e-7
    w, u = np.linalg.eigh(a)
    got = iterate.lanczos(matrix.operator(coo(spark, a)), vec(spark, b), lambda t: 1 / np.sqrt(t), 15)
    assert np.allclose(dense(got, 20), u @ ((u.T @ b) / np.sqrt(w)), atol=1e-5)
    weights, poles = iterate.inverse_sqrt_rule(w[0], w[-1], 10)
    assert np.allclose(sum(c / (w - p) for c, p in zip(weights, poles)), 1 / np.sqrt(w), rtol=1e-8) and max(poles) < 0


def test_trust_region_parts():
    h, g = np.diag([1.0, 10.0, 100.0]), np.array([1.0, 1.0, 1.0])
    x, why, _ = iterate.cg_steihaug(lambda p: h @ p, g, tol=1e-12)
    assert why == "tolerance_achieved" and np.allclose(x, -g / np.diag(h))
    x, why, _ = iterate.cg_steihaug(lambda p: h @ p, g, radius=0.1)
    assert why == "exited_trust_region" and abs(np.linalg.norm(x) - 0.1) < 1e-12
    x, why, _ = iterate.cg_steihaug(lambda p: -h @ p, g, radius=2.0)
    assert why == "encountered_negative_curvature" and abs(np.linalg.norm(x) - 2) < 1e-12
    x, why, _ = iterate.cg_steihaug(lambda p: -h @ p, g)
    assert why == "encountered_negative_curvature" and not x.any()  # without a radius: the iterate before
    assert iterate.cg_steihaug(lambda p: h @ p, 0 * g)[0].tolist() == [0, 0, 0]
    assert iterate.cg_steihaug(lambda p: p * math.nan, g)[1] == "INF OR NAN"

    def rosen(x):
        return float((100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2).sum())

    def grad(x):
        g = np.zeros_like(x)
        g[:-1] = -400 * x[:-1] * (x[1:] - x[:-1] ** 2) - 2 * (1 - x[:-1])
        g[1:] += 200 * (x[1:] - x[:-1] ** 2)
        return g

    x0 = np.array([1.3, 0.7, 0.8, 1.9, 1.2])
    x, rec = iterate.lbfgs(rosen, grad, x0, rtol=1e-10)
    assert np.allclose(x, 1, atol=1e-6) and rec["reason"] == "converged" and rec["iterations"] < 60

    def hess(x, p):
        e = 1e-6
        return (grad(x + e * p) - grad(x - e * p)) / (2 * e)

    x, rec = iterate.trust_region(rosen, grad, hess, x0)
    assert np.allclose(x, 1, atol=1e-5)


def test_least_squares(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(size=300)
    df = spark.createDataFrame([(float(a), float(3 * np.exp(-2 * a))) for a in t], "t double, y double")

    def model(pdf, m):
        e = np.exp(m[1] * pdf["t"].to_numpy())
        return m[0] * e, np.stack([e, m[0] * pdf["t"].to_numpy() * e], 1)

    ls = iterate.LeastSquares(df, model, "y", 2)
    m, _ = iterate.trust_region(ls.cost, ls.gradient, ls.hessian, np.array([2.0, -1.0]), rtol=1e-9)
    assert np.allclose(m, [3, -2], atol=1e-6)


def test_curves_and_complex(spark):
    df = spark.createDataFrame([(e, float(t), 1.0 + e * t - 0.5 * t**3) for e in range(3) for t in range(6)], "entity long, t double, y double")
    got = {r.entity: r.c for r in curves.fit(df, 3).collect()}
    assert all(np.allclose(got[e], [1, e, 0, -0.5], atol=1e-8) for e in range(3))
    circle = spark.createDataFrame([([1.0, 0.0, -0.5], [0.0, 1.0])], "x array<double>, y array<double>")
    assert abs(curves.arc_length(circle, 0.0, 1.0, ["x", "y"]).first().length - (math.sqrt(2) + math.asinh(1)) / 2) < 1e-9
    z = spark.createDataFrame([(-1.0, 0.0)], "re double, im double").select(complexes.sqrt_cut(F.struct("re", "im"), 0.0).alias("w")).first().w
    assert abs(z.re) < 1e-12 and abs(z.im + 1) < 1e-12


def test_derivative_weights(spark):
    """The weights against complex waves at the points' own places, for a direction that isn't an axis."""
    rng = np.random.default_rng(9)
    p, way, k = rng.uniform(3, 4, size=(30, 2)), np.array([1.0, 2.0]), 8
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double")
    got = np.zeros((30, 30))
    for r in geofit.derivative_operator(df, tuple(way), k=k).collect():
        got[r.i, r.j] = r.v
    for i in range(30):
        dist = np.linalg.norm(p - p[i], axis=1)
        js = np.argsort(dist)[:k]
        lhs, rhs = [], []
        for length in np.linspace(2, 20, 4) * 2 * dist[js].max():
            for n in range(5):
                angle = np.arctan2(way[1], way[0]) + 2 * np.pi * n / 5
                wave = lambda x: np.exp(2j * np.pi / length * x @ [np.cos(angle), np.sin(angle)]) * length  # noqa: B023,E731
                lhs.append(wave(p[js]))
                rhs.append(2j * np.pi / length * (way @ [np.cos(angle), np.sin(angle)]) * wave(p[i]))
        lhs, rhs = np.array(lhs), np.array(rhs)
        a = np.concatenate([lhs.real, lhs.imag, 1e-8 * np.eye(k)])
        want = np.linalg.lstsq(a, np.concatenate([rhs.real, rhs.imag, np.zeros(k)]), rcond=None)[0]
        assert np.count_nonzero(got[i]) == k and np.allclose(got[i, js], want, rtol=1e-4, atol=1e-4 * np.abs(want).max())


def test_fits(spark):
    rng = np.random.default_rng(6)
    p = rng.uniform(size=(60, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double")
    q = rows(geofit.polynomial_basis(df, ["x", "y"], 2))
    assert np.allclose(q.T @ q, np.eye(6), atol=1e-8)
    d = geofit.derivative_operator(df, (1.0, 0.0), k=12)
    u = matrix.apply(d, vec(spark, np.sin(p[:, 0])))
    assert np.abs(dense(u, 60) - np.cos(p[:, 0])).mean() < 0.2
    at = p[:20]
    w = np.linalg.solve(np.exp(-((at[:, None] - at[None]) ** 2).sum(2) / 0.18), at[:, 0])
    c = spark.createDataFrame([(i, *map(float, r), float(x)) for i, (r, x) in enumerate(zip(at, w))], "id long, x double, y double, w double")
    got = {r.id: r.value for r in geofit.rbf_evaluate(df, c, ["x", "y"], 5.0, shape=0.3).collect()}
    assert np.allclose([got[i] for i in range(20)], at[:, 0], atol=1e-5)


def test_sources(spark, tmp_path):
    import struct
    import zlib

    px = bytes([0]) + bytes([0, 0, 0, 255, 255, 255]) + bytes([0]) + bytes([30, 60, 90, 0, 0, 0])
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(px)) + chunk(b"IEND", b""))
    got = {(r.i, r.j): r.v for r in readers.read_images(spark, str(tmp_path / "a.png")).collect()}
    assert got == {(0, 1): 0.0, (1, 1): 1.0, (0, 0): 60 / 255, (1, 0): 0.0}
    (tmp_path / "r.txt").write_text("1 2 3\n4 5 6\n")
    assert {(r.i, r.j): r.v for r in readers.read_raster(spark, str(tmp_path / "r.txt"), 3).collect()} == {(0, 2): 1, (0, 1): 2, (0, 0): 3, (1, 2): 4, (1, 1): 5, (1, 0): 6}
    readers.write_field(spark.range(4).withColumn("g", F.col("id") % 2), str(tmp_path / "out"), ["g"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def _clusters(rng, n, groups):
    return np.concatenate([rng.normal(c, 1e-3, (n // groups, 2)) for c in rng.random((groups, 2)) * 1e4])


@pytest.mark.parametrize("kind", ["clusters", "one place", "grid", "strings"])
def test_nearest_in_tiles(spark, kind):
    """Far clusters, a place with most points, ties, ids that are no numbers, queries far outside and repeated places."""
    from fieldspark.operators import knn

    rng = np.random.default_rng(5)
    x = {"clusters": _clusters(rng, 4000, 5), "one place": np.concatenate([np.ones((3000, 2)), rng.random((1200, 2))]), "grid": np.stack(np.divmod(np.arange(3000), 60), 1) // 2.0, "strings": rng.random((700, 2))}[kind]
    ids = rng.permutation(len(x)).tolist()
    asked = np.concatenate([x[:80], rng.random((20, 2)) * 3 - 1, np.full((2, 2), 1e5)])
    names = ids[:80] + [10**6 + i for i in range(22)]
    if kind == "strings":
        ids, names = [str(i) for i in ids], [str(i) for i in names]
    frame = lambda i, p: spark.createDataFrame([(a, float(b), float(c)) for a, (b, c) in zip(i, p)] + [(ids[0], None, 1.0)], f"id {'string' if kind == 'strings' else 'long'}, x double, y double")
    for k, others in ((1, True), (4, False)):
        got = sorted((r.q, r["rank"], r.id, r.dsq) for r in knn.nearest(frame(ids, x), frame(names, asked), ["x", "y"], k, others=others).collect())
        want = []
        for q, p in zip(names, asked):
            dsq = (x[:, 0] - p[0]) ** 2 + (x[:, 1] - p[1]) ** 2
            best = sorted((d, i) for d, i in zip(dsq.tolist(), ids) if not (others and i == q))[:k]
            want += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
        assert got == sorted(want)


def test_nearest_splits_hot_tiles(spark, monkeypatch):
    from fieldspark.operators import knn

    monkeypatch.setattr(knn, "ASKED", 50)
    x = np.random.default_rng(6).random((1500, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    got = knn.nearest(df, df, ["x", "y"], 2).where("rank = 1").collect()
    assert len(got) == 1500 and all(r.q == r.id and r.dsq == 0 for r in got)


@pytest.mark.parametrize("wide", [0.0, 0.02])
def test_range_join_ladder(spark, wide):
    """Some boxes a million times as wide as the others, some long and thin, some flat, some inside out."""
    from fieldspark.operators import spatial

    rng = np.random.default_rng(9)

    def boxes(n):
        c, w, k = rng.random((n, 2)) * 1000, rng.random((n, 2)), rng.random(n)
        w[k < wide] *= 1e6
        w[(k > 0.5) & (k < 0.5 + wide)] *= [1e5, 1]
        w[(k > 0.7) & (k < 0.72)] = 0
        w[k > 0.98] *= -1
        return np.concatenate([c - w, c + w], axis=1)

    a, b, p = boxes(700), boxes(500), rng.random((900, 2)) * 1000
    frame = lambda v, names: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, " + ", ".join(f"{n} double" for n in names))
    corners = ["xlo", "ylo", "xhi", "yhi"]
    A, B, P = frame(a, corners), frame(b, corners), frame(p, ["x", "y"])
    ok = lambda v: (v[:, 0] <= v[:, 2]) & (v[:, 1] <= v[:, 3])
    pairs = lambda df: sorted((r.l_id, r.r_id) for r in df.select("l_id", "r_id").collect())
    hit = np.all((p[:, None, :] >= a[None, :, :2]) & (p[:, None, :] <= a[None, :, 2:]), axis=2) & ok(a)
    assert pairs(spatial.points_in_boxes(P, ["x", "y"], A, corners[:2], corners[2:])) == sorted(zip(*(i.tolist() for i in np.nonzero(hit))))
    hit = np.all((a[:, None, :2] <= b[None, :, 2:]) & (b[None, :, :2] <= a[:, None, 2:]), axis=2) & ok(a)[:, None] & ok(b)
    assert pairs(spatial.boxes_overlap(A, B, corners[:2], corners[2:], salt=2)) == sorted(zip(*(i.tolist() for i in np.nonzero(hit))))
    side = spatial.Side(A, corners[:2], corners[2:])
    width, scales = spatial._survey(side)
    least = spatial._least(width, spatial.MAX_CELLS)
    cells = spatial._cells(side, "l_", width, least, spatial._codes(scales, least), [0], True).groupBy("l_id").count()
    assert cells.agg({"count": "max"}).first()[0] <= spatial.MAX_CELLS


def test_cross_partial(spark):
    """A Hilbert-like matrix through table copies: few rows looked at, none of the avoided ones, error within rtol."""
    from fieldspark.operators import cross

    a = 1.0 / (1 + np.add.outer(np.arange(60.0), np.arange(40.0)))
    ids = [spark.range(n).select(F.col("id").alias("i")) for n in a.shape]
    x, y, seen = cross.cross_partial(*cross.table_access(coo(spark, a)), *ids, 1e-2, required=3, avoid=spark.createDataFrame([(0,), (7,)], "i long"))
    assert np.linalg.norm(rows(x) @ rows(y).T - a) <= 1e-2 * np.linalg.norm(a)
    assert len(seen) < 15 and not {0, 7} & set(seen) and len(rows(x)[0]) <= 8
    zx, _, seen = cross.cross_partial(*cross.table_access(coo(spark, a).where("false")), *ids, 1e-2, required=3)
    assert len(rows(zx)[0]) == 0 and len(seen) == 3


def test_block_tree(spark):
    """The product over the block tree is the dense product; far blocks exist and near entries are few."""
    from fieldspark.operators import blocktree

    p = np.random.default_rng(3).random((600, 2)) * [50, 900]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i long, x double, y double")
    bell = lambda u, v: F.exp(-((u[0] - v[0]) * (u[0] - v[0]) / 900.0 + (u[1] - v[1]) * (u[1] - v[1]) / 90000.0))
    tree = blocktree.compress(df, ["x", "y"], bell, min_size=40, size=24)
    assert tree.inverses.count() > 10 and tree.near.count() < 0.6 * 600 * 600
    x = 1.0 + np.arange(600) % 3
    got = {r.i: r.v for r in blocktree.apply(tree, spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")).collect()}
    dense = np.exp(-((p[:, :1] - p[:, 0]) ** 2 / 900 + (p[:, 1:] - p[:, 1]) ** 2 / 90000)) @ x
    assert np.abs(np.array([got[i] for i in range(600)]) - dense).max() < 1e-4 * dense.max()


def test_shifted_solves(spark):
    """All shifts from one sequence, against numpy; an indefinite operator and too few steps raise."""
    from fieldspark.operators import iterate

    m = np.diag(np.arange(1.0, 13)) + np.diag(np.ones(11) * 0.4, 1) + np.diag(np.ones(11) * 0.4, -1)
    a, rhs = coo(spark, m), np.arange(12.0) - 3
    b = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rhs)], "i long, v double")
    shifts = [0.0, 0.5, 7.0]
    got = sorted(iterate.shifted_solves(matrix.operator(a), b, shifts, 1e-9).collect())
    for k, s in enumerate(shifts):
        assert np.allclose([r.xs[k] for r in got], np.linalg.solve(m + s * np.eye(12), rhs), atol=1e-7)
    with pytest.raises(RuntimeError, match="did not converge"):
        iterate.shifted_solves(matrix.operator(a), b, shifts, 1e-9, 3)
    with pytest.raises(RuntimeError, match="positive definite"):
        iterate.shifted_solves(matrix.operator(a), b, [-6.0], 1e-9)
