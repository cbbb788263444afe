"""Work that grew faster than the tables (FINDINGS_r03.md, growth from 0.1 to 1 GB)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions import nested
from fieldspark.operators import iterate, knn, lowrank
from fieldspark.plans.streams import _with_timers
from fieldspark.streaming import streams


def test_reductions_work_out_every_leaf_once(spark):
    """A tree of four levels: each number is read once, and nulls and trees without leaves are as before."""
    t = T.ArrayType(T.DoubleType())
    for name in "abcd":
        t = T.StructType([T.StructField(name, t), T.StructField("v", T.DoubleType()), T.StructField("n", T.MapType(T.StringType(), T.ArrayType(T.LongType())))])
    leaf = lambda x, depth: x if not depth else {"abcd"[depth - 1]: leaf(x, depth - 1), "v": float(depth), "n": {"k": [depth, None], "l": None}}
    rows = [(1, leaf([0.5, None, 2.0], 4)), (2, leaf(None, 4)), (3, None), (4, {"d": None, "v": None, "n": {}})]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.LongType()), T.StructField("u", t)]))
    got = df.select("id", nested.total(F.col("u"), t).alias("s"), nested.norm(F.col("u"), t).alias("r"), nested.some(F.col("u"), t).alias("any"))
    want = {1: (22.5, (0.25 + 4 + 60) ** 0.5, True), 2: (20.0, 60**0.5, True), 3: (None, None, None), 4: (None, None, None)}
    for r in got.collect():
        s, n, some = want[r["id"]]
        assert r["s"] == s and r["any"] == some and (r["r"] == n or abs(r["r"] - n) < 1e-12)
    plan = df.select(nested.total(F.col("u"), t).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reduce(") + plan.count("aggregate(") == 1 and plan.count(".v") == 4


def test_linear_fits_read_their_rows_once(spark, monkeypatch):
    """A model with a constant Jacobian and an offset: one pass for a whole fit, with the values that passes of their own give."""
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=(2, 400))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, 7 + 2 * x - z + 0.1 * rng.normal(size=400))], "x double, z double, y double")

    def model(pdf, m):
        jac = np.stack([np.ones(len(pdf)), pdf["x"], pdf["z"]], 1)
        return 3 + jac @ m, jac

    passes = []
    monkeypatch.setattr(iterate, "row_sums", lambda *a, run=iterate.row_sums: passes.append(1) or run(*a))
    each, once = (iterate.LeastSquares(df, model, "y", 3, ridge=0.5, linear=k) for k in (False, True))
    for m in (np.zeros(3), np.array([1.0, -2.0, 0.5])):
        assert np.isclose(each.cost(m), once.cost(m)) and np.allclose(each.gradient(m), once.gradient(m)) and np.allclose(each.hessian(m, m + 1), once.hessian(m, m + 1))
    passes.clear()
    fit = iterate.LeastSquares(df, model, "y", 3, ridge=0.5, linear=True)
    m, record = iterate.lbfgs(fit.cost, fit.gradient, np.zeros(3), rtol=1e-9)
    a = np.stack([np.ones(400), x, z], 1)
    want = np.linalg.solve(a.T @ a + 0.5 * np.eye(3), a.T @ (np.array([r.y for r in df.collect()]) - 3))
    assert record["reason"] == "converged" and np.allclose(m, want, atol=1e-7) and len(passes) == 1


def test_episodes_of_many_series_share_groups(spark, tmp_path):
    """Forty series, one of them null, in two groups give the episodes that pandas finds."""
    rng = np.random.default_rng(8)
    at = np.sort(rng.integers(0, 30_000, 900)) * 1_000_000
    rows = [(None if k == 7 else int(k), int(t), float(v)) for k, t, v in zip(rng.integers(0, 40, 900), at, rng.random(900) * 10)]
    src = str(tmp_path / "in")
    schema = "series_id long, ts timestamp, y double"
    for n in range(3):
        part = spark.createDataFrame(rows[n * 300 : n * 300 + 300], "series_id long, t long, y double").selectExpr("series_id", "timestamp_micros(t) AS ts", "y")
        part.coalesce(1).write.parquet(f"{src}/part={n}")
    whole = _with_timers(spark).readStream.schema(schema).parquet(f"{src}/*")
    q = streams.crossing_episodes(whole, 5.0, 900, "0 seconds", groups=2).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())))
    pdf, want = pd.DataFrame(rows, columns=["k", "t", "y"]), []
    for k, g in pdf.groupby("k", dropna=False):
        for _, e in g.groupby((g["t"].diff() >= 900_000_000).cumsum()):
            if e["t"].max() + 900_000_000 < at.max():
                low = e["t"][e["y"] < 5]
                want.append(str((None if pd.isna(k) else int(k), int(e["t"].min()), int(e["t"].max()), int(low.min()) if len(low) else None)))
    assert got == sorted(want) and len(want) > 100


def test_full_pivoting_writes_lines_and_shuffles_no_entries(spark, monkeypatch):
    """The pivots of the plain rule on a matrix and its transpose, ties included; entries are stored as lines, once and again
    after every eight pivots."""
    rng = np.random.default_rng(9)
    m = np.round(rng.normal(size=(40, 12)), 1)
    m[5], m[7, 3], m[2, 8], m[30, 3] = 0.0, 9.0, -9.0, 9.0
    kept = []
    monkeypatch.setattr(lowrank, "stored", lambda df, keep=lowrank.stored: kept.append(df.columns) or keep(df))

    def plain(m):
        rest, out = m.copy(), []
        while np.linalg.norm(rest) > 1e-9 * np.linalg.norm(m):
            i, j = np.unravel_index(np.abs(rest).argmax(), m.shape)
            out.append((int(i), int(j)))
            rest = rest - rest[i][None, :] * rest[:, j][:, None] / rest[i, j]
        return out

    for a in (m, m.T):
        kept.clear()
        rows = [(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
        got = lowrank.cross_full(spark.createDataFrame(rows, "i long, j long, v double").repartition(3), 1e-9)
        assert got == plain(a) and len(got) == 12
        assert kept == [["line", "p", "v"]] * 2
    assert lowrank.cross_full(spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0)], "i long, j long, v double"), 1e-9) == []


def test_tiles_keep_few_points_of_a_place():
    """Of 400 copies of a place a tile holds those that can be an answer, and the nearest are those of all points."""
    rng = np.random.default_rng(10)
    places = rng.integers(0, 6, (25, 2)).astype(float)
    x = places[rng.integers(0, 25, 10_000)]
    ids = rng.permutation(10_000)
    asked = rng.integers(0, 60, (50, 2)) / 10.0
    tile = knn.Tile(ids, x, 3)
    assert len(tile.ids) == 3 * len(np.unique(x, axis=0))
    rows, at, dsq = tile.nearest(asked, None, 3)
    for r in range(50):
        far = ((x - asked[r]) ** 2).sum(axis=1)
        want = np.lexsort((ids, far))[:3]
        assert tile.ids[at[rows == r]].tolist() == ids[want].tolist() and np.allclose(dsq[rows == r], far[want])
