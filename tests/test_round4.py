"""Results that must not change with the number of rows, of copies or of partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import clusters, geofit, ordering, spatial


@pytest.fixture
def small_samples(spark):
    """Range sorts whose bounds come from a part of the rows, as on large tables."""
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    spark.conf.set(key, "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset(key)
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_ranks_with_sampled_bounds(spark, small_samples):
    t = spark.range(20000).select("id", (F.xxhash64("id") % 1000).alias("x"), F.concat(F.lit("p"), F.col("id")).alias("p"))
    got = ordering.ranked(t.repartition(8), [F.col("x"), F.col("id")]).toPandas().sort_values(["x", "id"])
    assert (got["rank"].to_numpy() == np.arange(20000)).all()


def test_geometric_sort_with_sampled_bounds(spark, small_samples):
    rng = np.random.default_rng(5)
    p = rng.integers(0, 50, (6000, 2)).astype(float)
    t = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double").repartition(8)
    got = clusters.geometric_sort(t, ["x", "y"], finish=1024).toPandas().sort_values("place")
    assert (got["id"].to_numpy() == clusters._numpy_sort(p, np.arange(6000), 0)).all()


def test_copies_are_tested_once(spark):
    """Many points on few places and equal boxes, corners and ids out of order, against all pairs."""
    rng = np.random.default_rng(2)
    places, boxes = rng.integers(0, 6, (12, 2)).astype(float), rng.integers(0, 6, (5, 2)).astype(float)
    p, b = places[rng.integers(0, 12, 3000)], boxes[rng.integers(0, 5, 60)]
    points = spark.createDataFrame([(i if i else None, *map(float, r)) for i, r in enumerate(p)], "id long, x double, y double")
    held = spark.createDataFrame([(i, *map(float, r), *map(float, r + 2)) for i, r in enumerate(b)], "box long, x0 double, y0 double, x1 double, y1 double")
    seen = []

    def look(pairs):
        seen.append(pairs.count())
        return pairs

    got = spatial.points_in_boxes(points, ["x", "y"], held, ["x0", "y0"], ["x1", "y1"], then=look)
    hit = ((p[:, None] >= b[None]) & (p[:, None] <= b[None] + 2)).all(2)
    want = sorted((int(i) or -1, int(j)) for i, j in zip(*np.nonzero(hit)))
    assert sorted((-1 if r.l_id is None else r.l_id, r.r_box) for r in got.select("l_id", "r_box").collect()) == want
    assert seen[0] <= 60


def test_equal_ellipsoids(spark):
    """Copies of ellipsoids pair with each other and with all copies of what they meet."""
    rows = [(i, [float(i % 3) * 10, 0.0], [[1.0, 0.0], [0.0, 1.0]]) for i in range(30)]
    rows += [(100 + i, [1.0, 0.0], [[1.0, 0.0], [0.0, 1.0]]) for i in range(4)]
    e = spark.createDataFrame(rows, "ell_id long, mu array<double>, sigma array<array<double>>")
    got = {(r.a, r.b) for r in clusters.ellipsoid_pairs(e, 1.0).collect()}
    at = {r[0]: r[1][0] for r in rows}
    assert got == {(a, b) for a in at for b in at if a < b and abs(at[a] - at[b]) <= 2}


def test_radial_sums_once_a_place(spark, monkeypatch):
    """Points on one place share one sum over the centres, and each gets its row."""
    points = spark.createDataFrame([(i, float(i % 2), 0.0) for i in range(400)], "id long, x double, y double")
    centres = spark.createDataFrame([(7, 0.0, 0.0, 2.0), (8, 1.0, 0.0, 3.0), (9, 90.0, 0.0, 5.0)], "id long, x double, y double, w double")
    asked, plain = [], geofit.kernel_values
    monkeypatch.setattr(geofit, "kernel_values", lambda c, p, *a: asked.append(p.count()) or plain(c, p, *a))
    got = {r.id: r.value for r in geofit.rbf_evaluate(points, centres, ["x", "y"], 5.0, "gaussian", 1.0).collect()}
    e = np.exp(-0.5)
    assert asked == [2] and len(got) == 400 and np.allclose([got[0], got[1], got[399]], [2 + 3 * e, 3 + 2 * e, 3 + 2 * e])
