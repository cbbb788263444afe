"""Queries of gridded fields and sources."""

from pyspark.sql import functions as F

from ..operators import aggregates, clusters, grid, matrix, mesh  # noqa: F401
from ..sources import readers
from .base import query
from .views import grid_of, table, view, with_views

SHAPE, LO, HI = (30, 24), (0.0, 0.0), (29.0, 23.0)


def field(spark, d):
    """Events by day and hour as a field of unit spacing; hours without events have no row."""
    return grid.Grid(grid_of(view(spark, d, "grid2")), LO, HI, SHAPE)


def _full(name="g", body="coalesce(v, 0.0)"):
    return f", {name} AS (SELECT a.i, b.j, {body} AS v FROM (SELECT CAST(unnest(range(30)) AS BIGINT) AS i) a CROSS JOIN (SELECT CAST(unnest(range(24)) AS BIGINT) AS j) b LEFT JOIN grid2 ON grid2.i = a.i AND grid2.j = b.j)"


@query("""WITH c AS (SELECT event_type AS image, CAST(floor(epoch(ts)/86400) AS BIGINT) - 19723 AS i, CAST(floor(epoch(ts)/3600) AS BIGINT)%24 AS j, count(*)*40%256 AS v FROM events GROUP BY 1, 2, 3),
    p AS (SELECT image, CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT image FROM c) CROSS JOIN range(30) a(i) CROSS JOIN range(24) b(j) LEFT JOIN c USING (image, i, j))
    SELECT image, i, j, CASE WHEN max(v) OVER w > min(v) OVER w THEN round((v - min(v) OVER w)/(max(v) OVER w - min(v) OVER w), 9) ELSE 0 END AS v FROM p WINDOW w AS (PARTITION BY image)""")
def src1_images(spark, d):
    """Events by day and hour, an image for each type: drawn to PNG files, and those read as grids from 0 to 1."""
    from ..operators.common import scratch

    e = table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    cells = e.select(F.col("event_type").alias("image"), (F.floor(seconds / 86400) - 19723).alias("i"), (F.floor(seconds / 3600) % 24).alias("j"))
    path = scratch(spark, "images")
    readers.write_images(cells.groupBy("image", "i", "j").agg((F.count(F.lit(1)) * 40 % 256).alias("v")), path, 30, 24)
    name = F.regexp_extract("image", "/image=([^/]*)/[^/]*$", 1)
    return readers.read_images(spark, path + "/*/*").select(name.alias("image"), "i", "j", F.round("v", 9).alias("v"))


@query("""WITH t AS (SELECT o_orderkey, string_split(concat_ws(' ', o_orderkey, o_custkey, o_orderkey%10, o_custkey%10, 5, 7), ' ') AS w FROM orders)
    SELECT o_orderkey, CAST(n // 2 AS BIGINT) AS i, CAST(1 - n % 2 AS BIGINT) AS j, CAST(w[n+1] AS DOUBLE) AS v FROM t, (SELECT unnest(range(6)) AS n)""")
def src2_text_raster(spark, d):
    text = F.concat_ws(" ", "o_orderkey", "o_custkey", F.col("o_orderkey") % 10, F.col("o_custkey") % 10, F.lit(5), F.lit(7))
    return readers.raster_text(table(spark, d, "orders").select("o_orderkey", text.alias("t")), "t", 2)


@query(with_views(["pts2"], """, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts2)
    SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(x0+i*(x1-x0)/9, 9) AS x0, round(y0+j*(y1-y0)/19, 9) AS x1 FROM b, (SELECT unnest(range(10)) AS i), (SELECT unnest(range(20)) AS j)"""))
def src5_regular_grid(spark, d):
    b = aggregates.bounding_box(view(spark, d, "pts2"), ["x", "y"]).first()
    return grid.regular_grid(spark, [b.lo_0, b.lo_1], [b.hi_0, b.hi_1], (10, 20)).select("i", "j", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


@query(with_views(["coo"], "SELECT i, j, v FROM coo"))
def src6_rows_and_entries(spark, d):
    return matrix.from_rows(matrix.to_rows(view(spark, d, "coo")))


@query("""SELECT p_partkey AS v_id, CAST(p_size AS DOUBLE) AS a, CAST(p_partkey%7 AS DOUBLE) AS b, CAST(p_partkey%7 AS DOUBLE) AS second, CAST(p_size AS DOUBLE) AS back FROM part""")
def src7_components(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("v_id"), F.explode(F.array(F.struct(F.lit(1).alias("comp"), (F.col("p_partkey") % 7).cast("double").alias("value")), F.struct(F.lit(0).alias("comp"), F.col("p_size").cast("double").alias("value")))).alias("e")).select("v_id", "e.comp", "e.value")
    arrays = matrix.components_to_arrays(p)
    parts = matrix.deinterleave(F.col("values"), 2)
    return arrays.select("v_id", F.col("values")[0].alias("a"), F.col("values")[1].alias("b"), parts[1][0].alias("second"), matrix.interleave(parts)[0].alias("back"))


@query(with_views(["pts2"], "SELECT floor(x/10) AS cell, count(*) AS n, sum(y) AS total FROM pts2 GROUP BY 1"))
def src8_written_field(spark, d):
    """The parts written by cell and read back: each folder holds its cell."""
    from ..operators.common import scratch
    from ..sources.readers import write_field

    path = scratch(spark, "field")
    p = view(spark, d, "pts2").withColumn("cell", F.floor(F.col("x") / 10).cast("int"))
    write_field(p, path, by=["cell"])
    held = spark.read.parquet(path)
    return held.groupBy(F.col("cell").cast("double").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@query(with_views(["grid2"], "SELECT i, j, -(v*3)/2 AS v FROM grid2"))
def grd1_scale(spark, d):
    return grid.negate(grid.divide(grid.scale(field(spark, d), 3.0), 2.0)).df


@query(with_views(["grid2"], """SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sum(v) AS v FROM (SELECT i, j, v FROM grid2 UNION ALL SELECT i+5, j+3, 2*v FROM grid2
    UNION ALL SELECT a.i, b.j, 0.0 FROM (SELECT unnest(range(35)) AS i) a, (SELECT unnest(range(27)) AS j) b) GROUP BY 1, 2"""))
def grd2_union_sum(spark, d):
    f = field(spark, d)
    return grid.add(f, grid.translate(grid.scale(f, 2.0), [5.0, 3.0])).df


@query(with_views(["grid2"], "SELECT CAST(a.i-5 AS BIGINT) AS i, CAST(a.j-3 AS BIGINT) AS j, a.v*b.v AS v FROM grid2 a JOIN grid2 b ON a.i = b.i+5 AND a.j = b.j+3"))
def grd2_product(spark, d):
    f = field(spark, d)
    return grid.multiply(f, grid.translate(f, [5.0, 3.0])).df


_AT = ", p AS (SELECT id, x*0.62 AS px, y*0.0237 AS py FROM pts2)"
_LINEAR = """, c AS (SELECT *, px >= 0 AND px <= 29 AND py >= 0 AND py <= 23 AS inside, greatest(0, least(floor(px), 28)) AS i0, greatest(0, least(floor(py), 22)) AS j0 FROM p),
    o AS (SELECT * FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
    SELECT id, CASE WHEN inside THEN round(sum((CASE a WHEN 1 THEN px-i0 ELSE 1-(px-i0) END)*(CASE b WHEN 1 THEN py-j0 ELSE 1-(py-j0) END)*g.v), 9) ELSE 0.0 END AS v
    FROM c CROSS JOIN o JOIN g ON g.i = i0+a AND g.j = j0+b GROUP BY id, inside"""


def _points(spark, d):
    return view(spark, d, "pts2").select("id", (F.col("x") * 0.62).alias("px"), (F.col("y") * 0.0237).alias("py"))


@query(with_views(["grid2", "pts2"], _full() + _AT + _LINEAR))
def grd3_interpolate(spark, d):
    return grid.interpolate(field(spark, d), _points(spark, d), ["px", "py"]).withColumn("v", F.round("v", 9))


@query(with_views(["grid2", "pts2"], _full() + _AT + " SELECT id, CASE WHEN px <= 29 AND py <= 23 THEN g.v ELSE 0.0 END AS v FROM p JOIN g ON g.i = least(round(px), 29) AND g.j = least(round(py), 23)"))
def grd3_nearest(spark, d):
    return grid.interpolate(field(spark, d), _points(spark, d), ["px", "py"], method="nearest")


@query(with_views(["grid2", "pts2"], _full() + _AT + _LINEAR))
def grd4_interpolation_matrix(spark, d):
    f, p = field(spark, d), _points(spark, d)
    x = f.df.select((F.col("i") * SHAPE[1] + F.col("j")).alias("i"), "v")
    y = matrix.apply(grid.interpolation_matrix(f, p, ["px", "py"]), x)
    return p.select("id").join(y, F.col("id") == F.col("i"), "left").select("id", F.round(F.coalesce("v", F.lit(0.0)), 9).alias("v"))


@query(with_views(["grid2"], """SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, coalesce(v, 0.0) AS v FROM (SELECT unnest(range(35)) AS i) a CROSS JOIN (SELECT unnest(range(20)) AS j) b
    LEFT JOIN grid2 g ON g.i = a.i-2 AND g.j = b.j+1"""))
def grd5_restrict(spark, d):
    return grid.restrict(field(spark, d), [-2, 1], [32, 20]).df


@query(with_views(["grid2"], _full() + """ SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CASE WHEN g.i IS NOT NULL AND (least(a.i, 28)+least(b.j, 22))%5 NOT IN (0, 3, 4) THEN g.v ELSE h.v END AS v
    FROM (SELECT unnest(range(33)) AS i) a CROSS JOIN (SELECT unnest(range(26)) AS j) b LEFT JOIN g ON g.i = a.i AND g.j = b.j LEFT JOIN g h ON h.i = a.i-3 AND h.j = b.j-2"""))
def grd6_mosaic(spark, d):
    """A field with holes over the same field moved by (3, 2); null where neither has a value. A hole at any corner of a
    lattice cell makes the whole cell a hole, its own corner included."""
    f = field(spark, d)
    nan = F.lit(float("nan"))
    full = grid.restrict(f, [0, 0], [29, 23])
    holes = full.with_v(F.when((F.col("i") + F.col("j")) % 5 == 0, nan).otherwise(F.col("v")))
    other = grid.Grid(full.df, (3.0, 2.0), (32.0, 25.0), SHAPE)
    return grid.mosaic([holes, other]).df.select("i", "j", F.when(~F.isnan("v"), F.round("v", 9)).alias("v"))


@query(with_views(["grid2"], "SELECT CAST(29-i AS BIGINT) AS i, CAST(23-j AS BIGINT) AS j, v FROM grid2"))
def grd7_flip(spark, d):
    return grid.flip(grid.translate(field(spark, d), [1.0, 1.0])).df


@query(with_views(["grid2"], """SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sum(v) AS v FROM (SELECT a.i+b.i AS i, a.j+b.j AS j, a.v*b.v AS v FROM grid2 a, grid2 b WHERE b.i < 3 AND b.j < 4
    UNION ALL SELECT p.i, q.j, 0.0 FROM (SELECT unnest(range(32)) AS i) p, (SELECT unnest(range(27)) AS j) q) GROUP BY 1, 2"""))
def grd8_convolve(spark, d):
    f = field(spark, d)
    kernel = grid.Grid(f.df.where("i < 3 and j < 4"), (0.0, 0.0), (2.0, 3.0), (3, 4))
    return grid.convolve(f, kernel, checks=True).df


@query(with_views(["ell2"], """SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, CAST(count(ell_id) AS DOUBLE) AS v FROM (SELECT unnest(range(51)) AS i) a CROSS JOIN (SELECT unnest(range(101)) AS j) b
    LEFT JOIN ell2 ON (i-mx)**2*syy - 2*(i-mx)*(j*10-my)*sxy + (j*10-my)**2*sxx <= 4*(sxx*syy-sxy*sxy) GROUP BY 1, 2"""))
def grd9_rasterise(spark, d):
    return grid.rasterise(view(spark, d, "ell2"), spark, (0.0, 0.0), (50.0, 1000.0), (51, 101), tau=2.0).df


@query(with_views(["grid2"], _full() + """ SELECT CAST(a.i*24+a.j AS BIGINT) AS i, (CASE WHEN a.i = 0 THEN 1 ELSE 2 END)*a.v - coalesce(b.v, 0) - coalesce(c.v, 0) + 2*a.v - e.v - f.v AS v FROM g a
    LEFT JOIN g b ON b.i = a.i-1 AND b.j = a.j LEFT JOIN g c ON c.i = a.i+1 AND c.j = a.j JOIN g e ON e.i = a.i AND e.j = (a.j+1)%24 JOIN g f ON f.i = a.i AND f.j = (a.j+23)%24"""))
def grd10_laplacian(spark, d):
    lap = grid.laplacian(spark, list(SHAPE), [1.0, 1.0], [("neumann", "dirichlet"), ("periodic", "periodic")])
    x = grid.restrict(field(spark, d), [0, 0], [29, 23]).df.select((F.col("i") * 24 + F.col("j")).alias("i"), "v")
    return matrix.apply(lap, x)


#: Over a 5 x 3 frame the squares of the two coordinates sum to 7.5 and 10, so the points' second moments are those of the
#: covariance C times 4 * 10, less 4 * 2.5 times the larger eigenvalue's part, big * (C - small) / (big - small).
@query(with_views(["ell2"], """, e AS (SELECT *, (sxx+syy)/2 + sqrt((sxx-syy)**2/4+sxy**2) AS big, (sxx+syy)/2 - sqrt((sxx-syy)**2/4+sxy**2) AS small FROM ell2)
    SELECT ell_id, CAST(15 AS BIGINT) AS n, round(mx, 6) AS x, round(my, 6) AS y, round(40*sxx - 10*big*(sxx-small)/(big-small), 4) AS xx,
        round(40*sxy - 10*big*sxy/(big-small), 4) AS xy, round(40*syy - 10*big*(syy-small)/(big-small), 4) AS yy FROM e"""))
def grd14_local_frames(spark, d):
    """Number, mean and second moments of each ellipse's frame."""
    got = grid.local_frames(view(spark, d, "ell2"), (5, 3), 2.0)
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    moment = lambda a, b, name: F.round(F.sum(a * b), 4).alias(name)
    return got.groupBy("ell_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), moment(dx, dx, "xx"), moment(dx, dy, "xy"), moment(dy, dy, "yy"))


@query(with_views(["pts2", "ell2"], """, g AS (SELECT floor(x) AS i, floor(y/10) AS j, count(*) AS v FROM pts2 GROUP BY 1, 2),
    e AS (SELECT *, (sxx+syy)/2 AS mid, sqrt((sxx-syy)*(sxx-syy)/4 + sxy*sxy) AS dif, atan2(2*sxy, sxx-syy)/2 AS theta, sqrt(sxx*syy-sxy*sxy)*3.141592653589793*4 AS area FROM ell2),
    f AS (SELECT *, 2*sqrt(mid+dif)*(a/2-1) AS u, 2*sqrt(greatest(mid-dif, 0))*(b-1) AS w FROM e, (SELECT CAST(unnest(range(5)) AS INT) AS a), (SELECT CAST(unnest(range(3)) AS INT) AS b)),
    p AS (SELECT *, mx + u*cos(theta) - w*sin(theta) AS x, (my + u*sin(theta) + w*cos(theta))/10 AS y FROM f),
    c AS (SELECT *, x BETWEEN -1e-15 AND 51+1e-15 AND y*10 BETWEEN -1e-15 AND 1000+1e-15 AS inside, greatest(0, least(floor(x), 50)) AS i0, greatest(0, least(floor(y), 99)) AS j0 FROM p),
    o AS (SELECT * FROM range(2) k(k), range(2) l(l))
    SELECT ell_id, a, b, round(CASE WHEN inside THEN sum((CASE k WHEN 1 THEN x-i0 ELSE 1-(x-i0) END)*(CASE l WHEN 1 THEN y-j0 ELSE 1-(y-j0) END)*coalesce(g.v, 0)) ELSE 0 END/area, 9) + 0.0 AS v
    FROM c CROSS JOIN o LEFT JOIN g ON g.i = i0+k AND g.j = j0+l GROUP BY ell_id, a, b, inside, area"""))
def grd14_frame_samples(spark, d):
    """Part counts on a unit lattice of size by price, sampled in each ellipse's frame and divided by its area."""
    counts = view(spark, d, "pts2").groupBy(F.floor("x").alias("i"), F.floor(F.col("y") / 10).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    g = grid.Grid(counts, (0.0, 0.0), (51.0, 1000.0), (52, 101))
    e = view(spark, d, "ell2").where("abs(sxy) < 5").withColumn("area", F.sqrt(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")) * 3.141592653589793 * 4)
    return grid.sample_frames(grid.local_frames(e, (5, 3), 2.0), g, "ell_id", "area").withColumn("v", F.round("v", 9) + 0.0)


@query(with_views(["pts2"], """, p AS (SELECT DISTINCT x, y FROM pts2 WHERE x BETWEEN 5 AND 45 AND y BETWEEN 50 AND 950),
    s AS (SELECT coalesce(min(sqrt((a.x-b.x)**2+(a.y-b.y)**2)), 1.0)/0.25 AS h FROM p a JOIN p b ON a.x <> b.x OR a.y <> b.y),
    b AS (SELECT min(x) AS x0, min(y) AS y0, min(x)+h*ceil((max(x)-min(x))/h-1e-12) AS x1, min(y)+h*ceil((max(y)-min(y))/h-1e-12) AS y1 FROM p, s GROUP BY h)
    SELECT id, CASE WHEN x BETWEEN x0-1e-9 AND x1+1e-9 AND y BETWEEN y0-1e-9 AND y1+1e-9 THEN round(x+y, 6) ELSE 0 END AS v FROM pts2, b"""))
def grd13_grid_patch(spark, d):
    """A linear field on a lattice around the inner parts, read at all parts; zero outside."""
    from ..functions.geometry import in_box
    from ..operators.knn import smallest_spacing

    p = view(spark, d, "pts2")
    near = p.dropDuplicates(["x", "y"]).where(in_box([F.col("x"), F.col("y")], [5.0, 50.0], [45.0, 950.0]))
    step = smallest_spacing(near, ["x", "y"], F.lit(True)).first().spacing or 1.0
    lo, hi, shape = grid.grid_patch(near, ["x", "y"], step, 0.25)
    at = grid.regular_grid(spark, lo, hi, shape)
    got = grid.interpolate(grid.Grid(at.select("i", "j", (F.col("x0") + F.col("x1")).alias("v")), tuple(lo), tuple(hi), tuple(shape)), p, ["x", "y"])
    return got.select("id", F.round("v", 6).alias("v"))


@query(with_views(["grid2"], "SELECT sum(v) AS integral FROM grid2"))
def agg4_integral(spark, d):
    f = field(spark, d)
    return aggregates.integral(f.df, f.cell_volume)


@query(with_views(["grid2"], "SELECT sum(a.v*b.v) AS inner FROM grid2 a JOIN grid2 b ON a.i = b.i AND a.j = 23-b.j".replace("AS inner", 'AS "inner"')))
def agg5_inner_product(spark, d):
    f = field(spark, d)
    g = f.df.select("i", (23 - F.col("j")).alias("j"), "v")
    return aggregates.inner_product(f.df, g, ["i", "j"], f.cell_volume)


@query(with_views(["grid2"], "SELECT sum(v*(CASE WHEN i IN (0, 29) THEN 0.5 ELSE 1 END)*(CASE WHEN j IN (0, 23) THEN 0.5 ELSE 1 END)) AS integral FROM grid2"))
def agg6_mass_integral(spark, d):
    return aggregates.mass_integral(field(spark, d).df, ["i", "j"], list(SHAPE), [1.0, 1.0], trapezoid=True)
