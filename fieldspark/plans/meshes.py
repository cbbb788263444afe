"""Queries of the simplex mesh operators: parts located in a structured mesh over their size and price."""

from pyspark.sql import functions as F

from ..operators import mesh
from ..operators.common import stored
from .base import query
from .views import table, view, with_views

LO, HI, SHAPE = [0.0, 0.0], [51.0, 1000.0], [18, 21]


def parts_mesh(spark):
    vertices, cells = mesh.box_mesh(spark, LO, HI, SHAPE)
    return vertices, cells, stored(mesh.affine_maps(mesh_points(cells, vertices), vertices, "cell_id"))


def mesh_points(cells, vertices):
    return cells.select("cell_id", "v")


def parts(spark, d):
    """Parts, every seventh of them moved out of the mesh."""
    x = F.col("x") + F.when(F.col("id") % 7 == 0, 40.0).otherwise(0.0)
    return view(spark, d, "pts2").select("id", F.array(x, F.col("y")).alias("p"))


_P = ", p AS (SELECT id, x + CASE WHEN id%7 = 0 THEN 40 ELSE 0 END AS x, y FROM pts2)"
_CELLS = """, c AS (SELECT (bi*20+bj)*2+k AS cell_id, bi, bj, k FROM (SELECT unnest(range(17)) AS bi), (SELECT unnest(range(20)) AS bj), (SELECT unnest(range(2)) AS k)),
    h AS (SELECT id, cell_id, bi, bj, k, (x-3*bi)/3 AS u, (y-50*bj)/50 AS w FROM p JOIN c ON x BETWEEN 3*bi AND 3*bi+3 AND y BETWEEN 50*bj AND 50*bj+50),
    l AS (SELECT id, min(cell_id) AS cell_id FROM h WHERE (k = 0 AND w <= u + 1e-12) OR (k = 1 AND u <= w + 1e-12) GROUP BY 1)"""


@query("""WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey%5 = 0 THEN [p_partkey, p_partkey+1] ELSE [p_partkey, p_partkey+1, p_partkey+p_size] END AS v FROM part),
    r AS (SELECT unnest(v) AS v_id FROM c),
    f AS (SELECT 'faulty' AS mesh, 'cell size' AS problem, count(*) AS n FROM c WHERE len(v) <> 3
        UNION ALL SELECT 'faulty', 'unknown vertex', count(*) FROM r WHERE v_id NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'no vertices', 'unknown vertex', count(*) FROM r UNION ALL SELECT 'no vertices', 'no vertices', 1 UNION ALL SELECT 'no cells', 'no cells', 1)
    SELECT mesh, problem, CAST(n AS BIGINT) AS n FROM f WHERE n > 0""")
def src3_check_mesh(spark, d):
    """All four faults: cells of the wrong size and unknown vertices among the parts, and meshes without vertices or cells."""
    p = table(spark, d, "part")
    k, third = F.col("p_partkey"), F.col("p_partkey") + F.col("p_size")
    vertices = p.select(k.alias("v_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("p"))
    cells = p.select(k.alias("cell_id"), F.when(k % 5 == 0, F.array(k, k + 1)).otherwise(F.array(k, k + 1, third)).alias("v"))
    meshes = {"faulty": (vertices, cells), "no vertices": (vertices.limit(0), cells), "no cells": (vertices, cells.limit(0))}
    parts = [mesh.check_mesh(v, c).select(F.lit(name).alias("mesh"), "problem", "n") for name, (v, c) in meshes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(with_views(["pts2"], """SELECT CAST(i*21+j AS BIGINT) AS v_id, i*3.0::DOUBLE AS x, j*50.0::DOUBLE AS y, count(id) AS n FROM (SELECT unnest(range(18)) AS i) CROSS JOIN (SELECT unnest(range(21)) AS j)
    LEFT JOIN pts2 ON pts2.x = i*3 AND pts2.y = j*50 GROUP BY 1, 2, 3"""))
def src4_parts_at_vertices(spark, d):
    """The structured mesh's vertices with the number of parts that lie on each."""
    vertices, _ = mesh.box_mesh(spark, LO, HI, SHAPE)
    at = view(spark, d, "pts2").select("x", "y", "id")
    return vertices.select("v_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).join(at, ["x", "y"], "left").groupBy("v_id", "x", "y").agg(F.count("id").alias("n"))


@query(with_views(["pts2"], _P + _CELLS + " SELECT id, CAST(cell_id AS BIGINT) AS cell_id FROM l"))
def loc1_locate(spark, d):
    return mesh.locate(parts(spark, d), parts_mesh(spark)[2], 2, tol=1e-12).select("id", "cell_id")


@query(with_views(["pts2"], _P + " SELECT id, x <= 51 AND y <= 1000 AS inside FROM p"))
def loc2_inside(spark, d):
    return mesh.inside(parts(spark, d), parts_mesh(spark)[2], 2).select("id", "inside")


def _values(vertices):
    x, y = F.col("p")[0], F.col("p")[1]
    fns = F.array(F.struct(F.lit(0).alias("fn_id"), (x + 2 * y).alias("value")), F.struct(F.lit(1).alias("fn_id"), (3 * x - y).alias("value")))
    return vertices.select("v_id", F.explode(fns).alias("e")).select("e.fn_id", "v_id", "e.value")


@query(with_views(["pts2"], _P + " SELECT id, fn_id, CASE WHEN x > 51 THEN 0 WHEN fn_id = 0 THEN round(x+2*y, 6) ELSE round(3*x-y, 6) END AS value FROM p, (SELECT CAST(unnest(range(2)) AS INT) AS fn_id)"))
def loc3_evaluate(spark, d):
    vertices, _, maps = parts_mesh(spark)
    got = mesh.evaluate(parts(spark, d), maps, _values(vertices), 2, functions=[0, 1])
    return got.withColumn("value", F.round("value", 6))


@query(with_views(["pts2"], _P + """, r AS (SELECT id, CASE WHEN x > 51 THEN 102-x ELSE x END AS x, y FROM p)
    SELECT id, fn_id, CASE WHEN fn_id = 0 THEN round(x+2*y, 5) ELSE round(3*x-y, 5) END AS value FROM r, (SELECT CAST(unnest(range(2)) AS INT) AS fn_id)"""))
def loc3_evaluate_reflected(spark, d):
    vertices, cells, maps = parts_mesh(spark)
    got = mesh.evaluate_reflected(parts(spark, d), vertices, cells, maps, _values(vertices), 2)
    return got.select("id", "fn_id", F.round("value", 5).alias("value"))


@query(with_views(["pts2"], _P + " SELECT id AS i, CAST(3 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS total, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE x <= 51"))
def loc4_observation_rows(spark, d):
    """The weights of each point's row sum to one and average the vertices to the point."""
    vertices, _, maps = parts_mesh(spark)
    m = mesh.observation_matrix(parts(spark, d), maps, 2).join(vertices, F.col("j") == F.col("v_id"))
    at = lambda k: F.round(F.sum(F.col("v") * F.col("p")[k]), 6)
    return m.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 9).alias("total"), at(0).alias("x"), at(1).alias("y"))


@query(with_views(["pts2"], _P + _CELLS + """, q AS (SELECT unnest(CASE k WHEN 0 THEN [bi*21+bj, bi*21+bj+21, bi*21+bj+22] ELSE [bi*21+bj, bi*21+bj+1, bi*21+bj+22] END) AS v FROM l JOIN c ON l.cell_id = c.cell_id)
    SELECT CAST(v AS BIGINT) AS vertex, CAST(row_number() OVER (ORDER BY v) - 1 AS BIGINT) AS j, count(*) AS n FROM q GROUP BY v"""))
def loc4_observation_matrix(spark, d):
    """The columns of the matrix without empty ones: old and new number, and entries."""
    m = mesh.observation_matrix(parts(spark, d), parts_mesh(spark)[2], 2, drop_empty=True)
    return m.groupBy("vertex", "j").agg(F.count(F.lit(1)).alias("n"))


@query(with_views(["pts2"], _P + _CELLS + """, q AS (SELECT DISTINCT c.bi, c.bj, c.k FROM l JOIN c ON l.cell_id = c.cell_id)
    SELECT DISTINCT CAST(unnest(CASE k WHEN 0 THEN [bi*21+bj, bi*21+bj+21, bi*21+bj+22] ELSE [bi*21+bj, bi*21+bj+1, bi*21+bj+22] END) AS BIGINT) AS v_id FROM q"""))
def agg12_influencing_vertices(spark, d):
    return mesh.influencing_vertices(mesh.locate(parts(spark, d), parts_mesh(spark)[2], 2, tol=1e-12))


def _triangles(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("cell_id"), F.array(F.col("o_custkey") % 400, 400 + F.col("o_orderkey") % 401, 801 + F.col("o_custkey") % 39).alias("v"))


_TRI = "WITH c AS (SELECT o_custkey%400 AS a, 400+o_orderkey%401 AS b, 801+o_custkey%39 AS c FROM orders), f AS (SELECT x, y FROM (SELECT a AS x, b AS y FROM c UNION ALL SELECT a, c FROM c UNION ALL SELECT b, c FROM c) GROUP BY 1, 2 HAVING count(*) = 1) "


@query(_TRI + "SELECT x, y FROM f")
def msh1_boundary_faces(spark, d):
    f = mesh.boundary_faces(_triangles(spark, d))
    return f.select(F.col("face")[0].alias("x"), F.col("face")[1].alias("y"))


@query(_TRI + "SELECT x AS a, CAST(-1 AS BIGINT) AS b FROM f UNION SELECT y, -1 FROM f UNION SELECT x, y FROM f")
def msh2_subfaces(spark, d):
    s, _ = mesh.subfaces(mesh.boundary_faces(_triangles(spark, d)))
    return s.select(F.get("subface", F.lit(0)).alias("a"), F.coalesce(F.get("subface", F.lit(1)), F.lit(-1).cast("long")).alias("b"))


@query(_TRI + "SELECT x AS v_id FROM f UNION SELECT y FROM f")
def msh3_boundary_vertices(spark, d):
    return mesh.boundary_vertices(mesh.boundary_faces(_triangles(spark, d)))


@query(with_views(["pts2"], _P + " SELECT id, round(least(x, 51), 6) AS x, round(y, 6) AS y FROM p"))
def jns6_closest_points(spark, d):
    vertices, cells, maps = parts_mesh(spark)
    got = mesh.closest_points(parts(spark, d), vertices, cells, maps, 2)
    return got.select("id", F.round(F.col("q")[0], 6).alias("x"), F.round(F.col("q")[1], 6).alias("y"))


@query(with_views(["pts2"], _P + " SELECT id, round(CASE WHEN x > 51 THEN 102-x ELSE x END, 6) AS x, round(y, 6) AS y FROM p"))
def prj11_reflect(spark, d):
    vertices, cells, maps = parts_mesh(spark)
    p = parts(spark, d)
    got = mesh.reflect(p, mesh.closest_points(p, vertices, cells, maps, 2))
    return got.select("id", F.round(F.col("p")[0], 6).alias("x"), F.round(F.col("p")[1], 6).alias("y"))


_T = """WITH t AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part),
    c AS (SELECT a.k AS cell_id, a.x AS x0, a.y AS y0, b.x-a.x AS ux, b.y-a.y AS uy, c.x-a.x AS wx, c.y-a.y AS wy FROM t a JOIN t b ON b.k = a.k+1 JOIN t c ON c.k = a.k+2),
    e AS (SELECT *, ux*wy-uy*wx AS det FROM c WHERE abs(ux*wy-uy*wx) > 1) """


@query(_T + """SELECT cell_id, round((wy*(30.137-x0)-wx*(1500.291-y0))/det, 4) AS b1, round((ux*(1500.291-y0)-uy*(30.137-x0))/det, 4) AS b2,
    round(1-(wy*(30.137-x0)-wx*(1500.291-y0))/det-(ux*(1500.291-y0)-uy*(30.137-x0))/det, 4) AS b0 FROM e""")
def prj10_affine_maps(spark, d):
    """Affine coordinates of one place, (30.137, 1500.291), in the triangle of each three neighbouring parts that isn't flat."""
    p = table(spark, d, "part")
    vertices = p.select(F.col("p_partkey").alias("v_id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("p"))
    cells = p.select(F.col("p_partkey").alias("cell_id"), F.array("p_partkey", F.col("p_partkey") + 1, F.col("p_partkey") + 2).alias("v"))
    flat = mesh.with_points(cells, vertices, "cell_id")
    u, w = ([F.col("ps")[k][i] - F.col("ps")[0][i] for i in range(2)] for k in (1, 2))
    solid = flat.where(F.abs(u[0] * w[1] - u[1] * w[0]) > 1).select("cell_id", "v")
    row = lambda k: F.round(F.col("a")[k][0] * 30.137 + F.col("a")[k][1] * 1500.291 + F.col("b")[k], 4).alias(f"b{k}")
    return mesh.affine_maps(solid, vertices, "cell_id").select("cell_id", *map(row, range(3)))


@query(with_views(["pts2"], """, c AS (SELECT floor(x/3) AS bi, floor(y/50) AS bj, count(*) AS n FROM pts2 GROUP BY 1, 2) SELECT round(sum(n*25.0*CASE
    WHEN bi IN (0, 17) AND bj IN (0, 20) THEN CASE WHEN (bi = 0) = (bj = 0) THEN 2 ELSE 1 END WHEN bi IN (0, 17) OR bj IN (0, 20) THEN 3 ELSE 6 END), 6) AS total FROM c"""))
def agg7_weighted_counts(spark, d):
    """Row lumps of the mass matrix at the lower-left vertex of each part's block, summed over the parts."""
    vertices, cells, _ = parts_mesh(spark)
    lumps = mesh.mass_lumps(cells, vertices, 2)
    at = view(spark, d, "pts2").select((F.floor(F.col("x") / 3) * 21 + F.floor(F.col("y") / 50)).cast("long").alias("v_id"))
    return at.join(lumps, "v_id").agg(F.round(F.sum("w"), 6).alias("total"))


@query(with_views(["pts2"], """, g AS (SELECT i, j, CAST(i AS DOUBLE) AS x, j*25.0::DOUBLE AS y FROM range(61) a(i), range(41) b(j)),
    n AS (SELECT floor(x/3) AS bi, floor(y/50) AS bj, count(*) AS n FROM pts2 GROUP BY 1, 2),
    h AS (SELECT *, least(floor(x/3), 16) AS bi, least(floor(y/50), 19) AS bj, x/3 - least(floor(x/3), 16) AS u, y/50 - least(floor(y/50), 19) AS w FROM g),
    e AS (SELECT h.*, coalesce(n0.n, 0) AS v00, coalesce(n1.n, 0) AS v10, coalesce(n2.n, 0) AS v01, coalesce(n3.n, 0) AS v11 FROM h LEFT JOIN n n0 ON n0.bi = h.bi AND n0.bj = h.bj
        LEFT JOIN n n1 ON n1.bi = h.bi+1 AND n1.bj = h.bj LEFT JOIN n n2 ON n2.bi = h.bi AND n2.bj = h.bj+1 LEFT JOIN n n3 ON n3.bi = h.bi+1 AND n3.bj = h.bj+1)
    SELECT i, j, x AS x0, y AS x1, CASE WHEN (x-25)*(x-25)/900 + (y-500)*(y-500)/250000 > 1 THEN -1.0 WHEN x > 51 THEN 0.0
        WHEN w <= u THEN round(v00*(1-u) + v10*(u-w) + v11*w, 6) ELSE round(v00*(1-w) + v01*(w-u) + v11*u, 6) END AS v FROM e"""))
def grd12_mesh_on_grid(spark, d):
    """Counts of parts by mesh vertex (of their block), interpolated on a finer grid with a disk mask."""
    vertices, cells, maps = parts_mesh(spark)
    counts = view(spark, d, "pts2").groupBy((F.floor(F.col("x") / 3) * 21 + F.floor(F.col("y") / 50)).cast("long").alias("v_id")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    values = vertices.select("v_id").join(counts, "v_id", "left").select("v_id", F.coalesce("value", F.lit(0.0)).alias("value"))
    mask = (F.col("x0") - 25) ** 2 / 900 + (F.col("x1") - 500) ** 2 / 250000 <= 1
    return mesh.grid_values(spark, [0.0, 0.0], [60.0, 1000.0], (61, 41), vertices, cells, maps, values, mask=mask, mask_fill=-1.0).withColumn("v", F.round("v", 6) + 0.0)
