"""Simplex meshes as tables: vertices (v_id, p) and cells (cell_id, v); point location, closest points, interpolation."""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .knn import nearest
from .ordering import powerset
from .spatial import Side, balls_meet_boxes, range_join


def _part(i: int):
    """The i-th coordinate, as a function of one argument."""
    return lambda p: p[i]


def check_mesh(vertices: DataFrame, cells: DataFrame) -> DataFrame:
    """(problem, n) of each kind of fault that occurs: empty tables, cells of the wrong size, unknown vertices."""
    dim = vertices.select(F.size("p").alias("d")).agg(F.max("d").alias("d"))
    wrong = cells.join(F.broadcast(dim), F.size("v") != F.col("d") + 1).agg(F.count(F.lit(1)).alias("n")).select(F.lit("cell size").alias("problem"), "n")
    unknown = cells.select(F.explode("v").alias("v_id")).join(vertices, "v_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown vertex").alias("problem"), "n")
    none = lambda df, name: df.agg(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("n")).select(F.lit(name).alias("problem"), "n")
    return reduce(DataFrame.union, [wrong, unknown, none(vertices, "no vertices"), none(cells, "no cells")]).where("n > 0")


def box_mesh(spark: SparkSession, lo: list[float], hi: list[float], shape: list[int]) -> tuple[DataFrame, DataFrame]:
    """Structured mesh of a box with `shape` vertices an axis, d = 1, 2 or 3; each block splits into d! simplices."""
    d = len(shape)
    if d not in (1, 2, 3):
        raise ValueError("only 1, 2 or 3 dimensions")
    strides = [math.prod(shape[k + 1 :]) for k in range(d)]
    index = lambda n, sizes: [(F.floor(n / math.prod(sizes[k + 1 :])) % sizes[k]) for k in range(d)]
    at = index(F.col("id"), shape)
    p = F.array(*(F.when(i == n - 1, F.lit(float(b))).otherwise(F.lit(float(a)) + i * ((b - a) / (n - 1))) for i, a, b, n in zip(at, lo, hi, shape)))
    vertices = spark.range(math.prod(shape)).select(F.col("id").alias("v_id"), p.alias("p"))
    blocks = [n - 1 for n in shape]
    base = reduce(lambda x, y: x + y, [i * s for i, s in zip(index(F.col("id"), blocks), strides)]).cast("long")
    templates = []
    for order in permutations(range(d)):
        path, here = [0], 0
        for axis in order:
            here += strides[axis]
            path.append(here)
        templates.append(path)
    made = spark.range(math.prod(blocks)).select(F.col("id").alias("b"), base.alias("base"), F.posexplode(F.array(*(F.array(*(F.lit(x).cast("long") for x in t)) for t in templates))).alias("k", "t"))
    return vertices, made.select((F.col("b") * len(templates) + F.col("k")).alias("cell_id"), F.transform("t", lambda x: x + F.col("base")).alias("v"))


def with_points(simplices: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """Simplices (key, v) with `ps`, the coordinates of their vertices in order; those with unknown vertices are left out."""
    rows = simplices.select(key, "v", F.posexplode("v").alias("_n", "v_id")).join(vertices, "v_id")
    return rows.groupBy(key, "v").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "p"))), lambda s: s["p"]).alias("ps")).where(F.size("ps") == F.size("v"))


def affine_maps(simplices: DataFrame, vertices: DataFrame, key: str, feet: bool = False) -> DataFrame:
    """(key, v, lo, hi, a, b): box and the map a p + b to affine coordinates (least squares for lower-dimensional simplices).

    a is a list of rows, one a vertex; feet=True adds `m`, one list of dim rows of the map and its offsets (zeros
    for missing vertices), then of the map p -> foot, the point with those coordinates, and its offset. Batched small solves over the simplex table, to be stored once.
    """

    def solve(batches):
        for pdf in batches:
            for n, part in pdf.groupby(pdf["v"].map(len)):
                x = np.array([[list(p) for p in ps] for ps in part["ps"]], float)  # (cells, n, d)
                if n == 1:
                    a, b = np.zeros((len(x), 1, x.shape[2])), np.ones((len(x), 1))
                else:
                    edges = (x[:, 1:] - x[:, :1]).transpose(0, 2, 1)
                    inv = np.linalg.pinv(edges)
                    a = np.concatenate([-inv.sum(1, keepdims=True), inv], axis=1)
                    b = -np.einsum("nij,nj->ni", a, x[:, 0])
                    b[:, 0] += 1
                out = {key: part[key].to_numpy(), "v": part["v"].to_numpy(), "lo": x.min(1).tolist(), "hi": x.max(1).tolist(), "a": a.tolist(), "b": b.tolist()}
                if feet:
                    d = x.shape[2]
                    full = [np.pad(a, [(0, 0), (0, d - n), (0, 0)]), np.pad(b, [(0, 0), (0, d - n)]), np.einsum("nji,njk->nik", x, a), np.einsum("nji,nj->ni", x, b)]
                    out["m"] = np.concatenate([f.reshape(len(x), -1) for f in full], axis=1).tolist()
                yield pd.DataFrame(out)

    rows = with_points(simplices, vertices, key)
    return rows.mapInPandas(solve, f"{key} {dict(rows.dtypes)[key]}, v array<long>, lo array<double>, hi array<double>, a array<array<double>>, b array<double>" + ", m array<double>" * feet)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _affine(a: Column, b: Column, p: Column) -> Column:
    return F.zip_with(a, b, lambda row, c: _dot(row, p) + c)


def _flat(df: DataFrame, dim: int, lo: str = "lo", hi: str = "hi") -> Side:
    held = df.select("*", *(F.col(lo)[i].alias(f"_lo{i}") for i in range(dim)), *(F.col(hi)[i].alias(f"_hi{i}") for i in range(dim)))
    return Side(held, [f"_lo{i}" for i in range(dim)], [f"_hi{i}" for i in range(dim)])


def locate(points: DataFrame, maps: DataFrame, dim: int, key: str = "id", tol: float = 0.0) -> DataFrame:
    """(key, cell_id, v, bary) of every point inside the mesh: the smallest cell id whose coordinates are all >= -tol.

    points: (key, p). Points outside have no row (a left join gives null cells).
    """
    pts = points.select(F.col(key).alias("q"), F.col("p"), *(F.col("p")[i].alias(f"_p{i}") for i in range(dim)))
    bary = _affine(F.col("r_a"), F.col("r_b"), F.col("l_p"))
    near = range_join(Side.points(pts, [f"_p{i}" for i in range(dim)]), _flat(maps, dim), F.lit(True)).withColumn("bary", bary)
    near = near.where(F.forall("bary", lambda x: x >= -tol))
    first = near.groupBy(F.col("l_q").alias(key)).agg(F.min(F.struct(F.col("r_cell_id").alias("cell_id"), F.col("r_v").alias("v"), "bary")).alias("m"))
    return first.select(key, "m.cell_id", "m.v", "m.bary")


def inside(points: DataFrame, maps: DataFrame, dim: int, key: str = "id", tol: float = 1e-12) -> DataFrame:
    """points with a boolean column `inside`; tol keeps points on edges between cells inside whatever the rounding."""
    hit = locate(points, maps, dim, key, tol).select(key, F.lit(True).alias("inside"))
    return points.join(hit, key, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def boundary_faces(cells: DataFrame) -> DataFrame:
    """(face): sorted vertex lists of the faces that belong to exactly one cell."""
    faces = cells.select(F.explode(F.transform("v", lambda x: F.array_sort(F.filter("v", lambda y: y != x)))).alias("face"))
    return faces.groupBy("face").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("face")


def subfaces(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct non-empty sub-faces of faces, and the relation (face, subface)."""
    relation = faces.select("face", F.explode(powerset(F.col("face"))).alias("subface")).where(F.size("subface") > 0)
    return relation.select("subface").distinct(), relation


def boundary_vertices(faces: DataFrame) -> DataFrame:
    return faces.select(F.explode("face").alias("v_id")).distinct()


def influencing_vertices(located: DataFrame) -> DataFrame:
    """Distinct vertices of the cells that hold the located points."""
    return located.select(F.explode("v").alias("v_id")).distinct()


def closest_points(points: DataFrame, vertices: DataFrame, cells: DataFrame, maps: DataFrame, dim: int, key: str = "id") -> DataFrame:
    """(key, q): the closest point of the mesh; points inside are their own.

    Outside points: the nearest boundary vertex bounds the search, boundary faces whose boxes meet that ball give their
    sub-faces, and the best projection with non-negative affine coordinates wins (ties: the smaller sub-face).
    """
    pts = points.select(F.col(key).alias("id"), "p")
    marked = stored(inside(pts, maps, dim))
    out = marked.where("not inside").select("id", "p", *(F.col("p")[i].alias(f"x{i}") for i in range(dim)))
    faces = stored(boundary_faces(cells).select(F.monotonically_increasing_id().alias("face_id"), "face"))
    axes = [f"x{i}" for i in range(dim)]
    corners = boundary_vertices(faces).join(vertices, "v_id").select(F.col("v_id").alias("id"), *(F.col("p")[i].alias(f"x{i}") for i in range(dim)))
    radius = nearest(corners, out, axes, 1).select(F.col("q").alias("id"), (F.sqrt("dsq") * (1 + 1e-14)).alias("r"))
    balls = out.join(radius, "id")
    # Every face with its box and the maps of its sub-faces, numbered by face and place.
    many = 1 << dim
    parts = faces.select("face_id", F.posexplode(powerset(F.col("face"))).alias("k", "v")).where(F.size("v") > 0).select((F.col("face_id") * many + F.col("k")).alias("sub_id"), "v")
    maps = affine_maps(parts, vertices, "sub_id", feet=True).withColumn("face_id", F.floor(F.col("sub_id") / many))
    faces = stored(maps.groupBy("face_id").agg(F.collect_list(F.struct("v", "m")).alias("subs"), *(F.max_by(c, F.size("v")).alias(c) for c in ("lo", "hi"))))
    boxes = faces.select("face_id", *(F.col(c)[i].alias(f"{c}{i}") for c in ("lo", "hi") for i in range(dim)))
    pairs = balls_meet_boxes(balls, axes, "r", boxes, [f"lo{i}" for i in range(dim)], [f"hi{i}" for i in range(dim)])
    pairs = pairs.select(F.col("l_id").alias("id"), *(F.col("l_" + x).alias(x) for x in axes), F.col("r_face_id").alias("face_id")).join(faces.select("face_id", "subs"), "face_id")
    row = lambda m, at: sum((m[at * dim + i] * F.col(x) for i, x in enumerate(axes)), F.lit(0.0))
    tried = []
    for k in range(many - 1):
        m = F.get(F.col("subs"), F.lit(k))["m"]
        bary = [row(m, j) + m[dim * dim + j] for j in range(dim)]
        foot = [row(m, dim + 1 + j) + m[(2 * dim + 1) * dim + j] for j in range(dim)]
        dsq = sum(((f - F.col(x)) * (f - F.col(x)) for f, x in zip(foot, axes)), F.lit(0.0))
        tried.append(F.when(reduce(and_, [c >= 0 for c in bary]), F.struct(dsq.alias("dsq"), F.get(F.col("subs"), F.lit(k))["v"].alias("v"), F.array(*foot).alias("foot"))))
    closest = F.least(*tried) if len(tried) > 1 else tried[0]
    best = pairs.select("id", closest.alias("m")).where("m is not null").groupBy("id").agg(F.min("m").alias("m")).select("id", F.col("m.foot").alias("q"))
    return marked.where("inside").select("id", F.col("p").alias("q")).union(best).withColumnRenamed("id", key)


def reflect(points: DataFrame, closest: DataFrame, key: str = "id") -> DataFrame:
    """(key, p): p + 2 (q - p); inside points stay, being their own closest points."""
    return points.join(closest, key).select(key, F.zip_with("p", "q", lambda p, q: p + 2 * (q - p)).alias("p"))


def evaluate(points: DataFrame, maps: DataFrame, values: DataFrame, dim: int, key: str = "id", functions: list | None = None, tol: float = 1e-12) -> DataFrame:
    """(key, fn_id, value): piecewise linear functions (fn_id, v_id, value) at points; 0 outside the mesh."""
    weights = locate(points, maps, dim, key, tol).select(key, F.posexplode("v").alias("n", "v_id"), "bary").select(key, "v_id", F.element_at("bary", F.col("n") + 1).alias("w"))
    sums = weights.join(values, "v_id").groupBy(key, "fn_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    ids = functions if functions is not None else [r.fn_id for r in values.select("fn_id").distinct().collect()]
    full = points.select(key, F.explode(F.array(*map(F.lit, ids))).alias("fn_id"))
    return full.join(sums, [key, "fn_id"], "left").select(key, "fn_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def evaluate_reflected(points: DataFrame, vertices: DataFrame, cells: DataFrame, maps: DataFrame, values: DataFrame, dim: int, key: str = "id") -> DataFrame:
    """As evaluate, with points outside mirrored once across the boundary."""
    return evaluate(reflect(points, closest_points(points, vertices, cells, maps, dim, key), key), maps, values, dim, key)


def observation_matrix(points: DataFrame, maps: DataFrame, dim: int, key: str = "id", drop_empty: bool = False) -> DataFrame:
    """(i, j, v): basis weights of points (rows) at vertices; outside points have no entries.

    drop_empty renumbers the columns that occur from 0 in order of their vertex (column `vertex` keeps the old id).
    """
    w = locate(points, maps, dim, key, 1e-12).select(F.col(key).alias("i"), F.posexplode("v").alias("n", "j"), "bary").select("i", "j", F.element_at("bary", F.col("n") + 1).alias("v"))
    if not drop_empty:
        return w
    from .ordering import ranked

    names = ranked(w.select(F.col("j").alias("vertex")).distinct(), [F.col("vertex")], "col")
    return w.join(names, F.col("j") == F.col("vertex")).select("i", F.col("col").alias("j"), "v", "vertex")


def cell_volumes(cells: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """(cell_id, v, vol) for simplices of full dimension, d = 1, 2 or 3."""
    rows = with_points(cells, vertices, "cell_id")
    e = [[F.col("ps")[i + 1][j] - F.col("ps")[0][j] for j in range(dim)] for i in range(dim)]
    if dim == 1:
        det = e[0][0]
    elif dim == 2:
        det = e[0][0] * e[1][1] - e[0][1] * e[1][0]
    else:
        det = sum((e[0][k] * (e[1][(k + 1) % 3] * e[2][(k + 2) % 3] - e[1][(k + 2) % 3] * e[2][(k + 1) % 3]) for k in range(3)), F.lit(0.0))
    return rows.select("cell_id", "v", (F.abs(det) / math.factorial(dim)).alias("vol"))


def mass_matrix(cells: DataFrame, vertices: DataFrame, dim: int) -> DataFrame:
    """(i, j, v): consistent mass matrix of piecewise linear functions."""
    pairs = cell_volumes(cells, vertices, dim).select("vol", "v", F.explode("v").alias("i")).select("vol", "i", F.explode("v").alias("j"))
    w = F.col("vol") * F.when(F.col("i") == F.col("j"), 2.0).otherwise(1.0) / ((dim + 1) * (dim + 2))
    return pairs.groupBy("i", "j").agg(F.sum(w).alias("v"))


def mass_lumps(cells: DataFrame, vertices: DataFrame, dim: int, kind: str = "rows") -> DataFrame:
    """(v_id, w): row sums of the mass matrix, or its diagonal (kind="diagonal")."""
    part = 1 / (dim + 1) if kind == "rows" else 2 / ((dim + 1) * (dim + 2))
    return cell_volumes(cells, vertices, dim).select("vol", F.explode("v").alias("v_id")).groupBy("v_id").agg((F.sum("vol") * part).alias("w"))


def grid_values(spark: SparkSession, lo, hi, shape, vertices: DataFrame, cells: DataFrame, maps: DataFrame, values: DataFrame, fill: float = 0.0, reflected: bool = False, mask: Column | None = None, mask_fill: float = 0.0) -> DataFrame:
    """A mesh function (one fn_id) on a regular grid: (i, j, .., x0, .., v); outside the mesh `fill`, or the mirrored
    value; where `mask` (a predicate of x0, x1, ..) is false, mask_fill."""
    from .grid import AXES, regular_grid

    dim = len(shape)
    names = list(AXES[:dim])
    pts = regular_grid(spark, lo, hi, shape).withColumn("id", reduce(lambda x, y: x + y, [F.col(a) * math.prod(shape[k + 1 :]) for k, a in enumerate(names)]))
    asked = pts.select("id", F.array(*(f"x{d}" for d in range(dim))).alias("p"))
    if reflected:
        asked = reflect(asked, closest_points(asked, vertices, cells, maps, dim))
    got = locate(asked, maps, dim, tol=1e-12).select("id", F.posexplode("v").alias("n", "v_id"), "bary").select("id", "v_id", F.element_at("bary", F.col("n") + 1).alias("w"))
    sums = got.join(values, "v_id").groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("_v"))
    v = F.coalesce("_v", F.lit(fill))
    out = pts.join(sums, "id", "left").withColumn("v", F.when(mask, v).otherwise(F.lit(mask_fill)) if mask is not None else v)
    return out.drop("id", "_v")
