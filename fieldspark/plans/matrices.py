"""Queries of sparse, patch and low-rank matrices over the order lines (parts by suppliers)."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates, blocktree, composite, cross, geofit, lowrank, matrix
from ..operators.common import stored
from .base import query
from .views import table, view, with_views


def _coo(spark, d):
    return view(spark, d, "coo")


def _tall(spark, d):
    """The embeddings as a matrix with one row a vector."""
    return view(spark, d, "vecs").select(F.col("id").alias("i"), F.col("p").cast("array<double>").alias("row"))


@query(with_views(["coo"], "SELECT i, sum(v*(j%10)) AS v FROM coo GROUP BY 1"))
def mat1_product(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 10).cast("double").alias("v"))
    return matrix.apply(_coo(spark, d), x)


@query(with_views(["coo"], "SELECT j AS i, k, sum(v*(i%(k+3))) AS v FROM coo, (SELECT CAST(unnest(range(2)) AS INT) AS k) GROUP BY 1, 2"))
def mat1_transpose_product(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).withColumn("v", (F.col("i") % (F.col("k") + 3)).cast("double"))
    return matrix.apply(_coo(spark, d), x, transpose=True)


def _off(q):
    """One row: the largest entry of |Q'Q - I| over the columns of a row table; null without rows, one for zeros."""
    pairs = q.select(F.posexplode("row").alias("k", "x"), "row").select("k", "x", F.posexplode("row").alias("l", "y"))
    g = pairs.groupBy("k", "l").agg(F.sum(F.col("x") * F.col("y")).alias("v"))
    return g.agg((F.round(F.max(F.abs(F.col("v") - (F.col("k") == F.col("l")).cast("double"))), 6) + 0.0).alias("off"))


def _with_off(product, q):
    """The product (i, v), and on every row how far the basis q is from orthonormal."""
    return product.select("i", F.round("v", 3).alias("v"), F.lit(_off(q).first()["off"]).alias("off"))


@query("SELECT vec_id AS i, round(list_sum(CAST(embedding AS DOUBLE[])), 3) AS v, CAST(0 AS DOUBLE) AS off FROM embeddings")
def mat2_truncated_svd(spark, d):
    """U S V' of the embeddings times ones, and how far U is from orthonormal."""
    u, s, v = lowrank.dense_svd(_tall(spark, d), rtol=1e-9)
    return _with_off(lowrank.times(u, (s * v.sum(axis=1))[:, None]).select("i", F.col("row")[0].alias("v")), u)


def _ids(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("i"))
    cols = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"))
    return rows, cols


def _known(spark, d):
    """Factors, by remainders of the ids, of a matrix of rank 4 over all parts and suppliers."""
    rows, cols = _ids(spark, d)
    i, j = F.col("i"), F.col("i")
    real = lambda *c: F.array(*(x.cast("double") for x in c)).alias("row")
    return rows.select("i", real(F.lit(1), i % 7, i % 3, (i % 5) * (i % 2))), cols.select("i", real(j % 5, F.lit(1), j % 4, j % 3))


def _known_operators(spark, d):
    """That matrix and its transpose as functions of tables."""
    f, g = map(stored, _known(spark, d))
    return lowrank.Factored(f, g), lowrank.Factored(g, f)


def _tens(spark, d):
    return _ids(spark, d)[1].withColumn("v", (F.col("i") % 10).cast("double"))


#: The matrix times the last digits of the suppliers' keys; entry: an expression over its entries a.
_KNOWN = """WITH e AS (SELECT p_partkey AS i, s_suppkey AS j, CAST(s_suppkey%5 + p_partkey%7 + (p_partkey%3)*(s_suppkey%4) + (p_partkey%5)*(p_partkey%2)*(s_suppkey%3) AS DOUBLE) AS a FROM part, supplier)
    SELECT i, sum({entry}*(j%10)) AS v{off} FROM e GROUP BY 1"""
_AND_OFF = ", CAST(0 AS DOUBLE) AS off"


@query(_KNOWN.format(entry="a", off=_AND_OFF))
def mat3_random_svd(spark, d):
    """U S V' times a vector, and how far U is from orthonormal."""
    u, s, v = lowrank.random_svd(*_known_operators(spark, d), *_ids(spark, d), rank=4)
    u, v = stored(u), stored(v)
    return _with_off(lowrank.matvec((lowrank.times(u, np.diag(s)), v), _tens(spark, d)), u)


@query(_KNOWN.format(entry="a", off=_AND_OFF))
def mat4_range_finder(spark, d):
    """Q Q' A times a vector, and how far Q is from orthonormal."""
    forward, _ = _known_operators(spark, d)
    q = stored(lowrank.range_finder(forward, _ids(spark, d)[1], tol=1e-7, max_rank=40)[0])
    return _with_off(lowrank.matvec((q, q), forward(_tens(spark, d))), q)


@query(_KNOWN.format(entry="2*a", off=""))
def mat5_recompress(spark, d):
    """Twice the matrix, its factors beside themselves, recompressed, times a vector."""
    a = _known(spark, d)
    x, y = lowrank.recompress(*map(stored, lowrank.plus(a, a)), 1e-9)
    return lowrank.matvec((x, y), _tens(spark, d)).withColumn("v", F.round("v", 3))


@query(_KNOWN.format(entry="a", off=_AND_OFF))
def mat6_orthogonalise(spark, d):
    """X Y' times a vector, and how far Y is from orthonormal, made of factors that are not."""
    x, y = map(stored, lowrank.orthogonalise(*map(stored, _known(spark, d)), left=False))
    return _with_off(lowrank.matvec((x, y), _tens(spark, d)), y)


@query(_KNOWN.format(entry="1.5*a*a", off=""))
def mat7_low_rank_product(spark, d):
    """(A + A / 2) entrywise times A, times a vector."""
    a = tuple(map(stored, _known(spark, d)))
    return lowrank.matvec(lowrank.entrywise(lowrank.plus(a, lowrank.scaled(a, 0.5)), a, 1e-10), _tens(spark, d)).withColumn("v", F.round("v", 3))


def _nations(spark, d):
    """Quantities of all parts (i) by all nations of their suppliers (j), a complete table."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = lines.groupBy(F.col("l_partkey").alias("i"), F.col("s_nationkey").cast("long").alias("j")).agg(F.sum("l_quantity").cast("double").alias("v"))
    keys = [r.n for r in table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n")).orderBy("n").collect()]  # 25 at every scale
    every = _ids(spark, d)[0].select("i", F.explode(F.array(*map(F.lit, keys)).cast("array<long>")).alias("j"))
    return every.join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def _by_nation(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), (1.0 + F.col("n_nationkey") % 3).alias("v"))


_NATIONS = """WITH y AS (SELECT l_partkey AS i, sum(l_quantity*(1 + s_nationkey%3)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT p_partkey AS i, round(CAST(coalesce(v, 0) AS DOUBLE), 3) AS v FROM part LEFT JOIN y ON i = p_partkey"""


@query(_NATIONS)
def mat8_cross_full(spark, d):
    """The product of the cross approximation of all parts by nations, run until nothing is left."""
    a = stored(_nations(spark, d))
    factors = lowrank.cross_factors(a, lowrank.cross_full(a, 1e-10))
    return lowrank.matvec(tuple(map(stored, factors)), _by_nation(spark, d)).select("i", (F.round("v", 3) + 0.0).alias("v"))


def _bell(x, y):
    """A smooth kernel of two places in the plane of parts and suppliers."""
    return F.exp(-((x[0] - y[0]) * (x[0] - y[0]) / 40000.0 + (x[1] - y[1]) * (x[1] - y[1]) / 4000000.0))


_BELL = "exp(-(({x1}-{x2})**2/40000.0 + ({y1}-{y2})**2/4000000.0))"


@query(with_views(["pts2", "balls2"], "SELECT id AS i, round(sum(" + _BELL.format(x1="x", x2="cx", y1="y", y2="cy") + "*(1+ball_id%3)), 0) AS v FROM pts2, balls2 GROUP BY 1"))
def mat9_cross_partial(spark, d):
    """The product of the factors, which only looked at some rows and columns of parts against suppliers."""
    rows = view(spark, d, "pts2").select(F.col("id").alias("i"), "x", "y")
    cols = view(spark, d, "balls2").select(F.col("ball_id").alias("i"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    x, y, _ = cross.cross_partial(*cross.kernel_access(rows, cols, ["x", "y"], _bell), rows, cols, rtol=1e-8)
    ones = cols.select("i", (1.0 + F.col("i") % 3).alias("v"))
    return lowrank.matvec((x, y), ones).withColumn("v", F.round("v", 0))


@query(_NATIONS)
def mat10_cur(spark, d):
    """C pinv(U) R of all parts by nations from all columns and the 64 heaviest rows, which hold the whole row space."""
    a = stored(_nations(spark, d))
    top = a.groupBy("i").agg(F.sum("v").alias("s")).orderBy(F.desc("s"), "i").limit(64).collect()
    factors = lowrank.cur(a, [r.i for r in top], [r.i for r in _by_nation(spark, d).collect()])
    return lowrank.matvec(tuple(map(stored, factors)), _by_nation(spark, d)).select("i", (F.round("v", 3) + 0.0).alias("v"))


@query()
def mat11_alternate(spark, d):
    return lowrank.alternate(_coo(spark, d), rank=2, sweeps=2)[0]


@query("""SELECT p_partkey AS i, round(CAST(sum(((1 + p_partkey%7)*(1 + n_nationkey%3) + (p_partkey%4)*(n_nationkey%5))*(1 + n_nationkey%3)) AS DOUBLE), 2) AS v
    FROM part, nation WHERE n_nationkey IN (SELECT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1""")
def mat11_completion(spark, d):
    """A matrix of rank 2 of parts by nations, of which only the pairs with order lines are known: the product of all of it.

    A nation without any order line has nothing to be recovered from and is no column.
    """
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    i, j = F.col("l_partkey"), F.col("s_nationkey").cast("long")
    known = stored(lines.select(i.alias("i"), j.alias("j"), ((1 + i % 7) * (1 + j % 3) + (i % 4) * (j % 5)).cast("double").alias("v")).distinct())
    factors = lowrank.alternate(known, rank=2, sweeps=60, tol=1e-6)
    if lowrank.fit_error(known, factors) > 1e-6:
        raise RuntimeError("the alternating fit did not converge")
    return lowrank.matvec(factors, _by_nation(spark, d)).withColumn("v", F.round("v", 2) + 0.0)


@query(with_views(["coo"], "SELECT i, j, round(v, 6) AS v FROM coo UNION ALL SELECT -1, s_suppkey, 1 + s_suppkey%7 FROM supplier"))
def mat12_fit_sparse(spark, d):
    """The order lines' quantities and one full row (-1), found again from products alone."""
    rows, cols = _ids(spark, d)
    full = cols.select(F.lit(-1).cast("long").alias("i"), F.col("i").alias("j"), (1.0 + F.col("i") % 7).alias("v"))
    a = matrix.by_rows(_coo(spark, d).select("i", "j", F.col("v").cast("double").alias("v")).union(full))
    rows = rows.union(spark.range(-1, 0).toDF("i"))
    got, _ = matrix.fit_sparse(a.select("i", "j"), matrix.operator(a), matrix.operator(a, transpose=True), rows, cols)
    return got.withColumn("v", F.round("v", 6))


@query(with_views(["pts2"], "SELECT a.id AS i, round(sum(" + _BELL.format(x1="a.x", x2="b.x", y1="a.y", y2="b.y") + "*(1+b.id%3)), -1) AS v FROM pts2 a, pts2 b GROUP BY 1"))
def mat13_compressed_blocks(spark, d):
    """The product of the matrix of all parts, compressed over its block tree."""
    parts = view(spark, d, "pts2").select(F.col("id").alias("i"), "x", "y")
    tree = blocktree.compress(parts, ["x", "y"], _bell)
    return blocktree.apply(tree, parts.select("i", (1.0 + F.col("i") % 3).alias("v"))).withColumn("v", F.round("v", -1))


@query("SELECT vec_id AS i, round(list_sum(CAST(embedding AS DOUBLE[])), 3) AS v, CAST(0 AS DOUBLE) AS off FROM embeddings")
def mat14_generalised_svd(spark, d):
    """U S V' M of the embeddings times ones, and how far U' N U is from the identity."""
    a = _tall(spark, d)
    w = a.select("i", (1.0 + F.col("i") % 3).alias("w"))
    m = np.diag(1.0 + np.arange(len(a.first()["row"])) % 2)
    u, s, v = lowrank.generalised_svd(a, w, m)
    u = stored(u)
    ones = lowrank.times(u, (s * (v.T @ m).sum(axis=1))[:, None]).select("i", (F.col("row")[0] + 0.0).alias("v"))
    return _with_off(ones, u.join(w, "i").select("i", F.transform("row", lambda x: x * F.sqrt("w")).alias("row")))


@query(with_views(["coo"], ", y AS (SELECT i, sum(v*(j%10)) AS v FROM coo GROUP BY 1) SELECT p_partkey AS i, coalesce(v, 0.0) AS v FROM part LEFT JOIN y ON i = p_partkey"))
def mat15_blocks_in_order(spark, d):
    """The product of MAT1 by block rows: blocks of parts, each with its own padded order of suppliers."""
    a = _coo(spark, d)
    supp = table(spark, d, "supplier")
    x = supp.select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 10).cast("double").alias("v"))
    place = lambda b, j: F.pmod(j * 7 + b, F.lit(1_000_003))
    blocks = a.select((F.col("i") % 5).alias("b"), F.col("i").alias("r"), F.col("j"), "v").select("b", "r", place(F.col("b"), F.col("j")).alias("c"), "v")
    into = supp.select(F.col("s_suppkey").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("b")).withColumn("c", place(F.col("b"), F.col("i")))
    out = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("b"), F.col("p_partkey").alias("r"), F.col("p_partkey").alias("i"))
    return matrix.blocks_in_order(x, into, blocks, out)


def _patched(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 4).alias("patch_id"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("v"))


@query(with_views(["coo"], "SELECT i, j, v FROM coo"))
def pat1_patch_entries(spark, d):
    return matrix.patches_to_entries(_patched(spark, d))


@query("SELECT l_partkey AS i, sum(l_quantity*(l_suppkey%10)) AS v FROM lineitem GROUP BY 1")
def pat1_patch_product(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 10).cast("double").alias("v"))
    return matrix.patch_apply(_patched(spark, d), x)


@query(with_views(["pts2", "boxes2"], """, g AS (SELECT id, box_id AS patch_id, exp(-(((x-(x_lo+x_hi)/2)/((x_hi-x_lo)/2))**2 + ((y-(y_lo+y_hi)/2)/((y_hi-y_lo)/2))**2)/2) AS g FROM pts2 JOIN boxes2
    ON x >= x_lo AND x <= x_hi AND y >= y_lo AND y <= y_hi) SELECT id, patch_id, round(g/sum(g) OVER (PARTITION BY id), 9) AS w FROM g"""))
def pat2_partition_of_unity(spark, d):
    patches = view(spark, d, "boxes2").withColumnRenamed("box_id", "patch_id")
    return matrix.patch_weights(view(spark, d, "pts2"), patches, ["x", "y"], ["x_lo", "y_lo"], ["x_hi", "y_hi"], digits=9)


@query(with_views(["coo"], "SELECT i, sum(v*(j%10)*(1+(i%3))*(CASE WHEN (i+j)%2 = 0 THEN 1 ELSE 1 END)) AS v FROM coo GROUP BY 1"))
def pat3_weighted_patches(spark, d):
    """Two patches that share all suppliers with weights 1/4 and 3/4 on the right, and 1 + i % 3 on the left."""
    rows, cols = _ids(spark, d)
    both = F.explode(F.array(F.struct(F.lit(0).alias("patch_id"), F.lit(0.25).alias("w")), F.struct(F.lit(1).alias("patch_id"), F.lit(0.75).alias("w")))).alias("e")
    right = cols.select("i", both).select("e.patch_id", "i", "e.w")
    left = rows.select("i", F.explode(F.array(F.lit(0), F.lit(1))).alias("patch_id")).withColumn("w", (1 + F.col("i") % 3).cast("double"))
    x = cols.withColumn("v", (F.col("i") % 10).cast("double"))
    return matrix.weighted_patch_apply(_coo(spark, d), left, right, x)


def _composite(spark, d):
    """The order lines' quantities plus the matrix of known rank."""
    return composite.SparsePlusLowRank(stored(_coo(spark, d)), tuple(map(stored, _known(spark, d))))


_ENTRIES = """, e AS (SELECT p_partkey AS i, s_suppkey AS j, CAST(s_suppkey%5 + p_partkey%7 + (p_partkey%3)*(s_suppkey%4) + (p_partkey%5)*(p_partkey%2)*(s_suppkey%3) AS DOUBLE) AS a FROM part, supplier),
    m AS (SELECT e.i, e.j, a + coalesce(coo.v, 0) AS a FROM e LEFT JOIN coo ON coo.i = e.i AND coo.j = e.j)"""


@query(with_views(["coo"], _ENTRIES + """, x AS (SELECT n_nationkey AS n, 1 + n_nationkey%5 AS x FROM nation),
    w AS (SELECT s_suppkey AS j, 1 + s_nationkey%5 + (s_suppkey%3)*(SELECT sum(x) FROM x) + (SELECT sum(x*(n%4)) FROM x) AS w FROM supplier)
    SELECT i, round(sum(a*w), 2) AS v FROM m JOIN w USING (j) GROUP BY 1"""))
def pat3_composite_product(spark, d):
    """The product of two sparse plus low-rank matrices, recompressed, times a vector: parts by suppliers, and suppliers by
    nations (one entry for each supplier's nation, plus rank 2)."""
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    real = lambda *c: F.array(*(x.cast("double") for x in c)).alias("row")
    own = supplier.select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    low = supplier.select(F.col("s_suppkey").alias("i"), real(F.col("s_suppkey") % 3, F.lit(1))), nation.select(F.col("n_nationkey").cast("long").alias("i"), real(F.lit(1), F.col("n_nationkey") % 4))
    product = _composite(spark, d).times(composite.SparsePlusLowRank(own, low)).recompressed(1e-12)
    x = nation.select(F.col("n_nationkey").cast("long").alias("i"), (1.0 + F.col("n_nationkey") % 5).alias("v"))
    return product.apply(x).withColumn("v", F.round("v", 2))


@query(with_views(["coo"], _ENTRIES + " SELECT i, round(sum(a*(j%2 + i%3)*(j%10)), 2) AS v, round(sum(a*(j%2 + i%3)*(j%10)), 2) AS formed FROM m GROUP BY 1"))
def pat3_weighted_composite(spark, d):
    """The same matrix under weights of rank 2 times a vector, without and with forming the weighted matrix."""
    rows, cols = _ids(spark, d)
    real = lambda *c: F.array(*(x.cast("double") for x in c)).alias("row")
    weights = stored(rows.select("i", real(F.lit(1), F.col("i") % 3))), stored(cols.select("i", real(F.col("i") % 2, F.lit(1))))
    a, x = _composite(spark, d), _tens(spark, d)
    formed = a.weighted(weights, 1e-12).apply(x)
    return a.weighted_apply(weights, x).join(formed.withColumnRenamed("v", "f"), "i", "full").select("i", (F.round("v", 2) + 0.0).alias("v"), (F.round("f", 2) + 0.0).alias("formed"))


@query("""WITH p AS (SELECT l_partkey AS patch_id, CAST(sum(l_quantity*(l_suppkey%3-1)) AS DOUBLE) AS a, CAST(sum(l_quantity*(l_linenumber%3-1)) AS DOUBLE) AS b FROM lineitem GROUP BY 1),
    e AS (SELECT patch_id, greatest(a+b, 0) AS plus, greatest(a-b, 0) AS minus FROM p)
    SELECT patch_id, 2*patch_id + r AS i, 2*patch_id + c AS j, round(CASE WHEN r = c THEN plus+minus ELSE plus-minus END/2, 6) + 0.0 AS v FROM e, range(2) x(r), range(2) y(c)""")
def pat4_positive_patches(spark, d):
    """A patch a part, [[a, 2 b], [0, a]] of sums over its order lines; made symmetric, its eigenvalues are a + b and a - b."""
    weigh = lambda c: F.sum(F.col("l_quantity") * (F.col(c) % 3 - 1)).cast("double")
    sums = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("patch_id")).agg(weigh("l_suppkey").alias("a"), weigh("l_linenumber").alias("b"))
    k, a = 2 * F.col("patch_id"), F.col("a")
    cells = F.explode(F.array(*(F.struct(i.alias("i"), j.alias("j"), v.alias("v")) for i, j, v in ((k, k, a), (k, k + 1, 2 * F.col("b")), (k + 1, k + 1, a)))))
    made = matrix.patch_positive(sums.select("patch_id", cells.alias("e")).select("patch_id", "e.*"))
    return made.withColumn("v", F.round("v", 6) + 0.0)


@query()
def agg9_hutchinson_diagonal(spark, d):
    a = stored(_coo(spark, d))
    return aggregates.hutchinson_diagonal(matrix.Chain(matrix.operator(a, transpose=True), matrix.operator(a)), _ids(spark, d)[1], 4)


@query()
def agg10_compare_operators(spark, d):
    a = _coo(spark, d)
    b = a.withColumn("v", F.col("v") * (1 + F.lit(0.01) * (F.col("j") % 2)))
    return aggregates.compare_operators(matrix.operator(a), matrix.operator(b), _ids(spark, d)[1], 3)[1]


@query()
def geo1_derivative_operator(spark, d):
    p = view(spark, d, "pts2").dropDuplicates(["x", "y"]).withColumn("y", F.col("y") / 20)
    op = geofit.derivative_operator(p, (1.0, 0.0), k=8)
    return matrix.apply(op, p.select(F.col("id").alias("i"), F.col("x").alias("v")))


@query()
def geo2_polynomial_basis(spark, d):
    return geofit.polynomial_basis(view(spark, d, "pts2"), ["x", "y"], 2)


@query(with_views(["pts2"], "SELECT id AS i, round(1 + (x*x + x*y + y*y)/8, 3) AS v, CAST(0 AS DOUBLE) AS off FROM pts2"))
def geo2_projection(spark, d):
    """A quadratic projected on the basis (itself again), and how far the basis is from orthonormal."""
    p = view(spark, d, "pts2")
    q = stored(geofit.polynomial_basis(p, ["x", "y"], 2))
    f = p.select(F.col("id").alias("i"), (1 + (F.col("x") * F.col("x") + F.col("x") * F.col("y") + F.col("y") * F.col("y")) / 8).alias("v"))
    return _with_off(lowrank.matvec((q, q), f), q)


@query()
def geo3_transfer_matrices(spark, d):
    p = view(spark, d, "pts2")
    parent = stored(geofit.polynomial_basis(p, ["x", "y"], 2))
    child = stored(geofit.monomials(p, ["x", "y"], 2))
    return geofit.transfer_matrices(parent, child, p.select(F.col("id").alias("i"), (F.col("id") % 4).alias("g")))


@query(with_views(["pts2"], """, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts2),
    z AS (SELECT id, (2*x-x0-x1)/(x1-x0) AS a, (2*y-y0-y1)/(y1-y0) AS b FROM pts2, b)
    SELECT id AS i, CAST(unnest(range(6)) AS INT) AS k, round(unnest([1.0, b, a, b*b, a*b, a*a]), 5) + 0.0 AS v FROM z"""))
def geo3_transferred(spark, d):
    """The orthonormal basis times each group's transfer matrix: the scaled monomials, up to degree 2."""
    p = view(spark, d, "pts2")
    parent, child = stored(geofit.monomials(p, ["x", "y"], 2)), stored(geofit.polynomial_basis(p, ["x", "y"], 2))
    groups = p.select(F.col("id").alias("i"), (F.col("id") % 4).alias("g"))
    t = geofit.transfer_matrices(parent, child, groups)
    held = groups.join(child, "i").join(t, "g").select("i", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"), "row", "t")
    v = F.aggregate(F.zip_with("row", "t", lambda c, r: c * F.element_at(r, F.col("k") + 1)), F.lit(0.0), lambda x, y: x + y)
    return held.select("i", "k", (F.round(v, 5) + 0.0).alias("v"))


@query()
def geo4_radial_functions(spark, d):
    centres = view(spark, d, "balls2").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.min("ball_id").alias("id")).withColumn("v", F.col("x"))
    held = geofit.rbf_solve(centres, ["x", "y"], 40.0, shape=6.0)
    return geofit.rbf_evaluate(view(spark, d, "pts2"), held, ["x", "y"], 40.0, shape=6.0)


@query(with_views(["balls2"], "SELECT min(ball_id) AS id, cx AS x, cy AS y, round(cx + cy/10, 5) AS value FROM balls2 GROUP BY cx, cy"))
def geo4_at_centres(spark, d):
    """The interpolant of a linear function at its own centres: the function again."""
    centres = view(spark, d, "balls2").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.min("ball_id").alias("id")).withColumn("v", F.col("x") + F.col("y") / 10)
    held = stored(geofit.rbf_solve(centres, ["x", "y"], 40.0, shape=6.0))
    got = geofit.rbf_evaluate(held.select("id", "x", "y"), held, ["x", "y"], 40.0, shape=6.0)
    return got.join(held, "id").select("id", "x", "y", (F.round("value", 5) + 0.0).alias("value"))


@query(with_views(["coo"], "SELECT i, round(CASE WHEN i%3 = 0 THEN 0.0 ELSE 0.01*(i%3) END, 9) AS error FROM coo GROUP BY i"))
def agg10_row_errors(spark, d):
    """Rows off by 0, 1 and 2 % have just these errors, whatever the probes."""
    a = _coo(spark, d)
    b = a.withColumn("v", F.col("v") * (1 + F.lit(0.01) * (F.col("i") % 3)))
    return aggregates.compare_operators(matrix.operator(a), matrix.operator(b), _ids(spark, d)[1], 3)[1].withColumn("error", F.round("error", 9) + 0.0)
