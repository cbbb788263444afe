"""Queries of the iterative solves and fits."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import grid, iterate, matrix
from ..operators.common import stored
from .base import query
from .fields import SHAPE, _full, field
from .views import table, with_views


def _system(spark, d):
    """A smoothing operator on the field's lattice and the field as right-hand side."""
    a = stored(grid.smoothing_operator(spark, list(SHAPE), [1.0, 1.0], nu=1.0, length=4.0))
    b = grid.restrict(field(spark, d), [0, 0], [SHAPE[0] - 1, SHAPE[1] - 1]).df.select((F.col("i") * SHAPE[1] + F.col("j")).alias("i"), "v")
    return a, stored(b)


#: Bounds of the spectrum of that operator.
_BOUNDS = (0.5, 8.5)
#: The right-hand side on the lattice, times a factor; what the operator makes of the solution must be that again.
_RHS = with_views(["grid2"], _full() + " SELECT CAST(i*24+j AS BIGINT) AS i, round(v*{factor}, 2) AS v FROM g")


@query(_RHS.format(factor="1"))
def itr1_conjugate_gradient(spark, d):
    """The operator applied to the solution."""
    a, b = _system(spark, d)
    diagonal = a.where("i = j").select("i", "v")
    x, _, code = iterate.conjugate_gradient(matrix.operator(a), b, tol=1e-6, diagonal=diagonal)
    if code:
        raise RuntimeError("conjugate gradients did not converge")
    return matrix.apply(a, x).select("i", (F.round("v", 2) + 0.0).alias("v"))


@query(_RHS.format(factor="0.5"))
def grd11_smooth_field(spark, d):
    """The operator applied to the smoothed field of half the counts."""
    a, b = _system(spark, d)
    x, _, code = iterate.conjugate_gradient(matrix.operator(a), b.select("i", (F.col("v") * 0.5).alias("v")), tol=1e-6)
    if code:
        raise RuntimeError("conjugate gradients did not converge")
    return matrix.apply(a, x).select("i", (F.round("v", 2) + 0.0).alias("v"))


@query(_RHS.format(factor="1"))
def itr6_lanczos(spark, d):
    """The inverse square root by Lanczos applied twice, and the operator to that: the right-hand side again."""
    a, b = _system(spark, d)
    half = lambda v: stored(iterate.lanczos(matrix.operator(a), v, lambda x: 1 / np.sqrt(x), 26))
    return matrix.apply(a, half(half(b))).select("i", (F.round("v", 2) + 0.0).alias("v"))


@query(_RHS.format(factor="1"))
def itr7_inverse_sqrt(spark, d):
    """The inverse square root applied twice, and the operator to that: the right-hand side again."""
    a, b = _system(spark, d)
    half = lambda v: stored(iterate.inverse_sqrt(a, v, *_BOUNDS))
    return matrix.apply(a, half(half(b))).select("i", (F.round("v", 2) + 0.0).alias("v"))


def _prices(spark, d):
    """ln price against ln quantity, tax and discount over the order lines."""
    def model(pdf, m):
        jac = np.stack([np.ones(len(pdf)), np.log(pdf["l_quantity"]), pdf["l_tax"], pdf["l_discount"]], 1).astype(float)
        return jac @ m, jac

    rows = table(spark, d, "lineitem").select("l_quantity", "l_tax", "l_discount", F.log("l_extendedprice").alias("y"))
    return iterate.LeastSquares(rows, model, "y", 4, ridge=1e-6, linear=True), rows


def _as_rows(spark, rows, m):
    """The normal equations at the fit, over the whole table: mean product of the residual with each regressor (zero)."""
    terms = {"constant": F.lit(1.0), "discount": F.col("l_discount"), "quantity": F.log("l_quantity"), "tax": F.col("l_tax")}
    fit = F.lit(float(m[0])) + terms["quantity"] * float(m[1]) + terms["tax"] * float(m[2]) + terms["discount"] * float(m[3])
    means = rows.agg(*(F.avg((F.col("y") - fit) * t).alias(n) for n, t in terms.items()), F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("regressor"), F.col(n).alias("v")) for n in terms))).alias("e")
    return means.select("n", each).select("e.regressor", "n", (F.round(F.abs("e.v"), 3) + 0.0).alias("product"))


_FITTED = "SELECT regressor, n, CAST(0 AS DOUBLE) AS product FROM (SELECT count(*) AS n FROM lineitem), (SELECT unnest(['constant', 'discount', 'quantity', 'tax']) AS regressor)"


@query(_FITTED)
def itr2_cg_steihaug(spark, d):
    ls, rows = _prices(spark, d)
    zero = np.zeros(4)
    m, _, _ = iterate.cg_steihaug(lambda p: ls.hessian(zero, p), ls.gradient(zero), radius=100.0, tol=1e-10)
    return _as_rows(spark, rows, m)


@query(_FITTED)
def itr3_lbfgs(spark, d):
    ls, rows = _prices(spark, d)
    m, _ = iterate.lbfgs(ls.cost, ls.gradient, np.zeros(4), rtol=1e-6)
    return _as_rows(spark, rows, m)


@query(_FITTED)
def itr4_trust_region(spark, d):
    ls, rows = _prices(spark, d)
    m, _ = iterate.trust_region(ls.cost, ls.gradient, ls.hessian, np.zeros(4), rtol=1e-6)
    return _as_rows(spark, rows, m)


@query("""WITH r AS (SELECT ln(CAST(l_quantity AS DOUBLE)) AS x, 1 + 2*ln(CAST(l_quantity AS DOUBLE)) - ln(CAST(l_extendedprice AS DOUBLE)) AS e FROM lineitem)
    SELECT round(sum(e*e)/2/count(*), 6) AS cost, round(sum(e)/count(*), 6) AS g0, round(sum(e*x)/count(*), 6) AS g1, round(sum(1-x)/count(*), 6) AS h0, round(sum((1-x)*x)/count(*), 6) AS h1 FROM r""")
def itr5_least_squares(spark, d):
    """Misfit, gradient and Gauss-Newton product of ln price = m0 + m1 ln quantity at m = (1, 2) along (1, -1), a row."""
    def model(pdf, m):
        jac = np.stack([np.ones(len(pdf)), np.log(pdf["l_quantity"].astype(float))], 1)
        return jac @ m, jac

    rows = table(spark, d, "lineitem").select("l_quantity", F.log("l_extendedprice").alias("y"))
    ls, m = iterate.LeastSquares(rows, model, "y", 2), np.array([1.0, 2.0])
    values = [ls.cost(m), *ls.gradient(m), *ls.hessian(m, np.array([1.0, -1.0]))]
    return rows.agg(*(F.round(F.lit(float(v)) / F.count(F.lit(1)), 6).alias(n) for n, v in zip(("cost", "g0", "g1", "h0", "h1"), values)))
