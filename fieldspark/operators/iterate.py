"""Iterative solves and fits. Vectors are tables (i, v); only scalars and small parameter vectors come to the driver."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def norm(x: DataFrame) -> float:
    return math.sqrt(x.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


def combine(*terms: tuple[float, DataFrame]) -> DataFrame:
    """sum of c x over the terms (c, x); rows missing in a term are zero in it."""
    parts = [x.select("i", (F.col("v") * float(c)).alias("v")) for c, x in terms]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("i").agg(F.sum("v").alias("v"))


def conjugate_gradient(apply, b: DataFrame, tol: float = 1e-8, max_iter: int = 200, diagonal: DataFrame | None = None, known: DataFrame | None = None, x0: DataFrame | None = None, callback=None, precondition=None) -> tuple[DataFrame, list[dict], int]:
    """x, history (iteration, residual, error) and a code: 0 converged, k > 0 stopped after k steps, -1 breakdown.

    residual is ||A x - b|| / ||b||; error the relative error against `known`. diagonal: (i, v) of the preconditioner, or
    precondition: a function r -> z that applies a symmetric one.
    """
    size = norm(b)
    x = x0 if x0 is not None else b.select("i", F.lit(0.0).alias("v"))
    r = stored(combine((1.0, b), (-1.0, apply(x)))) if x0 is not None else b
    history: list[dict] = []

    def scale(r: DataFrame) -> DataFrame:
        if precondition is not None:
            return precondition(r)
        return r if diagonal is None else r.join(diagonal.withColumnRenamed("v", "d"), "i").select("i", (F.col("v") / F.col("d")).alias("v"))

    z = scale(r)
    p, rz = stored(z), dot(r, z)
    far = norm(known) if known is not None else 0.0
    for k in range(max_iter + 1):
        res = norm(r) / size if size else 0.0
        history.append({"iteration": k, "residual": res, "error": norm(combine((1.0, x), (-1.0, known))) / far if known is not None else None})
        if callback:
            callback(k, x, res)
        if res <= tol:
            return x, history, 0
        if k == max_iter:
            return x, history, max_iter
        ap = stored(apply(p))
        curve = dot(p, ap)
        if curve == 0 or not math.isfinite(curve):
            return x, history, -1
        alpha = rz / curve
        x, r = stored(combine((1.0, x), (alpha, p))), stored(combine((1.0, r), (-alpha, ap)))
        z = scale(r)
        new = dot(r, z)
        p, rz = stored(combine((1.0, z), (new / rz, p))), new
    return x, history, max_iter


def cg_steihaug(hess, g: np.ndarray, radius: float = math.inf, tol: float = 1e-8, max_iter: int | None = None, precondition=None) -> tuple[np.ndarray, str, int]:
    """min g'x + x'Hx/2 within the radius (in the preconditioner's norm): x, the reason it ended and the steps.

    hess(x) is one aggregation over the data. The x of a gradient that is already small is zero. On leaving the region,
    or along negative curvature, x lies on its boundary, at the end of the line where the model is lower; without a radius
    negative curvature gives the iterate before.
    """
    solve, weigh = precondition or (lambda v: v, lambda v: v)
    x, r = np.zeros_like(g), g.astype(float).copy()
    z = solve(r)
    p, rz = -z, float(r @ z)
    first = math.sqrt(abs(rz))
    if first == 0 or first < 1e-300:
        return x, "tolerance_achieved", 0

    def edge(x: np.ndarray, p: np.ndarray, slope: float, curve: float) -> np.ndarray:
        a, b, c = p @ weigh(p), 2 * (x @ weigh(p)), x @ weigh(x) - radius**2
        root = math.sqrt(max(b * b - 4 * a * c, 0))
        return x + min(((-b + root) / (2 * a), (-b - root) / (2 * a)), key=lambda t: t * slope + t * t * curve / 2) * p

    for k in range(1, (max_iter or 4 * len(g)) + 1):
        hp = hess(p)
        curve = float(p @ hp)
        if not math.isfinite(curve):
            return x, "INF OR NAN", k
        if curve <= 0:
            return (edge(x, p, float(r @ p), curve) if math.isfinite(radius) else x), "encountered_negative_curvature", k
        alpha = rz / curve
        trial = x + alpha * p
        if trial @ weigh(trial) >= radius**2:
            return edge(x, p, float(r @ p), curve), "exited_trust_region", k
        x, r = trial, r + alpha * hp
        z = solve(r)
        new = float(r @ z)
        if math.sqrt(abs(new)) <= tol * first:
            return x, "tolerance_achieved", k
        p, rz = -z + new / rz * p, new
    return x, "performed_maximum_iterations", max_iter or 4 * len(g)


def row_sums(data: DataFrame, kernel, params: np.ndarray, size: int) -> np.ndarray:
    """Sum over all rows of kernel(batch as pandas, params) -> vector of `size` numbers, partial sums in each task."""

    def run(batches):
        total = np.zeros(size)
        for pdf in batches:
            if len(pdf):
                total += kernel(pdf, params)
        yield pd.DataFrame({"p": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in data.mapInPandas(run, "p int, v double").groupBy("p").agg(F.sum("v").alias("v")).collect():
        out[r.p] = r.v
    return out


class LeastSquares:
    """misfit ||f(m) - y||^2 / 2 + ridge ||m||^2 / 2 over data rows; model(pdf, m) returns predictions and Jacobian rows.

    linear: the Jacobian doesn't depend on m. Then one pass over all rows sums the products of the Jacobian's columns and the
    residual at zero, and every misfit, gradient and product comes from these; else each of them is a pass of its own.
    """

    def __init__(self, data: DataFrame, model, y: str, size: int, ridge: float = 0.0, linear: bool = False):
        self.data, self.model, self.y, self.size, self.ridge, self.linear = data, model, y, size, ridge, linear
        self._last: tuple | None = None
        self._sums: np.ndarray | None = None

    def _products(self) -> np.ndarray:
        """[J r]' [J r] for the residual r at zero, of a linear model."""
        if self._sums is None:
            model, y = self.model, self.y

            def kernel(pdf, m):
                f, jac = model(pdf, m)
                both = np.column_stack([jac, f - pdf[y].to_numpy(float)])
                return (both.T @ both).ravel()

            self._sums = row_sums(self.data, kernel, np.zeros(self.size), (self.size + 1) ** 2).reshape(self.size + 1, -1)
        return self._sums

    def _at(self, m: np.ndarray) -> tuple[float, np.ndarray]:
        if self.linear:
            s, to = self._products(), np.append(m, 1.0)
            return float(to @ s @ to / 2 + self.ridge * (m @ m) / 2), (s @ to)[:-1] + self.ridge * m
        if self._last is None or not np.array_equal(self._last[0], m):
            model, y = self.model, self.y

            def kernel(pdf, m):
                f, jac = model(pdf, m)
                d = f - pdf[y].to_numpy(float)
                return np.concatenate([[d @ d / 2], jac.T @ d])

            s = row_sums(self.data, kernel, m, 1 + self.size)
            self._last = (m.copy(), s[0] + self.ridge * (m @ m) / 2, s[1:] + self.ridge * m)
        return self._last[1], self._last[2]

    def cost(self, m: np.ndarray) -> float:
        return self._at(m)[0]

    def gradient(self, m: np.ndarray) -> np.ndarray:
        return self._at(m)[1]

    def hessian(self, m: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Gauss-Newton product."""
        if self.linear:
            return self._products()[:-1, :-1] @ p + self.ridge * p
        model = self.model

        def kernel(pdf, mp):
            _, jac = model(pdf, mp[0])
            return jac.T @ (jac @ mp[1])

        return row_sums(self.data, kernel, (m, p), self.size) + self.ridge * p


def _wolfe(f, grad, x, p, fx, gx, c1=1e-4, c2=0.9, steps=30):
    """A step with the strong Wolfe conditions by bracketing and bisection; None if none is found."""
    slope, lo, hi, a = gx @ p, 0.0, math.inf, 1.0
    for _ in range(steps):
        fa = f(x + a * p)
        if not math.isfinite(fa) or fa > fx + c1 * a * slope:
            hi = a
        else:
            ga = grad(x + a * p)
            s = ga @ p
            if abs(s) <= -c2 * slope:
                return a, fa, ga
            if s < 0:
                lo = a
            else:
                hi = a
        a = (lo + hi) / 2 if math.isfinite(hi) else 2 * a
    return None


def lbfgs(f, grad, x0: np.ndarray, m: int = 20, rtol: float = 1e-8, max_iter: int = 200, stag_tol: float = 1e-14, warm=None, num_initial_iter: int = 0) -> tuple[np.ndarray, dict]:
    """x and a record (cost and gradient histories, reason): converged, stagnated, line_search_failed, maximum_iterations.

    warm(v): an inverse Hessian used as the first guess once num_initial_iter steps were made. Stagnation,
    (f_old - f) < stag_tol f_old, is meant for positive costs.
    """
    x, fx, gx = x0.astype(float).copy(), f(x0), grad(x0)
    first = np.linalg.norm(gx)
    pairs: deque = deque(maxlen=m)
    costs, sizes, reason = [fx], [first], "maximum_iterations"
    for k in range(max_iter):
        if np.linalg.norm(gx) <= rtol * first:
            reason = "converged"
            break
        q, alphas = gx.copy(), []
        for s, y, rho in reversed(pairs):
            a = rho * (s @ q)
            alphas.append(a)
            q -= a * y
        if warm is not None and k >= num_initial_iter:
            q = warm(q)
        elif pairs:
            s, y, _ = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(pairs, reversed(alphas)):
            q += (a - rho * (y @ q)) * s
        step = _wolfe(f, grad, x, -q, fx, gx)
        if step is None:
            reason = "line_search_failed"
            break
        a, fn, gn = step
        s, y = -a * q, gn - gx
        if s @ y > 0:
            pairs.append((s, y, 1 / (s @ y)))
        x, old, fx, gx = x - a * q, fx, fn, gn
        costs.append(fx), sizes.append(float(np.linalg.norm(gx)))
        if 0 <= old - fx < stag_tol * old:
            reason = "converged" if sizes[-1] <= rtol * first else "stagnated"
            break
    return x, {"costs": costs, "gradients": sizes, "reason": reason, "iterations": len(costs) - 1}


def trust_region(cost, gradient, hessian, x0: np.ndarray, rtol: float = 1e-8, max_iter: int = 50) -> tuple[np.ndarray, dict]:
    """Newton with a trust region: a Cauchy step first, whose length sets the radius, then CG-Steihaug steps.

    Forcing term min(1/2, sqrt(|g|/|g0|)), at least rtol / 3; the radius shrinks by 4 under a ratio of 1/4 and doubles
    over 3/4 at the boundary; a step counts if the ratio is over 1/10.
    """
    x, fx, g = x0.astype(float).copy(), cost(x0), gradient(x0)
    first, radius, step = np.linalg.norm(g), math.inf, None
    record = {"costs": [fx], "gradients": [float(first)], "reasons": [], "reason": "maximum_iterations"}
    for k in range(max_iter):
        size = np.linalg.norm(g)
        if size <= rtol * first:
            record["reason"] = "converged"
            break
        if k == 0:
            curve = g @ hessian(x, g)
            p, why = (-(g @ g) / curve * g if curve > 0 else -g), "cauchy"
            radius = float(np.linalg.norm(p))
        else:
            p, why, _ = cg_steihaug(lambda v: hessian(x, v), g, radius, max(min(0.5, math.sqrt(size / first)), rtol / 3))
        predicted = -(g @ p + p @ hessian(x, p) / 2)
        fn = cost(x + p)
        ratio = (fx - fn) / predicted if predicted > 0 and math.isfinite(fn) else -1.0
        if ratio < 0.25:
            radius *= 0.25
        elif ratio > 0.75 and (why != "tolerance_achieved"):
            radius *= 2
        record["reasons"].append(why)
        if ratio > 0.1:
            x, fx, step = x + p, fn, p
            g = gradient(x)
            record["costs"].append(fx), record["gradients"].append(float(np.linalg.norm(g)))
        elif radius < 1e-14 * max(1.0, np.linalg.norm(x)):
            record["reason"] = "radius_vanished"
            break
    return x, record | {"previous_step": step}


def lanczos(apply, b: DataFrame, function, steps: int) -> DataFrame:
    """f(A) b for a symmetric A by Lanczos without re-orthogonalisation; the vectors stay tables."""
    beta0 = norm(b)
    q, before, alphas, betas, basis = stored(combine((1 / beta0, b))), None, [], [], []
    for k in range(steps):
        basis.append(q)
        w = stored(apply(q))
        alphas.append(dot(q, w))
        terms = [(1.0, w), (-alphas[-1], q)] + ([(-betas[-1], before)] if before is not None else [])
        w = stored(combine(*terms))
        beta = norm(w)
        if k == steps - 1 or beta < 1e-12 * abs(alphas[0]):
            break
        betas.append(beta)
        before, q = q, stored(combine((1 / beta, w)))
    n = len(alphas)
    t = np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1)
    lam, u = np.linalg.eigh(t)
    c = beta0 * (u @ (function(lam) * u[0]))
    return combine(*((float(x), v) for x, v in zip(c, basis)))


def _elliptic(m: float) -> float:
    """Complete elliptic integral K(m) by the arithmetic-geometric mean."""
    a, b = 1.0, math.sqrt(1 - m)
    while abs(a - b) > 1e-16 * a:
        a, b = (a + b) / 2, math.sqrt(a * b)
    return math.pi / (2 * a)


def _jacobi(u: float, m: float) -> tuple[float, float, float]:
    """sn, cn, dn by descending Landen steps."""
    a, c = [1.0], [math.sqrt(m)]
    b = math.sqrt(1 - m)
    while abs(c[-1]) > 1e-16:
        a_, b_ = a[-1], b
        a.append((a_ + b_) / 2), c.append((a_ - b_) / 2)
        b = math.sqrt(a_ * b_)
    phi = 2 ** (len(a) - 1) * a[-1] * u
    for k in range(len(a) - 1, 0, -1):
        phi = (phi + math.asin(max(-1.0, min(1.0, c[k] * math.sin(phi) / a[k])))) / 2
    s = math.sin(phi)
    return s, math.cos(phi), math.sqrt(1 - m * s * s)


def inverse_sqrt_rule(lo: float, hi: float, n: int) -> tuple[list[float], list[float]]:
    """Weights and (negative) poles with x^-1/2 ~ sum w / (x - p) on [lo, hi]."""
    k2 = lo / hi
    kk = _elliptic(1 - k2)
    weights, poles = [], []
    for j in range(n):
        sn, cn, dn = _jacobi((j + 0.5) * kk / n, 1 - k2)
        poles.append(-lo * (sn / cn) ** 2)
        weights.append(2 * kk * math.sqrt(lo) / (math.pi * n) * dn / cn**2)
    return weights, poles


def shifted_solves(apply, b: DataFrame, shifts: list[float], tol: float = 1e-8, max_iter: int = 500) -> DataFrame:
    """(i, xs): the solutions of (A + s) x = b for all shifts, for a symmetric A with A + min(shifts) positive definite.

    One sequence of conjugate gradients, that of the least shift, serves all: the residual of each other shift is a
    multiple of its residual, so a step costs one product with A and one written table however many shifts there are.
    apply is the product with A. Ends when every shift's residual is within tol of b's norm; raises RuntimeError when one
    is not after max_iter steps, or when the operator turns out not to be positive definite.
    """
    least = min(shifts)
    delta = np.array([s - least for s in shifts])
    rr = size2 = float(b.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)
    n = len(shifts)
    held = b.select("i", F.col("v").alias("r"), F.col("v").alias("p"), F.array(*[F.lit(0.0)] * n).alias("xs"), F.array(*[F.col("v")] * n).alias("ps"))
    zeta, before, alpha, beta = np.ones(n), np.ones(n), 0.0, 1.0
    multiples = lambda c: F.array(*map(F.lit, c.tolist()))
    for _ in range(max_iter):
        if max(abs(zeta)) * math.sqrt(rr) <= tol * math.sqrt(size2):
            return held.select("i", "xs")
        ap = apply(held.select("i", F.col("p").alias("v"))).select("i", F.col("v").alias("ap"))
        held = stored(held.join(ap, "i", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)) + least * F.col("p")))
        curve = held.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        if not curve or not curve > 0:
            raise RuntimeError("the shifted operator is not positive definite")
        last, beta = beta, -rr / curve
        after = zeta * before * last / (beta * alpha * (before - zeta) + before * last * (1 - delta * beta))
        step = beta * after / zeta
        held = held.withColumns({"r": F.col("r") + beta * F.col("ap"), "xs": F.zip_with("xs", F.zip_with("ps", multiples(step), lambda p, c: p * c), lambda x, d: x - d)})
        new = float(held.agg(F.sum(F.col("r") * F.col("r"))).first()[0])
        alpha = new / rr
        again = alpha * after * step / (zeta * beta)
        turned = F.zip_with("ps", multiples(again), lambda p, c: p * c)
        fresh = F.transform(multiples(after), lambda z: z * F.col("r"))
        held = held.select("i", "r", (F.col("r") + alpha * F.col("p")).alias("p"), "xs", F.zip_with(fresh, turned, lambda x, y: x + y).alias("ps"))
        before, zeta, rr = zeta, after, new
    raise RuntimeError(f"shifts {[s for s, z in zip(shifts, zeta) if abs(z) * math.sqrt(rr) > tol * math.sqrt(size2)]} did not converge in {max_iter} steps")


def inverse_sqrt(a: DataFrame, b: DataFrame, lo: float, hi: float, n: int = 8, tol: float = 1e-8, max_iter: int = 500) -> DataFrame:
    """A^-1/2 b for a symmetric A (i, j, v) with spectrum in [lo, hi]: a rational rule of n poles, all from one sequence
    of conjugate gradients (shifted_solves, whose errors are raised)."""
    from .matrix import apply

    weights, poles = inverse_sqrt_rule(lo, hi, n)
    solved = shifted_solves(lambda v: apply(a, v), b, [-p for p in poles], tol, max_iter)
    return solved.select("i", F.aggregate(F.zip_with("xs", F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(0.0), lambda s, t: s + t).alias("v"))
