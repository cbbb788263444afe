"""Fits on point sets: local derivatives, polynomial bases and their transfer, radial functions."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .iterate import conjugate_gradient
from .knn import nearest
from .lowrank import gram, times
from .matrix import apply
from .spatial import kernel_values


def derivative_operator(points: DataFrame, direction: tuple[float, float], k: int = 10, num_angles: int = 5, num_frequencies: int = 4, s_min: float = 2.0, s_max: float = 20.0, ridge: float = 1e-8, key: str = "id") -> DataFrame:
    """(i, j, v): weights over each point's k nearest points that differentiate plane waves along `direction`, 2-D.

    Wavelengths go from s_min to s_max times the diameter of the neighbourhood (twice its radius); angles go round the
    circle from the direction's own (atan2). Every wave is divided by its frequency. The ridge is stacked below the waves,
    so the least squares see it squared. Points that all lie in one place count as a neighbourhood of diameter 1.
    """
    near = nearest(points, points, ["x", "y"], k, key, key)
    at = near.join(points.select(F.col(key).alias("id"), F.col("x").alias("px"), F.col("y").alias("py")), "id").join(points.select(F.col(key).alias("q"), "x", "y"), "q")
    angles = np.arctan2(direction[1], direction[0]) + np.arange(num_angles) * 2 * np.pi / num_angles
    unit = np.stack([np.cos(angles), np.sin(angles)], 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[["px", "py"]].to_numpy(float) - pdf[["x", "y"]].to_numpy(float)
        lengths = np.linspace(s_min, s_max, num_frequencies) * (2 * np.sqrt((d**2).sum(1).max()) or 1.0)
        phase = (2 * np.pi / lengths)[:, None, None] * (unit @ d.T)[None]
        waves = lengths[:, None, None] * np.stack([np.cos(phase), np.sin(phase)])
        slopes = np.broadcast_to(2 * np.pi * (unit @ np.asarray(direction, float)), waves.shape[1:3])
        rows = np.concatenate([waves.reshape(-1, len(d)), ridge * np.eye(len(d))])
        rhs = np.concatenate([np.zeros(slopes.size), slopes.ravel(), np.zeros(len(d))])
        return pd.DataFrame({"i": pdf["q"], "j": pdf["id"], "v": np.linalg.lstsq(rows, rhs, rcond=None)[0]})

    return at.groupBy("q").applyInPandas(solve, "i long, j long, v double")


def monomials(points: DataFrame, axes: list[str], degree: int, key: str = "id") -> DataFrame:
    """(i, row): monomials of total degree <= degree in coordinates scaled to [-1, 1]."""
    box = points.agg(*(F.min(a).alias("lo" + a) for a in axes), *(F.max(a).alias("hi" + a) for a in axes)).first()
    z = [F.lit(0.0) if box["hi" + a] == box["lo" + a] else (2 * F.col(a) - float(box["lo" + a] + box["hi" + a])) / float(box["hi" + a] - box["lo" + a]) for a in axes]
    powers = sorted((p for p in product(range(degree + 1), repeat=len(axes)) if sum(p) <= degree), key=lambda p: (sum(p), p))
    terms = []
    for p in powers:
        t = F.lit(1.0)
        for x, e in zip(z, p):
            for _ in range(e):
                t = t * x
        terms.append(t)
    return points.select(F.col(key).alias("i"), F.array(*terms).alias("row"))


def polynomial_basis(points: DataFrame, axes: list[str], degree: int, key: str = "id", rtol: float = 1e-12) -> DataFrame:
    """(i, row): orthonormal basis of the polynomials on the point set, by the Gram matrix's eigenvectors."""
    raw = stored(monomials(points, axes, degree, key))
    w, u = np.linalg.eigh(gram(raw))
    keep = w > rtol * w.max(initial=0)
    return times(raw, u[:, keep] / np.sqrt(w[keep]))


def transfer_matrices(parent: DataFrame, children: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, t): least squares of the parent basis (i, row) on each group's basis (i, row); groups (i, g).

    Groups share one child basis table whose rows belong to the groups; sums before the small solves.
    """
    rows = groups.join(children.select("i", F.col("row").alias("c")), "i").join(parent.select("i", F.col("row").alias("p")), "i")

    def partial(batches):
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                c, p = np.array(part["c"].tolist(), float), np.array(part["p"].tolist(), float)
                yield pd.DataFrame({"g": [g], "nc": [c.shape[1]], "cc": [(c.T @ c).ravel().tolist()], "cp": [(c.T @ p).ravel().tolist()]})

    parts = rows.select("g", "c", "p").mapInPandas(partial, "g long, nc int, cc array<double>, cp array<double>")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["nc"].iloc[0])
        cc = np.sum([np.asarray(x) for x in pdf["cc"]], axis=0).reshape(n, n)
        cp = np.sum([np.asarray(x) for x in pdf["cp"]], axis=0).reshape(n, -1)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "t": [np.linalg.lstsq(cc, cp, rcond=None)[0].tolist()]})

    return parts.groupBy("g").applyInPandas(solve, "g long, t array<array<double>>")


def rbf_solve(centres: DataFrame, axes: list[str], radius: float, shape: float = 1.0, key: str = "id", value: str = "v", most: int = 1024, tol: float = 1e-10, max_iter: int = 500) -> DataFrame:
    """(key, axes, w): weights of the Gaussian interpolant, cut at `radius`, through any number of distinct centres.

    Conjugate gradients on the table of kernel values. The preconditioner sums solves in cells twice as wide as the
    radius that overlap by half of it; cells of over `most` centres are dealt into parts. Without convergence it raises.
    """
    c = stored(centres.select(F.col(key).alias("id"), *axes, F.col(value).cast("double").alias("v")))
    at = c.select("id", *axes)
    phi = stored(kernel_values(at, at, axes, radius, "gaussian", shape).select(F.col("l_id").alias("i"), F.col("r_id").alias("j"), F.col("phi").alias("v")))
    cells = at
    for a in axes:
        low, high = (F.floor((F.col(a) + s * radius / 2) / (2 * radius)) for s in (-1, 1))
        cells = cells.withColumn("_c" + a, F.explode(F.sequence(low, high)))
    cell = ["_c" + a for a in axes]
    parts = cells.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("_n"))
    held = stored(cells.join(parts, cell).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_n"))).drop("_n"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[axes].to_numpy(float)
        d = ((p[:, None] - p[None]) ** 2).sum(2)
        m = np.where(d <= radius**2, np.exp(-d / (2 * shape**2)), 0.0)
        return pd.DataFrame({"i": pdf["id"], "v": np.linalg.solve(m, pdf["v"].to_numpy(float))})

    def local(r: DataFrame) -> DataFrame:
        z = held.join(r.withColumnRenamed("i", "id"), "id").groupBy(*cell, "_part").applyInPandas(solve, "i long, v double")
        return stored(z.groupBy("i").agg(F.sum("v").alias("v")))

    w, history, code = conjugate_gradient(lambda x: apply(phi, x), c.select(F.col("id").alias("i"), "v"), tol, max_iter, precondition=local)
    if code:
        raise RuntimeError(f"no convergence: code {code}, residual {history[-1]['residual']:.3g}")
    return at.join(w.select(F.col("i").alias("id"), F.col("v").alias("w")), "id").withColumnRenamed("id", key)


def rbf_shape(centres: np.ndarray, target: float, kind: str = "gaussian", steps: int = 40) -> float:
    """Shape parameter whose interpolation matrix has about the target condition number."""
    d = ((centres[:, None] - centres[None]) ** 2).sum(2)

    def cond(s: float) -> float:
        return float(np.linalg.cond(np.exp(-d / (2 * s**2)) if kind == "gaussian" else np.sqrt(1 + s**2 * d)))

    lo, hi = 1e-4 * np.sqrt(d.max()), 1e2 * np.sqrt(d.max())
    rising = kind == "gaussian"
    for _ in range(steps):
        mid = np.sqrt(lo * hi)
        if (cond(mid) > target) == rising:
            hi = mid
        else:
            lo = mid
    return float(np.sqrt(lo * hi))


def rbf_evaluate(points: DataFrame, centres: DataFrame, axes: list[str], radius: float, kind: str = "gaussian", shape: float = 1.0, key: str = "id") -> DataFrame:
    """(key, value): sum of w phi over the centres (id, .., w) within the radius; points of one place are summed once."""
    near = kernel_values(centres, stored(points.select(*axes).distinct()), axes, radius, kind, shape)
    sums = near.groupBy(*(F.col("l_" + a).alias("_" + a) for a in axes)).agg(F.sum(F.col("phi") * F.col("r_w")).alias("value"))
    return points.join(sums, reduce(and_, [F.col(a) == F.col("_" + a) for a in axes])).select(key, "value")
