"""Polynomial curves, one per entity: coefficients lowest power first, one array per entity and component."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(coefficients: Column, t: Column) -> Column:
    """Horner's rule over an array of coefficients."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * t + c.cast("double"))


def _padded(a: Column, n: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0.0), n - F.size(a)))


def plus(a: Column, b: Column) -> Column:
    n = F.greatest(F.size(a), F.size(b))
    return F.zip_with(_padded(a, n), _padded(b, n), lambda x, y: x + y)


def scaled(a: Column, c: Column) -> Column:
    return F.transform(a, lambda x: x * c)


def product(a: Column, b: Column) -> Column:
    """Coefficient convolution."""
    rows = F.transform(a, lambda x, i: F.concat(F.array_repeat(F.lit(0.0), i), F.transform(b, lambda y: x * y), F.array_repeat(F.lit(0.0), F.size(a) - 1 - i)))
    return F.reduce(F.slice(rows, F.lit(2), F.size(rows) - 1), F.get(rows, F.lit(0)), lambda s, r: F.zip_with(s, r, lambda x, y: x + y))


def derivative(a: Column) -> Column:
    return F.when(F.size(a) > 1, F.transform(F.slice(a, F.lit(2), F.size(a) - 1), lambda x, i: x * (i + 1))).otherwise(F.array(F.lit(0.0)))


def taylor(derivatives: Column) -> Column:
    """Taylor coefficients d_k / k! from derivatives at a point."""
    return F.transform(derivatives, lambda d, k: d.cast("double") / F.factorial(k))


def from_roots(roots: Column) -> Column:
    """Monic polynomial with the given roots."""
    zero = F.array(F.lit(0.0))
    return F.aggregate(roots, F.array(F.lit(1.0)), lambda p, r: F.zip_with(F.concat(zero, p), F.concat(F.transform(p, lambda x: -x * r), zero), lambda x, y: x + y))


def fit(samples: DataFrame, degree: int, entity: str = "entity", t: str = "t", y: str = "y") -> DataFrame:
    """(entity, c): least-squares polynomial through each entity's samples; degree + 1 samples interpolate.

    The normal equations are sums, so a hot entity is combined before the shuffle; each entity's small system is solved
    with a scaled variable. Entities with fewer distinct samples than coefficients get the minimum-norm solution.
    """
    n = degree + 1
    x = F.col(t).cast("double")
    box = samples.groupBy(entity).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    z = F.when(F.col("hi") > F.col("lo"), (2 * x - F.col("lo") - F.col("hi")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    rows = samples.join(box, entity).withColumn("z", z)
    sums = rows.groupBy(entity, "lo", "hi").agg(F.array(*(F.sum(F.pow("z", F.lit(k))) for k in range(2 * n - 1))).alias("g"), F.array(*(F.sum(F.pow("z", F.lit(k)) * F.col(y)) for k in range(n))).alias("b"))

    def solve(batches):
        for pdf in batches:
            out = []
            for lo, hi, g, b in zip(pdf["lo"], pdf["hi"], pdf["g"], pdf["b"]):
                g = np.asarray(g)
                c = np.linalg.lstsq(np.array([g[i : i + n] for i in range(n)]), np.asarray(b), rcond=None)[0]
                line = np.poly1d([2.0, -(lo + hi)]) / (hi - lo) if hi > lo else np.poly1d([0.0])
                p = np.poly1d(c[::-1])(line)
                got = np.zeros(n)
                got[: len(p.coefficients)] = p.coefficients[::-1]
                out.append(got.tolist())
            yield pd.DataFrame({entity: pdf[entity], "c": out})

    return sums.mapInPandas(solve, f"{entity} {dict(samples.dtypes)[entity]}, c array<double>")


def arc_length(curves: DataFrame, t0: float, t1: float, components: list[str], nodes: int = 32) -> DataFrame:
    """Adds `length`: the arc length between t0 and t1 of the curve whose components are coefficient columns."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    half = (t1 - t0) / 2
    at = F.array(*(F.lit(float(t0 + half * (1 + v))) for v in x))
    weights = F.array(*(F.lit(float(half * v)) for v in w))
    speeds = F.transform(at, lambda t: F.sqrt(sum((F.pow(evaluate(derivative(F.col(c)), t), F.lit(2)) for c in components), F.lit(0.0))))
    return curves.withColumn("length", F.aggregate(F.zip_with(speeds, weights, lambda s, v: s * v), F.lit(0.0), lambda a, x: a + x))
