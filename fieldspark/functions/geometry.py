"""Predicates and projections on points, boxes and ellipsoids held as flat or array columns."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(p: list[Column], lo: list, hi: list) -> Column:
    """lo <= p <= hi on all axes; on flat columns and constants it reaches the Parquet scan."""
    return reduce(and_, [(x >= a) & (x <= b) for x, a, b in zip(p, lo, hi)])


def in_ellipsoid(p: list[Column], mu: list[float], sigma, tau: float, inclusive: bool = True) -> Column:
    """(p - mu)' sigma^-1 (p - mu) <= tau^2 (or <), behind the ellipsoid's bounding box so that scans prune."""
    inv = np.linalg.inv(np.asarray(sigma, float))
    d = [x - F.lit(float(m)) for x, m in zip(p, mu)]
    q = sum((d[i] * d[j] * float(inv[i, j]) for i in range(len(d)) for j in range(len(d))), F.lit(0.0))
    r = [float(tau * np.sqrt(np.asarray(sigma)[i][i])) for i in range(len(d))]
    box = in_box(p, [F.lit(m - s) for m, s in zip(mu, r)], [F.lit(m + s) for m, s in zip(mu, r)])
    return box & ((q <= tau * tau) if inclusive else (q < tau * tau))


def ellipsoid_box(mu: Column, diagonal: Column, tau) -> tuple[Column, Column]:
    """Corners mu -+ tau sqrt(diag sigma) from array columns."""
    r = F.transform(diagonal, lambda s: F.sqrt(s) * tau)
    return F.zip_with(mu, r, lambda m, x: m - x), F.zip_with(mu, r, lambda m, x: m + x)


def snap(x: Column, p, h, up: bool, rtol: float = 1e-12) -> Column:
    """The next lattice point p + h Z outwards from x; x itself if it is on the lattice to rtol."""
    k = (x - p) / h
    near = F.rint(k)
    on = F.abs(k - near) <= F.lit(rtol) * F.greatest(F.lit(1.0), F.abs(near))
    return F.when(on, x).otherwise((F.ceil(k) if up else F.floor(k)).cast("double") * h + p)


def conforming_box(lo: list[Column], hi: list[Column], p: list, h: list) -> tuple[list[Column], list[Column], list[Column]]:
    """Box snapped outwards to the lattice, and its number of gridpoints on each axis."""
    a = [snap(x, q, s, False) for x, q, s in zip(lo, p, h)]
    b = [snap(x, q, s, True) for x, q, s in zip(hi, p, h)]
    return a, b, [(F.rint((y - x) / s) + 1).cast("long") for x, y, s in zip(a, b, h)]


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((x * x for x in parts), F.lit(0.0)))


def divisible(width: list[Column], h: list, tol: float = 1e-10) -> Column:
    """Whether widths are whole multiples of h, to tol in the 2-norm over the axes."""
    return _norm([w - F.rint(w / s) * s for w, s in zip(width, h)]) < tol


def same_spacing(h1: list[Column], h2: list, tol: float = 1e-10) -> Column:
    return _norm([a - b for a, b in zip(h1, h2)]) < tol


def unshifted(lo1: list[Column], lo2: list, h: list, tol: float = 1e-10) -> Column:
    """Whether two lattices of spacing h coincide."""
    return divisible([a - b for a, b in zip(lo1, lo2)], h, tol)


def nearest_index(p: Column, lo, h) -> Column:
    """Index of the nearest gridpoint; halves go to even."""
    return F.rint((p - lo) / h).cast("long")


def widths(lo: Column, hi: Column) -> Column:
    return F.zip_with(hi, lo, lambda b, a: b - a)


def widest_axis(lo: Column, hi: Column) -> Column:
    w = widths(lo, hi)
    return (F.array_position(w, F.array_max(w)) - 1).cast("int")


def narrowest_axis(lo: Column, hi: Column) -> Column:
    w = widths(lo, hi)
    return (F.array_position(w, F.array_min(w)) - 1).cast("int")


def diameter(lo: Column, hi: Column) -> Column:
    return F.sqrt(F.aggregate(widths(lo, hi), F.lit(0.0), lambda s, x: s + x * x))


def box_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Distance between two boxes; 0 if they meet."""
    gap = F.zip_with(F.zip_with(lo1, hi2, lambda a, b: a - b), F.zip_with(lo2, hi1, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


def range_size(start: Column, stop: Column) -> Column:
    return stop - start


def range_contains(start: Column, stop: Column, i: Column) -> Column:
    return (i >= start) & (i < stop)


def range_subset(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Whether [a0, a1) lies in [b0, b1)."""
    return (a0 >= b0) & (a1 <= b1)


def ranges_meet(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a0, b0) < F.least(a1, b1)
