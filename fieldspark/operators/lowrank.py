"""Low-rank factorisations of matrices that are tables. Factors are row tables (i, row ARRAY<DOUBLE>); only matrices of
the rank's size, pivot rows and columns and scalars come to the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import probe_rows, probes
from .common import stored


def _apart(x: DataFrame) -> DataFrame:
    """A table as long as the matrix, kept out of broadcasts: its files may be far smaller than its rows."""
    return x.hint("merge")


def gram(x: DataFrame, y: DataFrame | None = None) -> np.ndarray:
    """X' Y by partial sums of outer products (X' X if y is left out)."""

    def run(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                a, b = (np.array(pdf[c].tolist(), float) for c in ("a", "b"))
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pd.DataFrame({"p": np.arange(total.size), "n": total.shape[1], "v": total.ravel()})

    both = x.select(F.col("row").alias("a"), F.col("row").alias("b")) if y is None else x.select("i", F.col("row").alias("a")).join(_apart(y.select("i", F.col("row").alias("b"))), "i").select("a", "b")
    parts = both.mapInPandas(run, "p long, n long, v double").groupBy("p", "n").agg(F.sum("v").alias("v")).orderBy("p").collect()
    return np.array([r.v for r in parts]).reshape(-1, parts[0].n) if parts else np.zeros((0, 0))


def times(x: DataFrame, m: np.ndarray) -> DataFrame:
    """Row table X M for a small M."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"i": pdf["i"], "row": (np.array(pdf["row"].tolist(), float) @ m).tolist()})

    return x.select("i", "row").mapInPandas(run, "i long, row array<double>")


def to_row_table(x: DataFrame, columns: int) -> DataFrame:
    """(i, row) from (i, k, v) with k in 0..columns-1; missing entries are zero."""
    packed = x.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return packed.select("i", F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("row"))


def from_row_table(x: DataFrame) -> DataFrame:
    return x.select("i", F.posexplode("row").alias("k", "v"))


def row_products(apply, x: DataFrame, columns: int) -> DataFrame:
    """A X as a row table for a row table X of so many columns: by the operator's own `rows`, or by tables (i, k, v)."""
    rows = getattr(apply, "rows", None)
    return rows(x, columns) if rows else to_row_table(apply(from_row_table(x)), columns)


class Factored:
    """The matrix X Y' (row tables) as a function of tables; only numbers of the rank's size leave the tasks."""

    def __init__(self, x: DataFrame, y: DataFrame):
        self.x, self.y = x, y

    def __call__(self, v: DataFrame) -> DataFrame:
        """Of a vector (i, v)."""
        return matvec((self.x, self.y), v)

    def rows(self, v: DataFrame, columns: int) -> DataFrame:
        return times(self.x, gram(self.y, v))


def orthonormal(x: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Q, R with X = Q R by the Gram matrix, twice for accuracy; directions below rounding are dropped."""

    def once(y: DataFrame) -> tuple[DataFrame, np.ndarray]:
        w, u = np.linalg.eigh(gram(y))
        keep = w > w.max(initial=0) * 1e-13
        w, u = w[keep], u[:, keep]
        return stored(times(y, u / np.sqrt(w))), np.sqrt(w)[:, None] * u.T

    q1, r1 = once(x)
    q2, r2 = once(q1)
    return q2, r2 @ r1


def dense_svd(a: DataFrame, rtol: float = 0.0, max_rank: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U, s, V' of a matrix (i, row) with few columns; rank = #(s > rtol s0), at most max_rank, at least one column."""
    w, v = np.linalg.eigh(gram(a))
    w, v = w[::-1], v[:, ::-1]
    s = np.sqrt(np.maximum(w, 0))
    r = min(int((s > rtol * s[0]).sum()) if len(s) and s[0] > 0 else 0, max_rank or len(s))
    if not r:
        return times(a, np.zeros((len(s), 1))), np.zeros(1), np.zeros((1, len(s)))
    return times(a, v[:, :r] / s[:r]), s[:r], v[:, :r].T


def random_svd(apply, apply_t, rows: DataFrame, cols: DataFrame, rank: int, oversample: int = 5, seed: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """U, s, V of a matrix given as functions of tables (i, k, v), or of row tables (see row_products): randomised, two passes."""
    n = rank + oversample
    q, _ = orthonormal(stored(row_products(apply, probe_rows(cols, 0, n, seed), n)))
    b = stored(row_products(apply_t, q, len(q.first()["row"])))  # A' Q, rows are columns of A
    qb, r = orthonormal(b)
    u, s, vt = np.linalg.svd(r.T)
    k = min(rank, len(s))
    return times(q, u[:, :k]), s[:k], times(qb, vt[:k].T)


def range_finder(apply, cols: DataFrame, tol: float, max_rank: int, step: int = 5, seed: int = 0) -> tuple[DataFrame, float]:
    """Orthonormal Q (i, row) grown by `step` probes a round until new probes' residuals fall under tol times the norm
    estimate, and the last relative residual."""
    q, norm, k, error = None, 0.0, 0, 1.0
    while True:
        y = stored(row_products(apply, probe_rows(cols, 0, step, seed + k), step))
        norm = max(norm, float(np.sqrt(np.diag(gram(y)).max(initial=0))))
        if q is not None:
            for _ in range(2):
                c = gram(q, y)
                held = y.join(_apart(q.select("i", F.col("row").alias("q"))), "i", "left")
                y = stored(held.select("i", _minus(c).alias("row")))
        residual = float(np.sqrt(np.diag(gram(y)).max(initial=0)))
        error = residual / norm if norm else 0.0
        if error < tol or k >= max_rank:
            return (q if q is not None else orthonormal(y)[0]), error
        new, _ = orthonormal(y)
        q = new if q is None else stored(_glue(q, new))
        k = len(q.first()["row"])


def _minus(c: np.ndarray):
    """row - q C as a column expression over (row, q)."""
    parts = [F.element_at("row", j + 1) - sum((F.coalesce(F.element_at("q", i + 1), F.lit(0.0)) * float(c[i, j]) for i in range(c.shape[0])), F.lit(0.0)) for j in range(c.shape[1])]
    return F.array(*parts)


def _glue(x: DataFrame, y: DataFrame) -> DataFrame:
    """Columns of y beside those of x."""
    a, b = len(x.first()["row"]), len(y.first()["row"])
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    both = x.select("i", F.col("row").alias("a")).join(y.select("i", F.col("row").alias("b")), "i", "full")
    return both.select("i", F.concat(F.coalesce("a", zeros(a)), F.coalesce("b", zeros(b))).alias("row"))


def recompress(x: DataFrame, y: DataFrame, rtol: float) -> tuple[DataFrame, DataFrame]:
    """X Y' (row tables of both factors) with rank #(s >= rtol s0)."""
    qx, rx = orthonormal(x)
    qy, ry = orthonormal(y)
    u, s, vt = np.linalg.svd(rx @ ry.T)
    r = max(1, int((s >= rtol * s[0]).sum()))
    return times(qx, u[:, :r] * s[:r]), times(qy, vt[:r].T)


def orthogonalise(x: DataFrame, y: DataFrame, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same X Y' with orthonormal columns in X (left) or Y."""
    if left:
        q, r = orthonormal(x)
        return q, times(y, r.T)
    q, r = orthonormal(y)
    return times(x, r.T), q


def plus(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return _glue(a[0], b[0]), _glue(a[1], b[1])


def scaled(a: tuple[DataFrame, DataFrame], c: float) -> tuple[DataFrame, DataFrame]:
    return a[0].select("i", F.transform("row", lambda v: v * c).alias("row")), a[1]


def matvec(a: tuple[DataFrame, DataFrame], x: DataFrame, transpose: bool = False) -> DataFrame:
    """(i, v) of X (Y' x) (or its transpose); x is (i, v)."""
    left, right = a[::-1] if transpose else a
    c = gram(right, x.select("i", F.array("v").alias("row")))
    return times(left, c).select("i", F.element_at("row", 1).alias("v"))


def entrywise(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], rtol: float) -> tuple[DataFrame, DataFrame]:
    """Entrywise product: row-wise Kronecker products of the factors, recompressed."""

    def kron(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.select("i", F.col("row").alias("a")).join(y.select("i", F.col("row").alias("b")), "i")
        return both.select("i", F.flatten(F.transform("a", lambda p: F.transform("b", lambda q: p * q))).alias("row"))

    return recompress(stored(kron(a[0], b[0])), stored(kron(a[1], b[1])), rtol)


def norm_squared(a: tuple[DataFrame, DataFrame]) -> float:
    """Squared Frobenius norm of X Y' by Gram matrices."""
    return float((gram(a[0]) * gram(a[1])).sum())


#: Pivots between two writings of the residual.
PIVOTS = 8


def cross_full(a: DataFrame, rtol: float, min_rank: int = 0, max_rank: int = 200) -> list[tuple[int, int]]:
    """Pivots (i, j) of cross approximation with full pivoting of (i, j, v); see cross_factors for the factors.

    Each step takes the largest absolute residual (ties: smallest i, then j); it stops at ||R|| <= rtol ||A||. The zero
    matrix has no pivots. The entries are stored once as lines along the side with more ids, so a line of a complete table
    is no longer than the root of its entries. A line holds what a step changes in it but for the pivot's line, which
    passes through the driver: steps read the lines without a join or shuffle, take away the pivots since the residual was
    last written, and write it after every PIVOTS.
    """
    entries = a.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).dropna()
    n = entries.agg(F.approx_count_distinct("i"), F.approx_count_distinct("j")).first()
    line, place = ("i", "j") if n[0] >= n[1] else ("j", "i")
    lines = entries.groupBy(F.col(line).alias("line")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), "v"))).alias("e"))
    rest = stored(lines.select("line", F.col("e.p").alias("p"), F.col("e.v").alias("v")))
    pivots, taken = [], []  # taken: (place, value, places of the pivot's line, values there) since the last writing
    shape = "line long, p array<long>, v array<double>"

    def residual(batch, taken):
        """Bounds of the lines, places and what is left of their values."""
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())])
        p, v = (batch.column(c).flatten().to_numpy() for c in (1, 2))
        v, of = v.copy(), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for at, pivot, places, values in taken:
            here = np.flatnonzero(p == at)
            c = np.zeros(len(ends) - 1)
            c[of[here]] = v[here]
            k = np.minimum(np.searchsorted(places, p), len(places) - 1)
            v -= np.where(places[k] == p, values[k], 0.0) * c[of] / pivot
        return ends, of, p, v

    def largest(taken):
        def run(batches):
            total, best = 0.0, None
            for batch in batches:
                if batch.num_rows:
                    _, of, p, v = residual(batch, taken)
                    total += float(v @ v)
                    size = np.abs(v)
                    tied = np.flatnonzero(size == size.max(initial=0.0))
                    if len(tied):
                        ids = batch.column(0).to_numpy()[of[tied]], p[tied]
                        i, j = ids if line == "i" else ids[::-1]
                        one = np.lexsort((j, i))[0]
                        found = (-float(size[tied[one]]), int(i[one]), int(j[one]), float(v[tied[one]]))
                        best = found if best is None else min(best, found)
            if best is not None:
                yield pa.RecordBatch.from_pydict({"s": [total], "size": [-best[0]], "i": [best[1]], "j": [best[2]], "v": [best[3]]})

        return run

    def written(taken):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    ends, _, p, v = residual(batch, taken)
                    offsets = pa.array(ends, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(p)), pa.ListArray.from_arrays(offsets, pa.array(v))], names=["line", "p", "v"])

        return run

    norm = None
    while len(pivots) < max_rank:
        tops = rest.mapInArrow(largest(taken), "s double, size double, i long, j long, v double")
        row = tops.agg(F.sum("s").alias("s"), F.max_by(F.struct("i", "j", "v"), F.struct("size", -F.col("i"), -F.col("j"))).alias("p")).first()
        norm = math.sqrt(row.s or 0.0) if norm is None else norm
        if not row.s or (math.sqrt(row.s) <= rtol * norm and len(pivots) >= min_rank):
            break
        i, j, v = row.p
        pivots.append((i, j))
        mine, at = (i, j) if line == "i" else (j, i)
        held = next(iter(rest.where(F.col("line") == mine).mapInArrow(written(taken), shape).collect()))
        taken.append((at, v, np.array(held.p, np.int64), np.array(held.v, np.float64)))
        if len(taken) == PIVOTS:
            rest, taken = stored(rest.mapInArrow(written(taken), shape)), []
    return pivots


def cross_factors(a: DataFrame, pivots: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """(X, Y) with X Y' = A[:, J] A[I, J]^-1 A[I, :] for pivot rows I and columns J."""
    rows, cols = [p[0] for p in pivots], [p[1] for p in pivots]
    return cur(a, rows, cols)


def cur(a: DataFrame, rows: list[int], cols: list[int]) -> tuple[DataFrame, DataFrame]:
    """(X, Y) with X Y' = C pinv(U) R for sampled rows and columns."""
    spark = a.sparkSession
    row_no = spark.createDataFrame([(int(i), k) for k, i in enumerate(rows)], "i long, r int")
    col_no = spark.createDataFrame([(int(j), k) for k, j in enumerate(cols)], "j long, k int")
    c = a.join(F.broadcast(col_no), "j").select("i", "k", "v")
    r = a.join(F.broadcast(row_no), "i").select(F.col("j").alias("i"), F.col("r").alias("k"), "v")
    u = np.zeros((len(rows), len(cols)))
    for x in a.join(F.broadcast(row_no), "i").join(F.broadcast(col_no), "j").select("r", "k", "v").collect():
        u[x.r, x.k] = x.v
    return times(to_row_table(c, len(cols)), np.linalg.pinv(u)), to_row_table(r, len(rows))


def cur_error(a: DataFrame, factors: tuple[DataFrame, DataFrame]) -> float:
    """Relative Frobenius error of X Y' on the entries of a complete table (i, j, v)."""
    x, y = factors
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    both = a.join(x.select("i", F.col("row").alias("x")), "i", "left").join(y.select(F.col("i").alias("j"), F.col("row").alias("y")), "j", "left")
    d = F.col("v") - F.coalesce(dot, F.lit(0.0))
    r = both.agg(F.sum(d * d).alias("e"), F.sum(F.col("v") * F.col("v")).alias("t")).first()
    return math.sqrt(r.e / r.t) if r.t else 0.0


def alternate(a: DataFrame, rank: int, sweeps: int = 10, ridge: float = 1e-8, seed: int = 0, decay: float = 1.0, tol: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Row tables X, Y fitted to known entries (i, j, v) by alternating least squares; the ridge shrinks by `decay` a sweep.

    Each half sweep joins the entries with one factor and sums every row's normal equations before they are solved. With a
    tol over 0 the sweeps end when the residual, relative to the entries, is at most tol or no longer shrinks by a
    thousandth; a residual over tol is then the best that this start comes to. `fit_error` returns it.
    """
    a = stored(a.select("i", "j", "v").repartition("i").sortWithinPartitions("i"))  # a row's entries together: its sums end in the task that reads them
    y = stored(to_row_table(probes(a.select(F.col("j").alias("i")).distinct(), rank, seed), rank))
    x = None

    def half(entries: DataFrame, other: DataFrame, weight: float) -> DataFrame:
        pairs = [(p, q) for p in range(rank) for q in range(p + 1)]
        rows = entries.join(other.select(F.col("i").alias("j"), F.col("row").alias("o")), "j")
        e = lambda p: F.element_at("o", p + 1)
        sums = rows.groupBy("i").agg(F.array(*(F.sum(e(p) * e(q)) for p, q in pairs)).alias("g"), F.array(*(F.sum(e(p) * F.col("v")) for p in range(rank))).alias("b"))

        def solve(batches):
            for pdf in batches:
                if len(pdf):
                    g = np.zeros((len(pdf), rank, rank))
                    flat = np.array(pdf["g"].tolist(), float)
                    for k, (p, q) in enumerate(pairs):
                        g[:, p, q] = g[:, q, p] = flat[:, k]
                    g += weight * np.eye(rank)
                    yield pd.DataFrame({"i": pdf["i"], "row": np.linalg.solve(g, np.array(pdf["b"].tolist(), float)[:, :, None])[:, :, 0].tolist()})

        return stored(sums.mapInPandas(solve, "i long, row array<double>"))

    flipped, last = a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), None
    for s in range(sweeps):
        x = half(a, y, ridge * decay**s)
        y = half(flipped, x, ridge * decay**s)
        if tol > 0:
            error = fit_error(a, (x, y))
            if error <= tol or (last is not None and error > 0.999 * last):
                break
            last = error
    return x, y


def fit_error(a: DataFrame, factors: tuple[DataFrame, DataFrame]) -> float:
    """Norm of the known entries (i, j, v) less X Y', relative to their own; 0 where all are zero and fitted as such."""
    x, y = (f.select(F.col("i").alias(n), F.col("row").alias("_" + n)) for f, n in zip(factors, "ij"))
    gap = F.col("v") - F.aggregate(F.zip_with("_i", "_j", lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    row = a.join(x, "i").join(y, "j").agg(F.sum(gap * gap).alias("e"), F.sum(F.col("v") * F.col("v")).alias("n")).first()
    return 0.0 if not row["e"] else float(np.sqrt(row["e"] / row["n"])) if row["n"] else float("inf")


def generalised_svd(a: DataFrame, weights: DataFrame, m: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """U, s, V with A' N A V = M V s^2 and U = A V / s, for A (i, row), diagonal N (i, w) and a small M."""
    scaled_a = a.join(weights, "i").select("i", F.transform("row", lambda x: x * F.sqrt("w")).alias("row"))
    l = np.linalg.cholesky(m)
    inv = np.linalg.inv(l)
    w, z = np.linalg.eigh(inv @ gram(scaled_a) @ inv.T)
    s = np.sqrt(np.maximum(w[::-1], 0))
    v = (inv.T @ z)[:, ::-1]
    keep = s > s.max(initial=0) * 1e-12
    return times(a, v[:, keep] / s[keep]), s[keep], v[:, keep]
