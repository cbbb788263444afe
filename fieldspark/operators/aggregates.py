"""Aggregations over points, boxes, grids and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounding_box(df: DataFrame, lo: list[str], hi: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """lo_i, hi_i over points (lo only) or boxes, by group; nulls are skipped."""
    hi = hi or lo
    return df.groupBy(*(by or [])).agg(*(F.min(a).alias(f"lo_{i}") for i, a in enumerate(lo)), *(F.max(b).alias(f"hi_{i}") for i, b in enumerate(hi)))


def support_box(df: DataFrame, axes: list[str], value: str, by: list[str] | None = None, rtol: float = 1e-3, atol: float = 1e-6) -> DataFrame:
    """Box of the points with abs(u)/max(abs(u)) > rtol and abs(u) > atol; nulls where no point counts."""
    by = by or []
    top = df.groupBy(*by).agg(F.max(F.abs(value)).alias("_top"))
    rows = df.join(top, by) if by else df.join(F.broadcast(top))
    on = (F.abs(value) > rtol * F.col("_top")) & (F.abs(value) > atol)
    return rows.groupBy(*by).agg(*(F.min(F.when(on, F.col(a))).alias(f"lo_{i}") for i, a in enumerate(axes)), *(F.max(F.when(on, F.col(a))).alias(f"hi_{i}") for i, a in enumerate(axes)))


def integral(grid: DataFrame, cell_volume: float, value: str = "v", by: list[str] | None = None) -> DataFrame:
    return grid.groupBy(*(by or [])).agg((F.sum(value) * F.lit(cell_volume)).alias("integral"))


def inner_product(f: DataFrame, g: DataFrame, index: list[str], cell_volume: float, value: str = "v") -> DataFrame:
    """Integral of f times conj(g) over the common lattice points; values are numbers or STRUCT<re, im>."""
    pairs = f.select(*index, F.col(value).alias("_f")).join(g.select(*index, F.col(value).alias("_g")), index)
    if isinstance(f.schema[value].dataType.typeName(), str) and f.schema[value].dataType.typeName() == "struct":
        re = F.col("_f.re") * F.col("_g.re") + F.col("_f.im") * F.col("_g.im")
        im = F.col("_f.im") * F.col("_g.re") - F.col("_f.re") * F.col("_g.im")
        return pairs.agg((F.sum(re) * cell_volume).alias("re"), (F.sum(im) * cell_volume).alias("im"))
    return pairs.agg((F.sum(F.col("_f") * F.col("_g")) * cell_volume).alias("inner"))


def mass_integral(grid: DataFrame, index: list[str], shape: list[int], spacing: list[float], value: str = "v", trapezoid: bool = False) -> DataFrame:
    """Integral with diagonal mass weights: h at every point, or h/2 at the ends with the trapezoid rule.

    Without the trapezoid rule the ends count fully, so a constant integrates to more than its box.
    """
    w: Column = F.lit(1.0)
    for i, n, h in zip(index, shape, spacing):
        end = (F.col(i) == 0) | (F.col(i) == n - 1)
        w = w * (F.when(end, h / 2).otherwise(h) if trapezoid else F.lit(h))
    return grid.agg(F.sum(w * F.col(value)).alias("integral"))


def relative_errors(df: DataFrame, leaf: list[str], true: str, got: str) -> DataFrame:
    """By leaf: relative squared error and misfit (half the squared error)."""
    d = F.col(true) - F.col(got)
    return df.groupBy(*leaf).agg((F.sum(d * d) / F.sum(F.col(true) * F.col(true))).alias("relative"), (F.sum(d * d) / 2).alias("misfit"))


def truth(df: DataFrame, flags: list[str], by: list[str] | None = None) -> DataFrame:
    """all_x and any_x of boolean columns."""
    return df.groupBy(*(by or [])).agg(*(F.bool_and(c).alias("all_" + c) for c in flags), *(F.bool_or(c).alias("any_" + c) for c in flags))


def bad_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether any of the columns holds NaN or an infinity anywhere."""
    bad = F.lit(False)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))


def normal(row: Column, sample: Column, seed: int = 0) -> Column:
    """A standard normal number fixed by (row, sample, seed), so results don't depend on partitioning."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), row, sample), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))


def probes(ids: DataFrame, samples: int, seed: int = 0, name: str = "i") -> DataFrame:
    """(i, k, v): Gaussian probe vectors over an index table."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")
    return ids.select(F.col(name).alias("i"), k).withColumn("v", normal(F.col("i"), F.col("k"), seed))


def probe_rows(ids: DataFrame, start: int, stop: int, seed: int = 0) -> DataFrame:
    """(i, row): the probes start to stop - 1 of every id side by side, the same numbers as in `probes`."""
    return ids.select("i", F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda k: normal(F.col("i"), k, seed)).alias("row"))


def hutchinson_diagonal(apply, ids: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """(i, d): mean over Gaussian probes of z * (A z); apply maps (i, k, v) to (i, k, v), or row tables by its `rows`."""
    from .lowrank import row_products

    z = probe_rows(ids, 0, samples, seed)
    az = row_products(apply, z, samples).select("i", F.col("row").alias("az"))
    dot = F.aggregate(F.zip_with("row", "az", lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    return z.join(az.hint("merge"), "i", "left").select("i", (F.coalesce(dot, F.lit(0.0)) / samples).alias("d"))


def compare_operators(apply_a, apply_b, ids: DataFrame, samples: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Randomised comparison: overall relative error of B against A, and the relative error of each output row."""
    z = probes(ids, samples, seed)
    a, b = apply_a(z).withColumnRenamed("v", "va"), apply_b(z).withColumnRenamed("v", "vb")
    both = a.join(b, ["i", "k"], "full").select("i", F.coalesce("va", F.lit(0.0)).alias("va"), F.coalesce("vb", F.lit(0.0)).alias("vb"))
    d = F.col("va") - F.col("vb")
    error = F.sqrt(F.sum(d * d) / F.sum(F.col("va") * F.col("va"))).alias("error")
    return both.agg(error), both.groupBy("i").agg(error)
