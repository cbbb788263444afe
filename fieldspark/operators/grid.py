"""Regular-grid fields as tables (index columns and v), with their box, shape and spacing beside them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")


@dataclass(frozen=True)
class Grid:
    """A field: rows (i, j, .., v) with one row a gridpoint, on the box lo..hi with `shape` gridpoints a side."""

    df: DataFrame
    lo: tuple[float, ...]
    hi: tuple[float, ...]
    shape: tuple[int, ...]

    @property
    def index(self) -> list[str]:
        return list(AXES[: len(self.shape)])

    @property
    def h(self) -> list[float]:
        return [(b - a) / (n - 1) for a, b, n in zip(self.lo, self.hi, self.shape)]

    @property
    def cell_volume(self) -> float:
        return math.prod(self.h)

    def with_v(self, v: Column) -> Grid:
        return Grid(self.df.withColumn("v", v), self.lo, self.hi, self.shape)


def lattice(spark: SparkSession, shape: tuple[int, ...]) -> DataFrame:
    """All index tuples in row-major order (first axis slowest)."""
    df, rest = spark.range(math.prod(shape)), math.prod(shape)
    cols = []
    for a, n in zip(AXES, shape):
        rest //= n
        cols.append((F.floor(F.col("id") / rest) % n).cast("long").alias(a))
    return df.select(*cols)


def coordinate(index: Column, lo: float, hi: float, n: int) -> Column:
    """linspace: the last point is hi exactly."""
    return F.when(index == n - 1, F.lit(float(hi))).otherwise(F.lit(float(lo)) + index * ((hi - lo) / (n - 1) if n > 1 else 0.0))


def regular_grid(spark: SparkSession, lo, hi, shape) -> DataFrame:
    """Index tuples with coordinates x0, x1, .. ."""
    df = lattice(spark, tuple(shape))
    return df.select("*", *(coordinate(F.col(a), l, u, n).alias(f"x{d}") for d, (a, l, u, n) in enumerate(zip(AXES, lo, hi, shape))))


def scale(g: Grid, c: float) -> Grid:
    return g.with_v(F.col("v") * c)


def divide(g: Grid, c) -> Grid:
    """Division by a number; dividing by a grid is an error."""
    if isinstance(c, Grid):
        raise TypeError("a grid can't be divided by a grid")
    return g.with_v(F.col("v") / c)


def negate(g: Grid) -> Grid:
    return g.with_v(-F.col("v"))


def _shift(f: Grid, g: Grid) -> list[int]:
    """Offset of g's lattice against f's; raises if they don't conform."""
    if math.sqrt(sum((a - b) ** 2 for a, b in zip(f.h, g.h))) >= 1e-10:
        raise ValueError("grids of different spacing")
    k = [(b - a) / h for a, b, h in zip(f.lo, g.lo, f.h)]
    if math.sqrt(sum(((x - round(x)) * h) ** 2 for x, h in zip(k, f.h))) >= 1e-10:
        raise ValueError("grids are shifted against each other")
    return [round(x) for x in k]


def _box(f: Grid, lo: list[int], hi: list[int]) -> tuple[tuple, tuple, tuple]:
    """Box and shape of the lattice range lo..hi in f's indices."""
    h = f.h
    return tuple(a + l * s for a, l, s in zip(f.lo, lo, h)), tuple(a + u * s for a, u, s in zip(f.lo, hi, h)), tuple(u - l + 1 for l, u in zip(lo, hi))


def _moved(g: Grid, by: list[int], name: str = "v") -> DataFrame:
    return g.df.select(*((F.col(a) + F.lit(b).cast("long")).alias(a) for a, b in zip(g.index, by)), F.col("v").alias(name))


def add(f: Grid, g: Grid, sign: float = 1.0) -> Grid:
    """f + sign * g on the union box, zero where neither is."""
    s = _shift(f, g)
    lo = [min(0, x) for x in s]
    hi = [max(n - 1, x + m - 1) for n, x, m in zip(f.shape, s, g.shape)]
    a, b, shape = _box(f, lo, hi)
    both = _moved(f, [-x for x in lo]).union(_moved(g.with_v(F.col("v") * sign), [x - l for x, l in zip(s, lo)]))
    sums = both.groupBy(*f.index).agg(F.sum("v").alias("v"))
    full = lattice(f.df.sparkSession, shape).join(sums, f.index, "left").select(*f.index, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(full, a, b, shape)


def subtract(f: Grid, g: Grid) -> Grid:
    return add(f, g, -1.0)


def multiply(f: Grid, g: Grid) -> Grid:
    """f * g on the intersection box."""
    s = _shift(f, g)
    lo, hi = [max(0, x) for x in s], [min(n - 1, x + m - 1) for n, x, m in zip(f.shape, s, g.shape)]
    a, b, shape = _box(f, lo, hi)
    pairs = _moved(f, [-x for x in lo], "_f").join(_moved(g, [x - l for x, l in zip(s, lo)], "_g"), f.index)
    return Grid(pairs.select(*f.index, (F.col("_f") * F.col("_g")).alias("v")), a, b, shape)


def _corners(g: Grid, points: DataFrame, axes: list[str], widen: float) -> DataFrame:
    """Points with one row for each of the 2^d corners of their cell: index columns, `_w`, and `_in` (inside the box)."""
    rows = points
    inside = reduce(lambda x, y: x & y, [(F.col(c) >= a - widen) & (F.col(c) <= b + widen) for c, a, b in zip(axes, g.lo, g.hi)])
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False)))
    weight: Column = F.lit(1.0)
    for d, (c, a, h, n, name) in enumerate(zip(axes, g.lo, g.h, g.shape, g.index)):
        t = (F.col(c) - a) / h
        base = F.greatest(F.lit(0), F.least(F.floor(t), F.lit(n - 2))).cast("long")
        rows = rows.withColumns({f"_b{d}": base, f"_t{d}": F.greatest(F.lit(0.0), F.least(t - base, F.lit(1.0)))})
        rows = rows.withColumn(f"_o{d}", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        weight = weight * F.when(F.col(f"_o{d}") == 1, F.col(f"_t{d}")).otherwise(1 - F.col(f"_t{d}"))
    dims = range(len(axes))
    rows = rows.withColumn("_w", weight).withColumns({name: F.col(f"_b{d}") + F.col(f"_o{d}") for d, name in enumerate(g.index)})
    return rows.drop(*(f"_{x}{d}" for d in dims for x in "bto"))


def interpolate(g: Grid, points: DataFrame, axes: list[str], key: str = "id", method: str = "linear", fill: float = 0.0, widen: float = 1e-15) -> DataFrame:
    """(key, v): the field at each point, `fill` outside the box. NaN at any corner of a cell gives NaN in it.

    Gridpoints without a row count as zero. Only the corners of the points' cells are joined, by index.
    """
    if method == "nearest":
        rows = points.select(F.col(key), *axes).withColumn("_in", reduce(lambda x, y: x & y, [(F.col(c) >= a - widen) & (F.col(c) <= b + widen) for c, a, b in zip(axes, g.lo, g.hi)]))
        rows = rows.withColumns({n: F.greatest(F.lit(0), F.least(F.rint((F.col(c) - a) / h), F.lit(m - 1))).cast("long") for n, c, a, h, m in zip(g.index, axes, g.lo, g.h, g.shape)})
        got = rows.join(g.df, g.index, "left")
        return got.select(key, F.when(F.col("_in"), F.coalesce("v", F.lit(0.0))).otherwise(F.lit(fill)).alias("v"))
    rows = _corners(g, points.select(F.col(key), *axes), axes, widen)
    got = rows.join(g.df, g.index, "left")
    sums = got.groupBy(key, "_in").agg(F.sum(F.col("_w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return sums.select(key, F.when(F.col("_in"), F.col("v")).otherwise(F.lit(fill)).alias("v"))


def interpolation_matrix(g: Grid, points: DataFrame, axes: list[str], key: str = "id") -> DataFrame:
    """(i, j, v): rows are points, columns gridpoints in row-major order; points outside have no entries."""
    rows = _corners(g, points.select(F.col(key).alias("_p"), *axes), axes, 1e-15).where(F.col("_in") & (F.col("_w") != 0))
    flat: Column = F.lit(0).cast("long")
    for a, n in zip(g.index, g.shape):
        flat = flat * n + F.col(a)
    return rows.select(F.col("_p").alias("_row"), flat.alias("_col"), "_w").groupBy(F.col("_row").alias("i"), F.col("_col").alias("j")).agg(F.sum("_w").alias("v"))


def restrict(g: Grid, lo: list[int], hi: list[int]) -> Grid:
    """Crop or zero-pad to the lattice range lo..hi of g's own indices."""
    a, b, shape = _box(g, lo, hi)
    moved = _moved(g, [-x for x in lo])
    full = lattice(g.df.sparkSession, shape).join(moved, g.index, "left").select(*g.index, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(full, a, b, shape)


def mosaic(sources: list[Grid], expand: bool = True) -> Grid:
    """Lattice of source 0 over all boxes (or its own): each point takes the first source that isn't NaN there."""
    s0 = sources[0]
    if expand:
        lo = [min(math.floor((s.lo[d] - s0.lo[d]) / s0.h[d] + 1e-12) for s in sources) for d in range(len(s0.shape))]
        hi = [max(math.ceil((s.hi[d] - s0.lo[d]) / s0.h[d] - 1e-12) for s in sources) for d in range(len(s0.shape))]
    else:
        lo, hi = [0] * len(s0.shape), [n - 1 for n in s0.shape]
    a, b, shape = _box(s0, lo, hi)
    spark = s0.df.sparkSession
    pts = regular_grid(spark, a, b, shape)
    key = F.struct(*s0.index)
    pts = pts.select(key.alias("id"), *(f"x{d}" for d in range(len(shape))))
    axes = [f"x{d}" for d in range(len(shape))]
    nan = float("nan")
    tries = [interpolate(s, pts, axes, fill=nan, widen=1e-12).select("id", F.lit(r).alias("rank"), "v") for r, s in enumerate(sources)]
    every = reduce(DataFrame.union, tries)
    best = every.groupBy("id").agg(F.min_by(F.col("v"), F.when(~F.isnan("v"), F.col("rank"))).alias("v"))
    return Grid(best.select(*(F.col(f"id.{i}").alias(i) for i in s0.index), F.coalesce("v", F.lit(nan)).alias("v")), a, b, shape)


def translate(g: Grid, by: list[float]) -> Grid:
    return Grid(g.df, tuple(a + d for a, d in zip(g.lo, by)), tuple(b + d for b, d in zip(g.hi, by)), g.shape)


def flip(g: Grid) -> Grid:
    """The field of -x."""
    df = g.df.select(*((F.lit(n - 1) - F.col(a)).cast("long").alias(a) for a, n in zip(g.index, g.shape)), "v")
    return Grid(df, tuple(-b for b in g.hi), tuple(-a for a in g.lo), g.shape)


#: Kernel points that a row of the grid meets at once.
TAPS = 4096


def convolve(f: Grid, g: Grid, checks: bool = False) -> Grid:
    """Full discrete convolution times the cell volume; boxes add. g is the kernel: each of f's points is spread over it.

    The kernel is joined to every row of f, so it must be the small one; it is broadcast only under Spark's threshold.
    """
    if math.sqrt(sum((a - b) ** 2 for a, b in zip(f.h, g.h))) >= 1e-10:
        raise ValueError("grids of different spacing")
    if checks:
        _shift(f, g)
    taps = g.df.where("v <> 0")
    n = max(1, -(-taps.count() // TAPS))
    kernel = taps.select(F.struct(*(F.col(a).alias(a) for a in g.index), F.col("v").alias("w")).alias("t"), F.pmod(F.hash(*g.index), F.lit(n)).alias("part"))
    packs = kernel.groupBy("part").agg(F.collect_list("t").alias("taps"))  # n packs of some TAPS taps
    spread = f.df.where("v <> 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(packs, "part").select(*f.index, "v", F.explode("taps").alias("t"))
    sums = spread.select(*((F.col(a) + F.col(f"t.{a}")).alias(a) for a in f.index), (F.col("v") * F.col("t.w")).alias("x")).groupBy(*f.index).agg((F.sum("x") * f.cell_volume).alias("v"))
    shape = tuple(n + m - 1 for n, m in zip(f.shape, g.shape))
    full = lattice(f.df.sparkSession, shape).join(sums, f.index, "left").select(*f.index, F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(full, tuple(a + b for a, b in zip(f.lo, g.lo)), tuple(a + b for a, b in zip(f.hi, g.hi)), shape)


def convolve_centred(f: Grid, g: Grid, p1: list[float], p2: list[float]) -> Grid:
    """Convolution of f centred at p1 and g centred at p2."""
    return convolve(translate(f, [-x for x in p1]), translate(g, [-x for x in p2]))


def rasterise(ellipsoids: DataFrame, spark: SparkSession, lo, hi, shape, tau: float = 1.0, level: str | None = None, inclusive: bool = True) -> Grid:
    """Sum over the ellipses (mx, my, sxx, sxy, syy) of level (default 1) at the gridpoints inside them; 2-D."""
    h = [(b - a) / (n - 1) for a, b, n in zip(lo, hi, shape)]
    rows = ellipsoids.withColumn("_level", F.col(level).cast("double") if level else F.lit(1.0))
    for a, m, s, l, d, n in zip("ij", ("mx", "my"), ("sxx", "syy"), lo, h, shape):
        r = tau * F.sqrt(s)
        first, last = F.greatest(F.ceil((F.col(m) - r - l) / d - 1e-9), F.lit(0)), F.least(F.floor((F.col(m) + r - l) / d + 1e-9), F.lit(n - 1))
        rows = rows.where(first <= last).withColumn(a, F.explode(F.sequence(first, last)))
    dx, dy = (F.lit(l) + F.col(a) * d - F.col(m) for a, m, l, d in zip("ij", ("mx", "my"), lo, h))
    q = dx * dx * F.col("syy") - 2 * dx * dy * F.col("sxy") + dy * dy * F.col("sxx")
    det = (F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")) * tau * tau
    sums = rows.where((q <= det) if inclusive else (q < det)).groupBy("i", "j").agg(F.sum("_level").alias("v"))
    full = lattice(spark, tuple(shape)).join(sums, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
    return Grid(full, tuple(lo), tuple(hi), tuple(shape))


def laplacian(spark: SparkSession, shape: list[int], h: list[float], sides: list[tuple[str, str]]) -> DataFrame:
    """(i, j, v) of the negative Laplacian, rows in row-major order; sides: (left, right) of dirichlet, neumann, periodic.

    Diagonal 2/h^2 an axis (1/h^2 at a Neumann end), -1/h^2 to neighbours, wrapped if periodic; periodic on one side only
    is an error.
    """
    for a, b in sides:
        if (a == "periodic") != (b == "periodic"):
            raise ValueError("an axis is periodic on both sides or on none")
    pts = lattice(spark, tuple(shape))
    strides = [math.prod(shape[d + 1 :]) for d in range(len(shape))]
    flat = reduce(lambda x, y: x + y, [F.col(a) * s for a, s in zip(AXES, strides)])
    entries = []
    for a, n, d, s, (left, right) in zip(AXES, shape, h, strides, sides):
        x, w = F.col(a), 1.0 / (d * d)
        ends = F.when((x == 0) & F.lit(left == "neumann"), 1).otherwise(0) + F.when((x == n - 1) & F.lit(right == "neumann"), 1).otherwise(0)
        entries.append(F.struct(F.lit(0).cast("long").alias("o"), ((2 - ends) * w).cast("double").alias("v")))
        for step in (-1, 1):
            inside = (x + step >= 0) & (x + step < n)
            wrap = F.lit(left == "periodic")
            entries.append(F.when(inside, F.struct(F.lit(step * s).cast("long").alias("o"), F.lit(-w).alias("v"))).when(wrap, F.struct(F.lit(-step * s * (n - 1)).cast("long").alias("o"), F.lit(-w).alias("v"))))
    rows = pts.select(flat.cast("long").alias("i"), F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
    return rows.select("i", (F.col("i") + F.col("e.o")).alias("j"), F.col("e.v").alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def smoothing_operator(spark: SparkSession, shape: list[int], h: list[float], nu: float, length: float, gamma: float = 1.0) -> DataFrame:
    """(i, j, v) of gamma K + alpha M with alpha = 8 nu / length^2, Neumann sides and uniform mass weights.

    The field's deviation does not enter (as in the reference results); smooth by solving with it.
    """
    vol = math.prod(h)
    k = laplacian(spark, shape, h, [("neumann", "neumann")] * len(shape)).select("i", "j", (F.col("v") * vol * gamma).alias("v"))
    m = spark.range(math.prod(shape)).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(vol * 8 * nu / length**2).alias("v"))
    return k.union(m).groupBy("i", "j").agg(F.sum("v").alias("v"))


def grid_patch(points: DataFrame, axes: list[str], spacing: float, density: float = 1.0) -> tuple[list[float], list[float], list[int]]:
    """Box and shape of a lattice around the points' bounding box with spacing / density, snapped outwards from its corner."""
    h = spacing / density
    row = points.agg(*(F.min(a).alias("lo" + a) for a in axes), *(F.max(a).alias("hi" + a) for a in axes)).first()
    lo = [float(row["lo" + a]) for a in axes]
    shape = [int(math.ceil((float(row["hi" + a]) - l) / h - 1e-12)) + 1 for a, l in zip(axes, lo)]
    return lo, [l + (n - 1) * h for l, n in zip(lo, shape)], [max(n, 2) for n in shape]


def local_frames(entities: DataFrame, n: tuple[int, int], tau: float, mu: tuple[str, str] = ("mx", "my"), s: tuple[str, str, str] = ("sxx", "sxy", "syy")) -> DataFrame:
    """Entities with one row (a, b, x, y) for each point of an n0 x n1 window over [-1, 1]^2, stretched by tau times the
    roots of the eigenvalues of the covariance, turned to its axes and moved to the mean."""
    sxx, sxy, syy = map(F.col, s)
    mid, dif = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    theta = F.atan2(2 * sxy, sxx - syy) / 2
    big, small = F.sqrt(mid + dif) * tau, F.sqrt(F.greatest(mid - dif, F.lit(0.0))) * tau
    rows = entities.select("*", F.explode(F.sequence(F.lit(0), F.lit(n[0] - 1))).alias("a")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n[1] - 1))).alias("b"))
    u, w = big * (2 * F.col("a") / (n[0] - 1) - 1), small * (2 * F.col("b") / (n[1] - 1) - 1)
    return rows.withColumns({"x": F.col(mu[0]) + u * F.cos(theta) - w * F.sin(theta), "y": F.col(mu[1]) + u * F.sin(theta) + w * F.cos(theta)})


def sample_frames(frames: DataFrame, g: Grid, key: str, volume: str, fill: float = 0.0) -> DataFrame:
    """(key, a, b, v): the field at the points of local_frames rows, divided by each entity's volume column."""
    pts = frames.select(F.struct(key, "a", "b").alias("id"), "x", "y")
    got = interpolate(g, pts, ["x", "y"], fill=fill).select("id.*", "v")
    return got.join(frames.select(key, "a", "b", volume), [key, "a", "b"]).select(key, "a", "b", (F.col("v") / F.col(volume)).alias("v"))
