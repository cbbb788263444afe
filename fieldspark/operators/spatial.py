"""Range joins on a ladder of grids.

Each side emits the cells it touches, rows meet by an equi-join on the cell, the exact predicate follows, and a pair is
kept only in the cell of the larger of the two lower corners, so nothing has to be made distinct. Along each axis a box is
on the level of the ladder (each four times as wide as the last) on which it touches a bounded number of cells, and a pair
meets on the wider of its two levels: every row emits its cells once for each combination of levels that the other side
uses. So a box across the whole domain emits few rows, and points one for each combination. Hot cells are split by Spark's
skew join; a salt, from the fullest cell unless it is given, spreads them further.

Sides whose rows have many copies (equal in all that decides about a pair) meet as classes, one row for equal ones; the
class pairs are then written out through tables of the members, the side with more copies last and without a shuffle
behind it. So tests and values cost what the different rows cost, and a copied pair costs one output row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

MAX_CELLS = 256
#: Members in a row of a members' table, rows of a cell that one salt takes, and mean copies from which on classes pay.
PIECE, FULL, COPIES = 1024, 4096, 2.0


@dataclass
class Side:
    """Rows with a box each: names of the columns of its lower and upper corner (the same for points).

    shape: the other columns that the test of a pair or its values look at; None, where that isn't known, keeps all rows
    apart.
    """

    df: DataFrame
    lo: list[str]
    hi: list[str]
    shape: list[str] | None = field(default=None)

    @classmethod
    def points(cls, df: DataFrame, axes: list[str], shape: list[str] | None = None) -> Side:
        return cls(df, axes, axes, shape)


@dataclass
class Classes:
    """Classes of equal rows: side with one row a class (and its key _k, members _n, pieces _p); pieces (_k, _piece, _m)."""

    side: Side
    pieces: DataFrame
    rest: list[str]
    copies: float


def classes_of(side: Side, always: bool = False) -> Classes | None:
    """The classes of a side, or None where a row has under COPIES copies in the mean."""
    if side.df.isStreaming or side.shape is None:
        return None
    keys = list(dict.fromkeys([*side.lo, *side.hi, *side.shape]))
    rest = [c for c in side.df.columns if c not in keys]
    alone = stored(side.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_k": F.monotonically_increasing_id(), "_p": F.ceil(F.col("_n") / PIECE)}))
    got = alone.agg((F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).alias("copies")).first()
    copies = float(got["copies"] or 1.0)
    if copies < COPIES and not always:
        return None
    named = alone.select(*(F.col(c).alias("_key" + c) for c in keys), "_k", "_p")
    held = side.df.join(named, reduce(and_, [F.col(c).eqNullSafe(F.col("_key" + c)) for c in keys]))
    item = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    piece = F.pmod(F.xxhash64(*rest), F.col("_p")) if rest else F.pmod(F.monotonically_increasing_id(), F.col("_p"))
    pieces = held.select("_k", piece.alias("_piece"), item.alias("_m")).groupBy("_k", "_piece").agg(F.collect_list("_m").alias("_m"))
    return Classes(Side(alone, side.lo, side.hi, side.shape), pieces, rest or ["_none"], copies)


def members(pairs: DataFrame, of: Classes, prefix: str, last: bool) -> DataFrame:
    """Rows of pairs for every member of the class in prefix + _k; last: spread evenly first, as nothing shuffles them after."""
    k, piece = prefix + "_k", prefix + "_piece"
    at = pairs.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.col(prefix + "_p") - 1))).drop(prefix + "_p")
    if last:
        spark = pairs.sparkSession
        at = at.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), k, piece)
    if len(of.rest) == 1:
        held = of.pieces.select(F.col("_k").alias(k), F.col("_piece").alias(piece), F.col("_m")[of.rest[0]].alias("_m"))
        return at.join(held, [k, piece]).withColumn(prefix + of.rest[0], F.explode("_m")).drop("_m", piece, prefix + "_none")
    held = of.pieces.select(F.col("_k").alias(k), F.col("_piece").alias(piece), "_m")
    out = at.join(held, [k, piece]).withColumn("_m", F.explode("_m"))
    return out.withColumns({prefix + c: F.col("_m")[c] for c in of.rest}).drop("_m", piece)


#: Levels are numbers below 32; a combination of levels takes five bits an axis.
STEP, TOP = 4, 31


def _extents(side: Side) -> list[Column]:
    return [F.col(b) - F.col(a) for a, b in zip(side.lo, side.hi)]


def cell_width(side: Side, share: float = 0.9) -> list[float]:
    """A cell width for each axis: the given percentile of the boxes' widths, 1 where they have none."""
    return _survey(side, share)[0]


def _scale(extent: Column) -> Column:
    """The least n with extent <= STEP ** n; -1000 for an extent of nothing."""
    return F.when(extent > 0, F.ceil(F.log2(extent) / 2)).otherwise(-1000).cast("int")


def _survey(side: Side, share: float = 0.9) -> tuple[list[float], list[tuple[int, ...]]]:
    """Cell widths, and the combinations of scales of the boxes' sides (a few dozen an axis at most), in one job."""
    if side.lo == side.hi:
        return [1.0] * len(side.lo), [(-1000,) * len(side.lo)]
    sides = _extents(side)
    scales = F.collect_set(F.when(reduce(and_, [x >= 0 for x in sides]), F.struct(*(_scale(x).alias(f"s{i}") for i, x in enumerate(sides)))))
    row = side.df.agg(*(F.percentile_approx(x, share).alias(f"w{i}") for i, x in enumerate(sides)), scales.alias("s")).first()
    return [float(w) if w and w > 0 else 1.0 for w in row[:-1]], [tuple(s) for s in row["s"]]


def _least(width: list[float], max_cells: int) -> list[int]:
    """For each axis the largest scale that stays on the first level."""
    held = max(1, int(max_cells ** (1 / len(width)) + 1e-9) - 2)
    return [math.floor(math.log(w * held, STEP)) for w in width]


def _code(levels: list[int]) -> int:
    return sum(n << 5 * i for i, n in enumerate(levels))


def _codes(scales: list[tuple[int, ...]], least: list[int]) -> list[int]:
    return sorted({_code([min(TOP, max(0, s - z)) for s, z in zip(row, least)]) for row in scales})


def _cells(side: Side, prefix: str, width: list[float], least: list[int], own: list[int], other: list[int], left: bool) -> DataFrame:
    """Rows with the cells they touch (_c0, ...), the levels of the grid (_g0, ...) and the combination of levels (_lv)."""
    df = side.df.select(*(F.col(c).alias(prefix + c) for c in side.df.columns))
    lo, hi = ([F.col(prefix + c) for c in names] for names in (side.lo, side.hi))
    df = df.where(reduce(and_, [a <= b for a, b in zip(lo, hi)]))
    if own == other == [0]:
        wide, df = [F.lit(w) for w in width], df.withColumn("_lv", F.lit(0))
    else:
        mine = F.lit(0)
        if own != [0]:
            mine = sum((F.shiftleft(F.greatest(F.lit(0), F.least(F.lit(TOP), _scale(b - a) - z)), 5 * i) for i, (a, b, z) in enumerate(zip(lo, hi, least))), F.lit(0))
        df = df.withColumn("_own", mine).withColumn("_other", F.explode(F.array(*map(F.lit, other))))
        first, second = ("_own", "_other") if left else ("_other", "_own")
        level = [F.greatest(F.shiftright("_own", 5 * i).bitwiseAND(F.lit(31)), F.shiftright("_other", 5 * i).bitwiseAND(F.lit(31))) for i in range(len(width))]
        df = df.withColumn("_lv", F.shiftleft(F.col(first).cast("long"), 20) + F.col(second)).withColumns({f"_g{i}": g for i, g in enumerate(level)}).drop("_own", "_other")
        wide = [_wide(w, i) for i, w in enumerate(width)]
    for i, (a, b, w) in enumerate(zip(lo, hi, wide)):
        df = df.withColumn(f"_c{i}", F.floor(a / w) if side.lo == side.hi else F.explode(F.sequence(F.floor(a / w), F.floor(b / w))))
    return df


def _wide(width: float, axis: int) -> Column:
    """The width of a cell on level _g of an axis."""
    return F.lit(width) * F.expr(f"shiftleft(1L, 2 * _g{axis})")


def range_join(
    left: Side, right: Side, on: Column, width: list[float] | None = None, max_cells: int = MAX_CELLS, salt: int | None = None, even: bool = False, then: Callable[[DataFrame], DataFrame] | None = None, always: bool = False
) -> DataFrame:
    """Pairs whose boxes meet (closed) and that fulfil `on`; columns are prefixed with l_ and r_.

    Boxes with lower corners above upper corners match nothing. Null coordinates match nothing. A box emits at most
    max_cells rows for each combination of levels of the other side. even=True says that all boxes touch few cells of the
    given width, which saves looking at them. then: a change of the pairs, made once for equal rows, before copies are
    written out. always=True puts both sides into classes whatever their copies, so that `then` finds their keys (l__k,
    r__k) and numbers of members (l__n, r__n).
    """
    found = [classes_of(side, always) for side in (left, right)]
    sides = [c.side if c else side for c, side in zip(found, (left, right))]
    pairs = _row_pairs(*sides, on, width, max_cells, salt, even)
    pairs = then(pairs) if then else pairs
    rows = sorted((x for x in zip(found, ("l_", "r_")) if x[0]), key=lambda x: x[0].copies)
    for n, (c, prefix) in enumerate(rows):
        pairs = members(pairs, c, prefix, n == len(rows) - 1)
    return pairs.drop(*(prefix + c for _, prefix in rows for c in ("_k", "_n", "_p")))


def _row_pairs(left: Side, right: Side, on: Column, width: list[float] | None, max_cells: int, salt: int | None, even: bool) -> DataFrame:
    """The pairs of range_join, row by row."""
    d = len(left.lo)
    if even and width:
        codes = [[0], [0]]
        least = _least(width, max_cells)
    else:
        found = [_survey(left), _survey(right)]
        width = width or found[left.lo == left.hi][0]
        least = _least(width, max_cells)
        codes = [_codes(scales, least) or [0] for _, scales in found]
    a, b = _cells(left, "l_", width, least, codes[0], codes[1], True), _cells(right, "r_", width, least, codes[1], codes[0], False)
    keys, levels = ["_lv", *(f"_c{i}" for i in range(d))], [f"_g{i}" for i in range(d)]
    if salt is None:
        top = None if left.df.isStreaming else a.groupBy(*keys).count().agg(F.max("count")).first()[0]
        salt = min(32, -(-(top or 1) // FULL))
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*(F.col("l_" + c) for c in left.df.columns)), F.lit(salt)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        keys.append("_salt")
    wide = [F.lit(w) for w in width] if codes == [[0], [0]] else [_wide(w, i) for i, w in enumerate(width)]
    once = [F.col(f"_c{i}") == F.floor(F.greatest("l_" + x, "r_" + y) / w) for i, (x, y, w) in enumerate(zip(left.lo, right.lo, wide))]
    meet = [(F.col("l_" + p) <= F.col("r_" + q)) & (F.col("r_" + r) <= F.col("l_" + t)) for p, q, r, t in zip(left.lo, right.hi, right.lo, left.hi)]
    return a.join(b.drop(*levels), keys).where(reduce(and_, once) & reduce(and_, meet) & on).drop(*keys, *levels)


def _cols(prefix: str, names: list[str]) -> list[Column]:
    return [F.col(prefix + n) for n in names]


def points_in_boxes(points: DataFrame, axes: list[str], boxes: DataFrame, lo: list[str], hi: list[str], closed: str = "both", **options) -> DataFrame:
    """Point-box pairs; closed="both" or "left" (lo <= p < hi)."""
    p = _cols("l_", axes)
    inside = [(x >= a) & ((x <= b) if closed == "both" else (x < b)) for x, a, b in zip(p, _cols("r_", lo), _cols("r_", hi))]
    return range_join(Side.points(points, axes, []), Side(boxes, lo, hi, []), reduce(and_, inside), **options)


def boxes_overlap(a: DataFrame, b: DataFrame, lo: list[str], hi: list[str], **options) -> DataFrame:
    """Pairs of boxes that meet (closed)."""
    on = [(F.col("l_" + x) <= F.col("r_" + y)) & (F.col("r_" + x) <= F.col("l_" + y)) for x, y in zip(lo, hi)]
    return range_join(Side(a, lo, hi, []), Side(b, lo, hi, []), reduce(and_, on), **options)


def balls_meet_boxes(balls: DataFrame, centre: list[str], radius: str, boxes: DataFrame, lo: list[str], hi: list[str], **options) -> DataFrame:
    """Ball-box pairs: squared distance of the clamped centre at most r^2; a negative radius counts as its absolute value.

    The centre is clamped to the upper corner first and to the lower one last, so along an axis on which a box is inside
    out it is its lower corner that counts.
    """
    r = F.abs(F.col(radius))
    held = balls.withColumns({f"_lo{i}": F.col(c) - r for i, c in enumerate(centre)} | {f"_hi{i}": F.col(c) + r for i, c in enumerate(centre)})
    gaps = [c - F.greatest(F.least(c, h), a) for c, a, h in zip(_cols("l_", centre), _cols("r_", lo), _cols("r_", hi))]
    on = sum((g * g for g in gaps), F.lit(0.0)) <= F.col("l_" + radius) * F.col("l_" + radius)
    n = range(len(centre))
    turned = boxes.withColumns({f"_top{i}": F.greatest(F.col(a), F.col(b)) for i, (a, b) in enumerate(zip(lo, hi))})
    out = range_join(Side(held, [f"_lo{i}" for i in n], [f"_hi{i}" for i in n], [*centre, radius]), Side(turned, lo, [f"_top{i}" for i in n], hi), on, **options)
    return out.drop(*(f"l__lo{i}" for i in n), *(f"l__hi{i}" for i in n), *(f"r__top{i}" for i in n))


def points_in_ellipsoids(points: DataFrame, axes: list[str], ellipsoids: DataFrame, mu: list[str], sigma: list[list[str]], tau: float, inclusive: bool = True, **options) -> DataFrame:
    """Point-ellipsoid pairs in two dimensions or three: the quadratic form multiplied through by det sigma."""
    n = range(len(axes))
    held = ellipsoids.withColumns({f"_lo{i}": F.col(mu[i]) - tau * F.sqrt(sigma[i][i]) for i in n} | {f"_hi{i}": F.col(mu[i]) + tau * F.sqrt(sigma[i][i]) for i in n})
    d = [F.col("l_" + a) - F.col("r_" + m) for a, m in zip(axes, mu)]
    s = [[F.col("r_" + sigma[i][j]) for j in n] for i in n]
    if len(axes) == 2:
        det = s[0][0] * s[1][1] - s[0][1] * s[1][0]
        q = d[0] * d[0] * s[1][1] - d[0] * d[1] * (s[0][1] + s[1][0]) + d[1] * d[1] * s[0][0]
    else:
        minor = lambda i, j: [[s[a][b] for b in n if b != j] for a in n if a != i]
        cof = [[(lambda m: m[0][0] * m[1][1] - m[0][1] * m[1][0])(minor(i, j)) * (-1) ** (i + j) for j in n] for i in n]
        det = sum((s[0][j] * cof[0][j] for j in n), F.lit(0.0))
        q = sum((d[i] * d[j] * cof[j][i] for i in n for j in n), F.lit(0.0))
    on = (q <= tau * tau * det) if inclusive else (q < tau * tau * det)
    form = list(dict.fromkeys([*mu, *(c for row in sigma for c in row)]))
    out = range_join(Side.points(points, axes, []), Side(held, [f"_lo{i}" for i in n], [f"_hi{i}" for i in n], form), on, **options)
    return out.drop(*(f"r__lo{i}" for i in n), *(f"r__hi{i}" for i in n))


def within_radius(points: DataFrame, centres: DataFrame, axes: list[str], radius: float, then: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Pairs of a centre (l_) and a point (r_) at most radius apart, with `dsq`; cells as wide as the radius.

    then: a change of the pairs by `dsq` and the places alone; it is made once for equal places.
    """
    held = centres.withColumns({f"_lo{i}": F.col(a) - radius for i, a in enumerate(axes)} | {f"_hi{i}": F.col(a) + radius for i, a in enumerate(axes)})
    dsq = sum(((x - y) * (x - y) for x, y in zip(_cols("l_", axes), _cols("r_", axes))), F.lit(0.0))
    n = range(len(axes))
    left, right = Side(held, [f"_lo{i}" for i in n], [f"_hi{i}" for i in n], axes), Side.points(points, axes, [])
    more = lambda pairs: (then or (lambda p: p))(pairs.withColumn("dsq", dsq))
    out = range_join(left, right, dsq <= radius * radius, **({"width": [radius] * len(axes), "even": True, "then": more} | options))
    return out.drop(*(f"l__lo{i}" for i in n), *(f"l__hi{i}" for i in n))


def kernel_average(points: DataFrame, centres: DataFrame, axes: list[str], radius: float, length: float, value: str, weight: str | None = None, centre_id: str = "id") -> DataFrame:
    """(centre id, n, avg): the neighbours' number and the sum over them of weight * exp(-dsq / (2 length^2)) * value.

    Points of one place are summed up first and centres of one place are asked for once.
    """
    held = F.col(weight) * F.col(value) if weight else F.col(value)
    places = points.groupBy(*axes).agg(F.count(F.lit(1)).alias("_count"), F.sum(held).alias("_sum"))
    at = centres.select(*axes).distinct()
    pairs = within_radius(stored(places), stored(at), axes, radius)
    sums = pairs.groupBy(*(F.col("l_" + a).alias("_" + a) for a in axes)).agg(F.sum("r__count").alias("n"), F.sum(F.exp(-F.col("dsq") / (2 * length * length)) * F.col("r__sum")).alias("avg"))
    return centres.join(sums, reduce(and_, [F.col(a) == F.col("_" + a) for a in axes])).select(centre_id, "n", "avg")


def kernel_values(points: DataFrame, centres: DataFrame, axes: list[str], radius: float, kind: str = "gaussian", shape: float = 1.0, values: dict[str, Column] | None = None) -> DataFrame:
    """Kernel values `phi` of all pairs within the radius: gaussian exp(-r^2 / (2 shape^2)) or multiquadric
    sqrt(1 + (shape r)^2); values: more columns, of `phi`, `dsq` and the places."""
    phi = F.exp(-F.col("dsq") / (2 * shape * shape)) if kind == "gaussian" else F.sqrt(1 + shape * shape * F.col("dsq"))
    return within_radius(points, centres, axes, radius, then=lambda pairs: pairs.withColumn("phi", phi).withColumns(values or {}))


def gaussian_block(rows: DataFrame, cols: DataFrame, mu: str = "mu", var: str = "var", height: str = "v", t: str = "t", cut: float = 6.0, digits: int | None = None) -> DataFrame:
    """(l_.., r_.., value): v exp(-(t - mu)^2 / (2 var)) for rows (mu, var, v) and columns (t), cut at `cut` deviations;
    rounded to `digits` if given."""
    held = rows.withColumns({"_lo": F.col(mu) - cut * F.sqrt(var), "_hi": F.col(mu) + cut * F.sqrt(var)})
    d = F.col("r_" + t) - F.col("l_" + mu)
    value = F.col("l_" + height) * F.exp(-d * d / (2 * F.col("l_" + var)))
    value = value if digits is None else F.round(value, digits)
    return range_join(Side(held, ["_lo"], ["_hi"], [mu, var, height]), Side.points(cols, [t], []), F.lit(True), then=lambda pairs: pairs.withColumn("value", value)).drop("l__lo", "l__hi")
