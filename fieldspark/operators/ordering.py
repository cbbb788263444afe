"""Window-style, ordering and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored


def threshold_crossings(series: DataFrame, thresholds: list[float], by: str = "series_id", k: str = "k", y: str = "y") -> DataFrame:
    """(series, threshold, first): the first k with y < threshold (strict), else -1, for every threshold given.

    One conditional minimum for each threshold, combined before the shuffle; thresholds need no order.
    """
    firsts = series.groupBy(by).agg(*(F.min(F.when(F.col(y) < t, F.col(k))).alias(f"f{i}") for i, t in enumerate(thresholds)))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"f{i}", F.lit(-1)).cast("long").alias("first")) for i, t in enumerate(thresholds)))).alias("r")
    return firsts.select(by, rows).select(by, "r.threshold", "r.first")


def offsets(batches: DataFrame, batch: str = "batch", length: str = "length", ranges: int = 64) -> DataFrame:
    """(batch, length, start): running sums of the lengths in batch order.

    The rows are dealt into ranges of batches; one sum a range gives the start of each range, so no task sorts all rows.
    """
    rows = batches.select(batch, length)
    cuts = rows.approxQuantile(batch, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    parts = rows.withColumn("_part", F.size(F.filter(edges, lambda e: e <= F.col(batch))))
    sums = parts.groupBy("_part").agg(F.sum(length).alias("n"))
    base = sums.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))  # one row a range
    inner = F.sum(length).over(Window.partitionBy("_part").orderBy(batch)) - F.col(length)
    return parts.withColumn("_in", inner).join(F.broadcast(base), "_part").select(batch, length, (F.col("_base") + F.col("_in")).alias("start"))


def to_global(rows: DataFrame, starts: DataFrame, batch: str = "batch", offset: str = "offset") -> DataFrame:
    """Adds `ind` to rows (batch, offset); an offset outside its batch raises."""
    out = rows.join(starts, batch)
    ok = (F.col(offset) >= 0) & (F.col(offset) < F.col("length"))
    return out.withColumn("ind", F.when(ok, F.col("start") + F.col(offset)).otherwise(F.raise_error(F.lit("offset out of range")))).drop("start", "length")


def to_batch(rows: DataFrame, starts: DataFrame, ind: str = "ind", batch: str = "batch", width: int | None = None) -> DataFrame:
    """Adds batch and offset to global indices; indices outside all batches get nulls (filter or raise on them).

    An equi-join on blocks of indices: each batch emits the blocks it touches. Blocks are as wide as the mean length, so
    the batches emit twice their number of rows at most.
    """
    if width is None:
        total = starts.where("length > 0").agg(F.sum("length").alias("sum"), F.count(F.lit(1)).alias("n")).first()
        width = max(1, -(-int(total["sum"] or 1) // max(total["n"], 1)))
    stop = F.col("start") + F.col("length")
    cut = starts.where("length > 0").select(batch, "start", stop.alias("_stop"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((stop - 1) / width))).alias("_block"))
    return rows.withColumn("_block", F.floor(F.col(ind) / width)).join(cut, (F.col(ind) >= F.col("start")) & (F.col(ind) < F.col("_stop")) & (rows[ind].isNotNull()) & (F.floor(F.col(ind) / width) == cut["_block"]), "left").select(
        *rows.columns, batch, (F.col(ind) - F.col("start")).alias("offset")
    )


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based place of each row in a total order, by a range sort and numbers added up over its partitions.

    The sorted rows are written with their numbers before anything counts them: bounds of a range sort come from a sample,
    which a second run of the same sort need not draw again.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    tagged = stored(sorted_.withColumn("_part", F.call_function("shiftright", F.col("_at"), F.lit(33))))
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_base"))  # one row a partition
    return tagged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_at")


def lexsort(points: DataFrame, axes: list[str], key: str = "id") -> DataFrame:
    """Adds `rank` by the coordinates, first axis first; ties by key."""
    return ranked(points, [*map(F.col, axes), F.col(key)])


def check_permutation(perm: DataFrame, pos: str = "pos", idx: str = "idx") -> DataFrame:
    """One row: whether idx is a bijection of 0..n-1 and pos too."""
    n = F.count(F.lit(1))
    good = [(F.count_distinct(c) == n) & (F.coalesce(F.min(c), F.lit(0)) == 0) & (F.coalesce(F.max(c), n - 1) == n - 1) for c in (pos, idx)]
    return perm.agg((good[0] & good[1]).alias("bijection"))


def invert_permutation(perm: DataFrame, pos: str = "pos", idx: str = "idx") -> DataFrame:
    return perm.select(F.col(idx).alias(pos), F.col(pos).alias(idx))


def gaussian_smooth(series: DataFrame, sigma: float, by: str = "series_id", k: str = "k", y: str = "y", radius: int | None = None, normalise: bool = True) -> DataFrame:
    """(series, k, y): kernel sums over offsets within radius; divided by the weights that fell on the series, or by the
    whole kernel's sum with zeros outside (normalise=False)."""
    radius = int(4 * sigma + 0.5) if radius is None else radius
    kernel = [(d, float(pow(2.718281828459045, -0.5 * (d / sigma) ** 2))) for d in range(-radius, radius + 1)]
    taps = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in kernel))).alias("t")
    spread = series.select(by, F.col(k), F.col(y), taps).select(by, (F.col(k) + F.col("t.d")).alias(k), (F.col("t.w") * F.col(y)).alias("wy"), F.col("t.w").alias("w"))
    sums = spread.groupBy(by, k).agg(F.sum("wy").alias("wy"), F.sum("w").alias("w")).join(series.select(by, k), [by, k], "left_semi")
    return sums.select(by, k, (F.col("wy") / (F.col("w") if normalise else F.lit(sum(w for _, w in kernel)))).alias(y))


def smooth_abs(u: Column, rho: float) -> Column:
    return F.sqrt(rho * rho + u * u) - rho


def intersect_all(sets: DataFrame, set_id: str, item: str) -> DataFrame:
    """Items that are in every set of a table (set, item)."""
    n = sets.agg(F.count_distinct(set_id).alias("n"))
    return sets.groupBy(item).agg(F.count_distinct(set_id).alias("c")).join(F.broadcast(n), F.col("c") == F.col("n")).select(item)


def intersect_arrays(arrays: list[Column]) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_intersect(out, a)
    return out


def invert_pairs(pairs: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(value, key): each value's last key in the order of pos."""
    return pairs.groupBy(value).agg(F.max_by(key, pos).alias(key))


def invert_map(m: Column) -> Column:
    """A map column with keys and values swapped; a value that repeats keeps its last key."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["value"] == e["value"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))


def powerset(a: Column) -> Column:
    """All subsets of an array in bit-mask order, the empty one first."""
    masks = F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size(a)) - 1)
    return F.transform(masks, lambda m: F.filter(a, lambda _x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1).cast("long")) == 1))
