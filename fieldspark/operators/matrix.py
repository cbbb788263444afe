"""Sparse matrices as (i, j, v) tables, patch matrices, and conversions between layouts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .lowrank import row_products

#: Numbers of probes that are sent to all tasks at once.
SENT = 1 << 21
#: Entries of patches that are changed together.
PATCHED = 1 << 16
#: Numbers that one step of a product with probes, and one group of a fit, hold at once.
HELD = 1 << 22


def apply(a: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """A X (or A' X) for x with rows (i, v) or (i, k, v); rows without entries have no row in the result."""
    row, col = ("j", "i") if transpose else ("i", "j")
    keys = ["k"] if "k" in x.columns else []
    left = a.select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.col("v").alias("_a"))
    right = x.select(F.col("i").alias("_c"), *keys, F.col("v").alias("_x"))
    return left.join(right, "_c").groupBy(F.col("_r").alias("i"), *keys).agg(F.sum(F.col("_a") * F.col("_x")).alias("v"))


class Operator:
    """The matrix as a function of tables (see apply), and of row tables (i, row), whose columns are summed side by side."""

    def __init__(self, a: DataFrame, transpose: bool):
        self.a, self.transpose = a, transpose

    def __call__(self, x: DataFrame) -> DataFrame:
        return apply(self.a, x, self.transpose)

    def rows(self, x: DataFrame, columns: int) -> DataFrame:
        row, col = ("j", "i") if self.transpose else ("i", "j")
        left = self.a.select(F.col(row).alias("_r"), F.col(col).alias("_c"), F.col("v").alias("_a"))
        held = left.join(x.select(F.col("i").alias("_c"), F.col("row").alias("_x")), "_c")
        sums = held.groupBy(F.col("_r").alias("i")).agg(*(F.sum(F.col("_a") * F.col("_x")[k]).alias(f"_{k}") for k in range(columns)))
        return sums.select("i", F.array(*(f"_{k}" for k in range(columns))).alias("row"))

    def probed(self, start: int, stop: int, seed: int) -> DataFrame:
        """(i, b, row), b = start: sums for the columns start to stop - 1 of the probes of fit_sparse, which are made beside
        the entries; a row may come in parts."""
        row, col = ("j", "i") if self.transpose else ("i", "j")
        return _sketched(self.a.select(F.col(row).alias("i"), F.col(col).alias("j"), "v"), start, stop, seed)


def operator(a: DataFrame, transpose: bool = False) -> Operator:
    return Operator(a, transpose)


class Chain:
    """The product of operators as one, the last of them applied first."""

    def __init__(self, *operators):
        self.operators = operators

    def __call__(self, x: DataFrame) -> DataFrame:
        for f in reversed(self.operators):
            x = f(x)
        return x

    def rows(self, x: DataFrame, columns: int) -> DataFrame:
        for f in reversed(self.operators):
            x = row_products(f, x, columns)
        return x


def by_rows(a: DataFrame) -> DataFrame:
    """A stored copy of (i, j, v) with the entries of a row together: sums over rows then end in the task that reads them."""
    return stored(a.repartition("i").sortWithinPartitions("i"))


def to_rows(a: DataFrame) -> DataFrame:
    """(i, cols, vals): one row a matrix row, columns ascending."""
    packed = a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e"))
    return packed.select("i", F.transform("e", lambda e: e["j"]).alias("cols"), F.transform("e", lambda e: e["v"]).alias("vals"))


def from_rows(rows: DataFrame) -> DataFrame:
    e = F.explode(F.arrays_zip(F.col("cols").alias("j"), F.col("vals").alias("v")))
    return rows.select("i", e.alias("e")).select("i", F.col("e.j").alias("j"), F.col("e.v").alias("v"))


def components_to_arrays(values: DataFrame, key: str = "v_id") -> DataFrame:
    """(key, values): long rows (key, comp, value) as one array a key, in component order."""
    return values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("comp", "value"))), lambda s: s["value"]).alias("values"))


def arrays_to_components(arrays: DataFrame, key: str = "v_id") -> DataFrame:
    return arrays.select(key, F.posexplode("values").alias("comp", "value"))


def deinterleave(values: Column, components: int) -> Column:
    """An interleaved array as one array a component."""
    n = F.floor(F.size(values) / components).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(components - 1)), lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(values, i * components + c + 1)))


def interleave(parts: Column) -> Column:
    n = F.size(F.element_at(parts, 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(parts, lambda p: F.element_at(p, i + 1))))


@cache
def _quantiles() -> np.ndarray:
    """The middles of 65,536 equally likely parts of the standard normal distribution."""
    low = np.array([NormalDist().inv_cdf((k + 0.5) / 65536) for k in range(32768)])
    return np.concatenate([low, -low[::-1]])


def _normals(ids: np.ndarray, start: int, stop: int, seed: int) -> np.ndarray:
    """Standard normal numbers (quantiles) fixed by (id, probe, seed): a row an id, with the probes start to stop - 1."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    first = mix(ids.astype(np.int64).view(np.uint64) + np.array([(seed + 1) * 0xD1342543DE82EF95 % (1 << 64)], np.uint64))
    steps = np.arange(start // 4 + 1, (stop + 3) // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = mix(first[:, None] + steps).astype("<u8").view("<u2")  # a hash makes four numbers
    return _quantiles()[x[:, start % 4 : start % 4 + stop - start]]


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array of lists."""
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), np.ascontiguousarray(rows).ravel())


def _probe_table(ids: DataFrame, start: int, stop: int, seed: int) -> DataFrame:
    """(i, row): the probes start to stop - 1 of every id."""
    step = max(1, HELD // (stop - start))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                i = batch.column("i").slice(at, step)
                yield pa.record_batch([i, _lists(_normals(i.to_numpy(zero_copy_only=False), start, stop, seed))], names=["i", "row"])

    return ids.select("i").mapInArrow(run, "i long, row array<double>")


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of at least `size` rows, the last one apart, and under twice as many."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(batch.slice(at, size))
            n += held[-1].num_rows
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sketched(a: DataFrame, start: int, stop: int, seed: int) -> DataFrame:
    """(i, b, row), b = start: parts of the products of entries (i, j, v) with the probes start to stop - 1 of their j. Entries
    of one line that lie together come as one part."""
    step = max(1, HELD // (stop - start))

    def run(batches):
        for part in _chunks(batches, step):
            i, j, v = (part.column(c).to_numpy() for c in ("i", "j", "v"))
            order = np.argsort(i, kind="stable")
            lines, heads = np.unique(i[order], return_index=True)
            js, at = np.unique(j[order], return_inverse=True)
            rows = _normals(js, start, stop, seed)[at]
            rows *= v[order, None]
            sums = np.add.reduceat(rows, heads, axis=0)
            yield pa.record_batch([pa.array(lines), pa.array(np.full(len(lines), start, np.int32)), _lists(sums)], names=["i", "b", "row"])

    long = [F.col(c).cast("long").alias(c) for c in ("i", "j")]
    held = a.dropna(subset=["i", "j"]).select(*long, F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    return held.mapInArrow(run, "i long, b int, row array<double>")


def _fit_lines(lines: DataFrame, products: DataFrame, entries: int, wanted: int, seed: int) -> DataFrame:
    """(i, j, v): least squares of each line of (i, j), of n entries, against the first 2 n + 4 of its products; products
    (i, b, row) are summed up, each row from column b on, and a line without any is zero. Lines share hashed groups of some
    HELD numbers; a few neighbours stay together, as they often ask for the same probes."""
    groups, together = 1 + entries * wanted // HELD, max(0, int(np.log2(max(1, HELD // (2 * wanted * wanted)))))
    g = F.pmod(F.xxhash64(F.shiftright("i", min(together, 8))), F.lit(groups)).alias("g")

    def fit(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (left.column(c).to_numpy() for c in ("i", "j"))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        ids, first, sizes = np.unique(i, return_index=True, return_counts=True)
        y = np.zeros((len(ids), wanted))
        if len(ids) and right.num_rows:
            key, b, rows = right.column("i").to_numpy(), right.column("b").to_numpy(), right.column("row").combine_chunks()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            widths = rows.value_lengths().to_numpy()
            at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
            for start, width in set(zip(b.tolist(), widths.tolist())):
                some = np.flatnonzero((b == start) & (widths == width) & (ids[at] == key))
                if len(some):
                    some = some[np.argsort(at[some], kind="stable")]
                    to, heads = np.unique(at[some], return_index=True)
                    y[to, start : start + width] += np.add.reduceat(rows.take(pa.array(some)).flatten().to_numpy().reshape(-1, width), heads, axis=0)
        js, at = np.unique(j, return_inverse=True)
        z, v = _normals(js, 0, wanted, seed), np.empty(len(j))
        for n in np.unique(sizes):  # lines of one length at once
            m, some = min(2 * n + 4, wanted), np.flatnonzero(sizes == n)
            step = int(max(1, HELD // (m * n)))
            for k in range(0, len(some), step):
                mine = some[k : k + step]
                places = first[mine][:, None] + np.arange(n)
                probes, goal = z[at[places], :m], y[mine, :m, None]
                back = probes.transpose(0, 2, 1)
                gram = probes @ back  # well conditioned, as probes are over twice as many as entries
                got = np.linalg.solve(gram, probes @ goal)
                got += np.linalg.solve(gram, probes @ (goal - back @ got))
                v[places] = got[:, :, 0]
        return pa.table({"i": i, "j": j, "v": v})

    return lines.select(g, "i", "j").groupBy("g").cogroup(products.select(g, "i", "b", "row").groupBy("g")).applyInArrow(fit, "i long, j long, v double")


def _turn(at: list[DataFrame], left: int, width: int) -> tuple[int, int]:
    """The side, and the length of its longest lines, whose short lines hold half of the open entries: those of at most
    `width` entries, doubled until it is enough, and once more where that takes another eighth."""
    lengths = [{r["n"]: r["c"] for r in a.groupBy("i").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()} for a in at]
    within = lambda x, width: sum(n * c for n, c in x.items() if n <= width)
    while True:
        held = [within(x, width) for x in lengths]
        s = held.index(max(held))
        if 2 * held[s] >= left:
            if 8 * (within(lengths[s], 2 * width) - held[s]) >= left:
                width *= 2
            return s, max(n for n in lengths[s] if n <= width)
        width *= 2


def fit_sparse(pattern: DataFrame, apply, apply_t, rows: DataFrame, cols: DataFrame, width: int = 16, seed: int = 0) -> tuple[DataFrame, int]:
    """(i, j, v) and the number of probes on the side with most: values of a known sparsity pattern (i, j) of a matrix that is
    only known by its products (apply, its transpose apply_t; operators, or functions of tables (i, k, v)). rows and cols
    are its index tables (i).

    The pattern says beforehand which lines to solve: in each turn the rows, or the columns, with at most `width` open entries
    (more, where these hold less than half of what is open) are solved from products with Gaussian probes, twice as many as
    the longest has entries and four. So a row as long as the matrix costs no more probes than a short one: its entries
    are found by their columns. An operator that has `probed` makes the probes beside its entries, in one pass a turn. Others
    get them as tables, once a side, in slices of bounded size, and only the products of lines that are still open are kept.
    Repeated pattern rows count once; an empty pattern asks for no product.
    """
    todo = stored(pattern.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).distinct())
    found, left, sides, most = [], todo.count(), [(apply, cols), (apply_t, rows)], 0
    slices: list[list] = [[], []]  # of each side: (probes before it, probes up to its end, products)
    flip = lambda a, s, *more: a.select(F.col("j").alias("i"), F.col("i").alias("j"), *more) if s else a
    while left:
        at = [flip(todo, s) for s in (0, 1)]
        s, longest = _turn(at, left, width)
        lengths, wanted, (product, ids) = at[s].groupBy("i").agg(F.count(F.lit(1)).alias("n")), 2 * longest + 4, sides[s]
        long = stored(lengths.where(F.col("n") > longest).select("i"))
        if hasattr(product, "probed"):
            held = [product.probed(0, wanted, seed + s)]
        else:
            _ask(product, ids, slices[s], wanted, at[s].select("i").distinct(), seed + s)
            held = [_placed(y, a, b, wanted) for a, b, y in slices[s] if a < wanted]
        held += [_sketched(flip(f, s, "v").withColumn("v", -F.col("v")), 0, wanted, seed + s) for f in found]
        if found:
            short = stored(lengths.where(F.col("n") <= longest).select("i"))
            held = [y.join(short, "i", "left_semi") for y in held]
        else:  # all lines of the pattern are open
            held = [y.join(long, "i", "left_anti") for y in held]
        products = held[0]
        for y in held[1:]:
            products = products.union(y)
        found.append(stored(flip(_fit_lines(at[s].join(long, "i", "left_anti"), products, left, wanted, seed + s), s, "v")))
        todo = stored(flip(at[s].join(long, "i", "left_semi"), s))
        left, most = todo.count(), max(most, wanted)
    if not found:
        return todo.withColumn("v", F.lit(0.0)), 0
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out, max([most, *(x[-1][1] for x in slices if x)])


def _ask(product, ids: DataFrame, slices: list, wanted: int, lines: DataFrame, seed: int) -> None:
    """Add what is missing of the products with the probes 0 to wanted - 1 of ids to slices, of the given lines only."""
    ids, start = ids.select(F.col("i").cast("long").alias("i")), slices[-1][1] if slices else 0
    size = ids.count() if start < wanted else 0
    step = max(1, min(64, SENT // max(size, 1)))
    while start < wanted:
        stop = min(start + step, wanted)
        z = _probe_table(ids, start, stop, seed)
        got = row_products(product, F.broadcast(z) if size <= SENT else z, stop - start).select("i", "row")
        slices.append((start, stop, stored(got.join(lines, "i", "left_semi"))))
        start = stop


def _placed(y: DataFrame, start: int, stop: int, wanted: int) -> DataFrame:
    """The columns start to stop - 1 of `wanted` columns, (i, b, row) with b = start; at most `wanted` of them in all."""
    return y.select("i", F.lit(start).alias("b"), F.slice("row", 1, min(stop, wanted) - start).alias("row"))


def blocks_in_order(x: DataFrame, into: DataFrame, blocks: DataFrame, out_of: DataFrame) -> DataFrame:
    """(i, v): a block-row product under another ordering.

    x (i, v); into (i, b, c): place c of entry i in block b's (padded) input; blocks (b, r, c, v); out_of (b, r, i): where
    row r of block b belongs in the result.
    """
    held = x.join(into, "i").select("b", "c", F.col("v").alias("x"))
    y = blocks.join(held, ["b", "c"]).groupBy("b", "r").agg(F.sum(F.col("v") * F.col("x")).alias("y"))
    return out_of.join(y, ["b", "r"], "left").groupBy("i").agg(F.sum(F.coalesce("y", F.lit(0.0))).alias("v"))


def patches_to_entries(entries: DataFrame, patch: int | None = None) -> DataFrame:
    """(i, j, v) of a patch matrix (patch_id, i, j, v): overlapping patches add up; or of one patch alone."""
    rows = entries if patch is None else entries.where(F.col("patch_id") == patch)
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


def patch_apply(entries: DataFrame, x: DataFrame, transpose: bool = False) -> DataFrame:
    """Product of a patch matrix with a vector; patches needn't be added up first."""
    return apply(entries, x, transpose)


def patch_overlaps(rows: DataFrame, name: str = "shared") -> DataFrame:
    """(a, b, shared), a < b: ids that two patches (patch_id, i) share, ascending."""
    left, right = rows.select(F.col("patch_id").alias("a"), "i"), rows.select(F.col("patch_id").alias("b"), "i")
    return left.join(right, "i").where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_set("i")).alias(name))


def patch_weights(points: DataFrame, patches: DataFrame, axes: list[str], lo: list[str], hi: list[str], factor: float = 1.0, digits: int | None = None) -> DataFrame:
    """(id, patch_id, w): Gaussians centred on each patch's box with length factor * half-width an axis, cut to the box and
    divided by the sum over the patches that hold the point; rounded to `digits` if given. Equal points are weighed once."""
    from .spatial import points_in_boxes

    q = sum((((F.col("l_" + x) - (F.col("r_" + a) + F.col("r_" + b)) / 2) / (F.lit(factor) * (F.col("r_" + b) - F.col("r_" + a)) / 2)) ** 2 for x, a, b in zip(axes, lo, hi)), F.lit(0.0))
    whole = F.sum(F.col("g") * F.col("r__n")).over(Window.partitionBy("l__k"))
    w = F.col("g") / whole if digits is None else F.round(F.col("g") / whole, digits)
    near = points_in_boxes(points, axes, patches, lo, hi, always=True, then=lambda pairs: pairs.withColumn("g", F.exp(-q / 2)).withColumn("w", w))
    return near.select(F.col("l_id").alias("id"), F.col("r_patch_id").alias("patch_id"), "w")


def weighted_patch_apply(a: DataFrame, left: DataFrame, right: DataFrame, x: DataFrame) -> DataFrame:
    """sum over patches of diag(l) A diag(r) x; left and right are (patch_id, i, w)."""
    z = right.join(x, "i").select("patch_id", F.col("i").alias("j"), (F.col("w") * F.col("v")).alias("z"))
    y = a.join(z, "j").groupBy("patch_id", "i").agg(F.sum(F.col("v") * F.col("z")).alias("y"))
    return y.join(left, ["patch_id", "i"]).groupBy("i").agg(F.sum(F.col("y") * F.col("w")).alias("v"))


def _per_patch(entries: DataFrame, change) -> DataFrame:
    """change(stack of symmetric matrices) of each patch; patches share groups of some PATCHED entries, and those of one size
    are changed at once."""
    held = stored(entries.select("patch_id", "i", "j", "v"))
    groups = 1 + held.count() // PATCHED

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        patch, p = np.unique(pdf["patch_id"].to_numpy(), return_inverse=True)
        ends = pd.DataFrame({"p": np.concatenate([p, p]), "i": np.concatenate([pdf["i"], pdf["j"]])}).drop_duplicates().sort_values(["p", "i"], ignore_index=True)
        start, size = np.searchsorted(ends["p"], np.arange(len(patch))), np.bincount(ends["p"])
        ends["at"] = np.arange(len(ends)) - start[ends["p"]]
        at = [pd.DataFrame({"p": p, "i": pdf[c].to_numpy()}).merge(ends, on=["p", "i"], how="left")["at"].to_numpy() for c in ("i", "j")]
        names, out = ends["i"].to_numpy(), []
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            no = np.full(len(patch), -1)
            no[some] = np.arange(len(some))
            mine = no[p] >= 0
            m = np.zeros((len(some), n, n))
            np.add.at(m, (no[p[mine]], at[0][mine], at[1][mine]), pdf["v"].to_numpy(float)[mine])
            ids = names[start[some][:, None] + np.arange(n)]
            out.append(pd.DataFrame({"patch_id": np.repeat(patch[some], n * n), "i": np.repeat(ids, n, axis=1).ravel(), "j": np.tile(ids, (1, n)).ravel(), "v": change((m + m.transpose(0, 2, 1)) / 2).ravel()}))
        return pd.concat(out)

    return held.groupBy(F.pmod(F.xxhash64("patch_id"), F.lit(groups)).alias("g")).applyInPandas(run, "patch_id long, i long, j long, v double")


def patch_positive(entries: DataFrame, flip: bool = False) -> DataFrame:
    """Each square patch made symmetric and positive semidefinite: negative eigenvalues become zero (or positive)."""

    def change(m: np.ndarray) -> np.ndarray:
        w, u = np.linalg.eigh(m)
        return (u * (np.abs(w) if flip else np.maximum(w, 0))[:, None, :]) @ u.transpose(0, 2, 1)

    return _per_patch(entries, change)


def patch_sqrt(entries: DataFrame) -> DataFrame:
    """Symmetric square root of each (positive semidefinite) patch."""

    def change(m: np.ndarray) -> np.ndarray:
        w, u = np.linalg.eigh(m)
        return (u * np.sqrt(np.maximum(w, 0))[:, None, :]) @ u.transpose(0, 2, 1)

    return _per_patch(entries, change)
