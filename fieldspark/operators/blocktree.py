"""Kernel matrices compressed over the block tree of a cluster tree.

A block of two clusters far apart is A[R, J] pinv(A[I, J]) A[I, C], where I and J are a bounded sample of the points of
its row and its column cluster; near blocks of two leaves are taken as they are. Points of one place have equal rows and
columns, so the tree is one of places. It holds no entries and no inverses: places, samples and pairs of clusters are all,
and a product makes what it needs of a block in the task that sums it. A product takes the far blocks of all levels
together: sums over the column clusters, the inverses, and one sum into the places of a row cluster for far and near blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clusters import block_pairs, cluster_tree
from .common import stored
from .knn import top_k

#: Far blocks whose inverses are made at once.
SOLVED = 512


@dataclass
class BlockTree:
    """keys (i, k): the place of every point, named by its least i; leaves (cluster, i, axes): every place in its leaf;
    samples (cluster, s): the places of a cluster's sample; far, close (row, col): pairs of clusters and pairs of leaves."""

    axes: list[str]
    kernel: object
    rcond: float
    keys: DataFrame
    leaves: DataFrame
    samples: DataFrame
    far: DataFrame
    close: DataFrame

    @property
    def inverses(self) -> DataFrame:
        """(row, col, u): pinv(A[I, J]) by rows."""
        rcond = self.rcond

        def invert(batches):
            for pdf in batches:
                out = [np.linalg.pinv(v.reshape(n, -1), rcond=rcond).tolist() for v, n in zip(pdf["v"], pdf["n"])]
                yield pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "u": out})

        return _grids(self, self.far).select("row", "col", "v", "n").mapInPandas(invert, "row long, col long, u array<array<double>>")

    @property
    def near(self) -> DataFrame:
        """(i, j, v): the entries of near blocks, of places."""
        rows, cols = (self.leaves.select(F.col("cluster").alias(c), F.col("i").alias(i), F.struct(*self.axes).alias(p)) for c, i, p in (("row", "i", "p"), ("col", "j", "q")))
        return self.close.join(rows, "row").join(cols, "col").select("i", "j", _value(self, F.col("p"), F.col("q")).alias("v"))


def _value(a: BlockTree, p: Column, q: Column) -> Column:
    return a.kernel([p[c] for c in a.axes], [q[c] for c in a.axes])


def _sampled(a: BlockTree, cluster: str, name: str) -> DataFrame:
    return a.samples.select(F.col("cluster").alias(cluster), F.col("s").alias(name))


def _grids(a: BlockTree, pairs: DataFrame) -> DataFrame:
    """pairs with v, A[I, J] row after row, and its number n of rows."""
    v = F.flatten(F.transform("r", lambda p: F.transform("c", lambda q: _value(a, p, q))))
    return pairs.join(_sampled(a, "row", "r"), "row").join(_sampled(a, "col", "c"), "col").withColumns({"v": v, "n": F.size("r")}).drop("r", "c")


def _upwards(leaves: DataFrame) -> DataFrame:
    """Rows of leaves in their leaf and in all clusters above."""
    level = F.sequence(F.lit(0), F.floor(F.log2("cluster") + 1e-9).cast("int"))
    up = F.explode(F.transform(level, lambda n: F.call_function("shiftright", F.col("cluster"), n))).alias("cluster")
    return leaves.select(up, *(c for c in leaves.columns if c != "cluster"))


def compress(points: DataFrame, axes: list[str], kernel, eta: float = 1.0, min_size: int = 64, size: int = 32, rcond: float = 1e-9) -> BlockTree:
    """The matrix kernel(places of i, places of j) over points (i, axes), compressed.

    kernel takes two lists of columns. Each cluster is sampled at the `size` places of least hash, so the rank of a far
    block is `size` at most and its error follows the singular values behind that. min_size and size count places. What is
    written is linear in the points, and in the places a level.
    """
    named = stored(points.groupBy(*axes).agg(F.min("i").alias("k")))
    same = [F.col("p." + c).eqNullSafe(F.col("n." + c)) for c in axes]
    keys = stored(points.select("i", *axes).alias("p").join(named.alias("n"), same).select("i", "k"))
    places = named.withColumnRenamed("k", "i")
    clusters, leaves = cluster_tree(places, axes, "i", min_size)
    clusters = stored(clusters)
    pairs = stored(block_pairs(clusters, eta))
    far, close = (pairs.where(F.col("kind") == kind).select("row", "col") for kind in ("far", "near"))
    leaves = stored(leaves.join(places, "i").select("cluster", "i", *axes))
    wanted = far.select(F.col("row").alias("cluster")).union(far.select(F.col("col").alias("cluster"))).distinct()
    chosen = top_k(_upwards(leaves).join(wanted, "cluster").withColumn("dsq", F.xxhash64("i")), size, query="cluster", item="i")
    order = F.array_sort(F.collect_list(F.struct("rank", F.struct(*axes).alias("s"))))
    samples = stored(chosen.groupBy("cluster").agg(F.transform(order, lambda e: e["s"]).alias("s")))
    return BlockTree(axes, kernel, rcond, keys, leaves, samples, far, close)


def _solved(a: BlockTree, sums: DataFrame) -> DataFrame:
    """(row, col, g): pinv(A[I, J]) t for sums (row, col, t)."""
    rcond = a.rcond

    def solve(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SOLVED):
                some = pdf.iloc[at : at + SOLVED]
                for (m, n), part in some.groupby([some["n"], some["v"].map(len) // some["n"]]):  # blocks of one shape at once
                    u = np.linalg.pinv(np.stack(part["v"].to_list()).reshape(len(part), m, n), rcond=rcond)
                    g = (u @ np.stack(part["t"].to_list())[:, :, None])[:, :, 0]
                    yield pd.DataFrame({"row": part["row"].to_numpy(), "col": part["col"].to_numpy(), "g": list(g)})

    return _grids(a, sums).select("row", "col", "v", "n", "t").mapInPandas(solve, "row long, col long, g array<double>")


def apply(a: BlockTree, x: DataFrame) -> DataFrame:
    """(i, v): the compressed matrix times (i, v).

    The members of a cluster meet the samples of its far partners, not the other way round, so that a far block moves two
    samples and what is summed at them, and all else is linear in the places a level.
    """
    held = a.leaves.join(x.join(a.keys, "i").groupBy(F.col("k").alias("i")).agg(F.sum("v").alias("w")), "i").withColumn("q", F.struct(*a.axes))
    asked = a.far.join(_sampled(a, "row", "r"), "row")
    met = _upwards(held.select("cluster", "q", "w")).withColumnRenamed("cluster", "col").join(asked, "col").select("row", "col", "q", "w", F.posexplode("r").alias("n", "p"))
    inner = met.groupBy("row", "col", "n").agg(F.sum(_value(a, F.col("p"), F.col("q")) * F.col("w")).alias("t"))
    sums = inner.groupBy("row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda e: e["t"]).alias("t"))
    entry = lambda q, g: F.struct(q.alias("q"), g.alias("g"))
    far = _solved(a, sums).join(_sampled(a, "col", "c"), "col").select("row", F.zip_with("c", "g", entry).alias("e"))
    packed = held.groupBy(F.col("cluster").alias("col")).agg(F.collect_list(entry(F.col("q"), F.col("w"))).alias("e"))
    into = far.union(a.close.join(packed, "col").select("row", "e"))
    rows = _upwards(a.leaves.select("cluster", F.col("i").alias("k"), F.struct(*a.axes).alias("p"))).withColumnRenamed("cluster", "row")
    outer = rows.join(into, "row").select("k", "p", F.explode("e").alias("e"))
    out = outer.groupBy("k").agg(F.sum(_value(a, F.col("p"), F.col("e.q")) * F.col("e.g")).alias("v"))
    return a.keys.join(out, "k").select("i", "v")
