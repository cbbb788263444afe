"""Matrices that are a sparse table plus a low-rank product, and never become dense tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lowrank, matrix
from .common import stored


@dataclass(frozen=True)
class SparsePlusLowRank:
    """S + X Y': entries (i, j, v), and row tables (i, row) of the factors, or no factors at all.

    Equal entries add up. Rows of a factor that are missing are zero.
    """

    sparse: DataFrame
    factors: tuple[DataFrame, DataFrame] | None = None

    def apply(self, x: DataFrame, transpose: bool = False) -> DataFrame:
        """The matrix (or its transpose) times x with rows (i, v) or (i, k, v), k in 0, 1, ..; the parts' products add up."""
        got = matrix.apply(self.sparse, x, transpose)
        if self.factors is None:
            return got
        left, right = self.factors[::-1] if transpose else self.factors
        many = "k" in x.columns
        width = x.agg((F.max("k") + 1).alias("n")).first().n if many else 1
        c = lowrank.gram(right, lowrank.to_row_table(x, width) if many else x.select("i", F.array("v").alias("row"))) if width else None
        if c is None or not c.size:  # no vectors, or none of the factor's rows is among theirs
            return got
        y = lowrank.from_row_table(lowrank.times(left, c))
        return _added(got, y.select("i", F.col("k").cast(dict(got.dtypes)["k"]).alias("k"), "v") if many else y.select("i", "v"))

    def transposed(self) -> SparsePlusLowRank:
        return SparsePlusLowRank(_flip(self.sparse), self.factors and self.factors[::-1])

    def scaled(self, c: float) -> SparsePlusLowRank:
        return SparsePlusLowRank(self.sparse.withColumn("v", F.col("v") * c), self.factors and lowrank.scaled(self.factors, c))

    def plus(self, other: SparsePlusLowRank) -> SparsePlusLowRank:
        """The sum: entries under each other, factors beside each other; see recompressed."""
        both = self.sparse.select("i", "j", "v").union(other.sparse.select("i", "j", "v"))
        return SparsePlusLowRank(both.groupBy("i", "j").agg(F.sum("v").alias("v")), _beside(self.factors, other.factors))

    def times(self, other: SparsePlusLowRank) -> SparsePlusLowRank:
        """The product, again of both kinds: S T + X (T' Y)' + (S U + X Y' U) V' for S + X Y' and T + U V'.

        Only the sparse product can fill up; each of the two factor pairs keeps the rank of an operand.
        """
        a, b = (m.sparse.select("i", "j", "v") for m in (self, other))
        met = a.withColumnsRenamed({"j": "_m", "v": "_a"}).join(b.withColumnsRenamed({"i": "_m", "v": "_b"}), "_m")
        sparse = met.groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
        parts = None
        if self.factors is not None:
            x, y = self.factors
            parts = (x, stored(_rows(_flip(b), y)))
        if other.factors is not None:
            u, v = other.factors
            parts = _beside(parts, (stored(_tall(self.apply(lowrank.from_row_table(u)), u)), v))
        return SparsePlusLowRank(sparse, parts)

    def recompressed(self, rtol: float) -> SparsePlusLowRank:
        """The same matrix with factors of rank #(s >= rtol s0); entries stay as they are."""
        if self.factors is None or any(f.isEmpty() for f in self.factors):
            return SparsePlusLowRank(self.sparse)
        return SparsePlusLowRank(self.sparse, tuple(map(stored, lowrank.recompress(*map(stored, self.factors), rtol))))

    def weighted(self, weights: tuple[DataFrame, DataFrame], rtol: float) -> SparsePlusLowRank:
        """Every entry times that of the low-rank L R' (row tables): entries scaled, factors multiplied entrywise."""
        dot = F.aggregate(F.zip_with("_l", "_r", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        held = self.sparse.join(weights[0].select("i", F.col("row").alias("_l")), "i").join(weights[1].select(F.col("i").alias("j"), F.col("row").alias("_r")), "j")
        return SparsePlusLowRank(held.select("i", "j", (F.col("v") * dot).alias("v")), self.factors and lowrank.entrywise(self.factors, weights, rtol))

    def weighted_apply(self, weights: tuple[DataFrame, DataFrame], x: DataFrame) -> DataFrame:
        """The weighted matrix times x (i, v), without forming it: sum over r of diag(l_r) M diag(r_r) x."""
        left, right = weights
        z = right.join(x.select("i", F.col("v").alias("_x")), "i").select("i", F.posexplode("row").alias("k", "_w"), "_x")
        y = self.apply(z.select("i", "k", (F.col("_w") * F.col("_x")).alias("v")))
        return y.join(left.select("i", F.posexplode("row").alias("k", "_w")), ["i", "k"]).groupBy("i").agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def _flip(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _added(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums of two vector tables over their keys."""
    keys = [c for c in a.columns if c != "v"]
    return a.unionByName(b.select(*keys, "v")).groupBy(*keys).agg(F.sum("v").alias("v"))


def _beside(a, b):
    return a or b if a is None or b is None else lowrank.plus(a, b)


def _width(f: DataFrame) -> int:
    row = f.select(F.size("row").alias("n")).first()
    return row.n if row else 0


def _tall(x: DataFrame, like: DataFrame) -> DataFrame:
    return lowrank.to_row_table(x, _width(like))


def _rows(entries: DataFrame, f: DataFrame) -> DataFrame:
    """The sparse matrix times a factor, as a row table."""
    return _tall(matrix.apply(entries, lowrank.from_row_table(f)), f)
