"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. edges: u > v, may repeat. It aggregates minima (combined before the shuffle), then joins them back."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table (a, b); component is the smallest node reachable.

    Nodes are of any orderable type. Loops and repeated edges are harmless; nodes without edges don't appear.
    A hub's neighbours are never gathered in one place: only minima travel. A round is a large and a small star step in
    one job, whose edges are made distinct and written once. Stops when a round changes nothing.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = materialize(cur, "edges")
    seen = _digest(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        cur = materialize(_star(_star(cur, True), False).distinct(), "edges")
        now = _digest(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
