"""Exact nearest neighbours.

In two or three dimensions: a k-d tree over a sample of the points cuts space into tiles of about equal numbers of points,
however these are spread. Each query goes to the tile it lies in; the k-th distance there bounds how far its neighbours can
be, and a second round asks the other tiles whose bounding boxes lie within it. Two rounds are enough for all queries. In
a task, the points of a tile are cut the same way into small leaves.
In many dimensions: blocks of points against bounded slices of the queries by matrix products, exact distances for the
best of each block, and the same top k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import stored

#: Points of a tile where there are enough tasks; points of a leaf in a task; tiles at most; sampled points for each tile.
TILE, LEAF, MAX_TILES, SAMPLED = 32_768, 96, 1 << 16, 64
#: Queries of a tile that go to one task; more of them are split, each part with a copy of the tile.
ASKED = 200_000
#: Distances that are computed at once.
PAIRS = 1 << 20


def top_k(pairs: DataFrame, k: int, query: str = "q", item: str = "id", distance: str = "dsq") -> DataFrame:
    """The k nearest items of each query, ties by the smaller id, with `rank` from 1."""
    w = Window.partitionBy(query).orderBy(distance, item)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Tree:
    """A k-d tree with cuts at medians; leaves are numbered from 0. Equal points stay together, so a leaf that holds only
    one place may be larger than asked for."""

    def __init__(self, x: np.ndarray, size: int):
        self.axis, self.cut, self.low, self.high = [], [], [], []  # of inner nodes; children >= 0 are nodes, else ~leaf
        self.members: list[np.ndarray] = []
        self._grow(x, size)
        self.axis, self.cut = np.array(self.axis, np.int64), np.array(self.cut, np.float64)
        self.low, self.high = np.array(self.low, np.int64), np.array(self.high, np.int64)

    def _grow(self, x, size):
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            name, cut = None, None
            if len(rows) > size:
                held = x[rows]
                spans = held.max(axis=0) - held.min(axis=0)
                axis = int(spans.argmax())
                if spans[axis] > 0:
                    v = held[:, axis]
                    cut = np.partition(v, len(v) // 2)[len(v) // 2]
                    if not (v < cut).any():  # over half are the least value
                        cut = v[v > cut].min()
            if cut is None:
                self.members.append(rows)
                name = ~(len(self.members) - 1)
            else:
                name = len(self.cut)
                self.axis.append(axis)
                self.cut.append(cut)
                self.low.append(0)
                self.high.append(0)
                todo += [(rows[v < cut], name, 0), (rows[v >= cut], name, 1)]
            if parent >= 0:
                (self.high if side else self.low)[parent] = name

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each place."""
        at = np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1, np.int64)
        on = np.flatnonzero(at >= 0)
        while len(on):
            node = at[on]
            right = x[on, self.axis[node]] >= self.cut[node]
            at[on] = np.where(right, self.high[node], self.low[node])
            on = on[at[on] >= 0]
        return ~at

    def bound(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Give every leaf its bounding box (lo > hi where it is empty) and every node that of its leaves."""
        n = len(self.cut)
        self.box = [np.full((n, lo.shape[1]), np.inf), np.full((n, lo.shape[1]), -np.inf), lo, hi]
        for i in range(n - 1, -1, -1):  # children come after their parents
            for child in (self.low[i], self.high[i]):
                a, b = (lo[~child], hi[~child]) if child < 0 else (self.box[0][child], self.box[1][child])
                np.minimum(self.box[0][i], a, out=self.box[0][i])
                np.maximum(self.box[1][i], b, out=self.box[1][i])

    def reached(self, x: np.ndarray, rsq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, leaf) of all leaves whose box lies within the squared radius of a place."""
        rows, at = np.arange(len(x)), np.zeros(len(x), np.int64) if len(self.cut) else np.full(len(x), -1, np.int64)
        out = []
        while len(rows):
            inner = at >= 0
            lo, hi = np.empty((len(at), x.shape[1])), np.empty((len(at), x.shape[1]))
            lo[inner], hi[inner] = self.box[0][at[inner]], self.box[1][at[inner]]
            lo[~inner], hi[~inner] = self.box[2][~at[~inner]], self.box[3][~at[~inner]]
            gap = np.maximum(np.maximum(lo - x[rows], x[rows] - hi), 0.0)
            near = (gap * gap).sum(axis=1) <= rsq[rows] * (1 + 1e-12)
            near &= (lo <= hi).all(axis=1)
            leaf = near & ~inner
            out.append((rows[leaf], ~at[leaf]))
            go = near & inner
            rows, at = np.concatenate([rows[go], rows[go]]), np.concatenate([self.low[at[go]], self.high[at[go]]])
        return np.concatenate([o[0] for o in out] or [np.zeros(0, np.int64)]), np.concatenate([o[1] for o in out] or [np.zeros(0, np.int64)])


def _best(rows: np.ndarray, dsq: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (dsq, item) of each row, by row, distance and item."""
    order = np.lexsort((item, dsq, rows))
    rows = rows[order]
    first = np.searchsorted(rows, rows)
    return order[np.arange(len(rows)) - first < k]


class Tile:
    """The points of a tile in leaves; of points at one place those with the `want` smallest ids, as no others are an answer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, want: int):
        rank = np.empty(len(ids), np.int64)  # ids of any type compare by rank
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((rank, *(x[:, a] for a in range(x.shape[1]))))
        fresh = np.append(True, (x[order[1:]] != x[order[:-1]]).any(axis=1))[: len(order)]
        at = np.arange(len(order))
        keep = np.sort(order[at - np.maximum.accumulate(np.where(fresh, at, 0)) < want])
        self.ids, self.x, self.rank = ids[keep], x[keep], rank[keep]
        x = self.x
        self.tree = Tree(x, LEAF)
        self.tree.bound(*(np.array([f(x[m]) for m in self.tree.members]) for f in (lambda v: v.min(axis=0), lambda v: v.max(axis=0))))

    def _leaves(self, rows, leaves, places, names, k):
        """(rows, points, dsq, k-th least of each row) by leaf, in blocks of bounded size."""
        order = np.argsort(leaves, kind="stable")
        rows, leaves = rows[order], leaves[order]
        starts = np.flatnonzero(np.append(True, leaves[1:] != leaves[:-1])).tolist() if len(leaves) else []
        for s, e in zip(starts, [*starts[1:], len(leaves)]):
            points = self.tree.members[leaves[s]]
            step = max(1, PAIRS // len(points))
            for at in range(s, e, step):
                r = rows[at : min(at + step, e)]
                dsq = np.zeros((len(r), len(points)))
                for a in range(self.x.shape[1]):
                    d = self.x[points, a][None, :] - places[r, a][:, None]
                    dsq += d * d
                if names is not None:
                    dsq[self.ids[points][None, :] == names[r][:, None]] = np.inf
                yield r, points, dsq, np.partition(dsq, k - 1, axis=1)[:, k - 1] if len(points) >= k else np.full(len(r), np.inf)

    def nearest(self, places: np.ndarray, names, k: int, limit: np.ndarray | None = None):
        """(row, point, dsq): the k nearest points of each place (names: but those of that id), by row and rank; with a
        limit, those within it alone."""
        if limit is None:
            limit = np.full(len(places), np.inf)
            for r, _, _, last in self._leaves(np.arange(len(places)), self.tree.route(places), places, names, k):
                limit[r] = last
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for r, points, dsq, last in self._leaves(*self.tree.reached(places, limit), places, names, k):
            i, j = np.nonzero((dsq <= np.minimum(limit[r], last)[:, None]) & (dsq < np.inf))
            out.append((r[i], points[j], dsq[i, j]))
        rows, points, dsq = (np.concatenate(c) for c in zip(*out))
        keep = _best(rows, dsq, self.rank[points], k)
        return rows[keep], points[keep], dsq[keep]


def _kth(rows, dsq, n, k):
    """The k-th distance of each row, infinite where it has fewer; rows are in order with their distances ascending."""
    out, first = np.full(n, np.inf), np.searchsorted(rows, np.arange(n))
    count = np.bincount(rows, minlength=n)
    full = count >= k
    out[full] = dsq[first[full] + k - 1]
    return out


def _by_tile(batches, d: int, want: int):
    """(tile number, Tile, q, far, places) for each stretch of queries in rows (tile, salt, kind, id, q, far, places...) that
    are sorted by tile, salt and kind, points before queries."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = batch.column(0).to_numpy() << 20 | batch.column(1).to_numpy()
        kind = batch.column(2).to_numpy()
        x = np.stack([batch.column(6 + a).to_numpy(zero_copy_only=False) for a in range(d)], axis=1)
        part = tile * 2 + kind
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
            if tile[s] != last:
                held, last = [], tile[s]
            if not kind[s]:
                held.append((batch.column(3).slice(s, e - s).to_numpy(zero_copy_only=False), x[s:e]))
                continue
            if isinstance(held, list):
                held = Tile(*(np.concatenate(c) for c in zip(*held)), want)  # every leaf of the sample has points
            yield int(tile[s] >> 20), held, batch.column(4).slice(s, e - s).to_numpy(zero_copy_only=False), batch.column(5).slice(s, e - s).to_numpy(zero_copy_only=False), x[s:e]


def nearest(points: DataFrame, queries: DataFrame, axes: list[str], k: int, point_id: str = "id", query_id: str = "id", others: bool = False) -> DataFrame:
    """(q, id, dsq, rank): the k nearest points of every query, squared distances ascending, ties by id.

    Fewer than k points give all of them. others=True leaves out the points with the query's own id. Points and queries
    with null coordinates take no part; query ids are taken as unique. Of many points at one place only the k that can be
    an answer (one more with others) are kept, so a place with a third of all points is no hot tile; queries of a hot tile
    are split.
    """
    names, columns = [f"x{i}" for i in range(len(axes))], ["q", "id", "dsq", "rank"]
    places = [F.col(a).cast("double").alias(n) for a, n in zip(axes, names)]
    pts = points.select(F.col(point_id).alias("id"), *places).dropna(subset=names)
    asked = queries.select(F.col(query_id).alias("q"), *places).dropna(subset=names)
    spark, want, d = points.sparkSession, k + others, len(axes)
    kinds = pts.schema["id"].dataType.simpleString(), asked.schema["q"].dataType.simpleString()
    id_type, q_type = to_arrow_type(pts.schema["id"].dataType), to_arrow_type(asked.schema["q"].dataType)
    none = asked.where(F.lit(False)).select("q", F.lit(None).cast(kinds[0]).alias("id"), F.lit(0.0).alias("dsq"), F.lit(0).alias("rank"))
    n = pts.count()
    if not n:
        return none
    size = max(min(TILE, n // (2 * spark.sparkContext.defaultParallelism)), 512, 8 * want, -(-n // MAX_TILES))
    share = min(1.0, SAMPLED / size) if n > SAMPLED * 64 else 1.0
    sample = (pts.select(*names).sample(share, 7) if share < 1 else pts.select(*names)).toPandas().to_numpy(np.float64).reshape(-1, d)
    tree = Tree(sample, max(1, int(size * share)))
    if any(len(m) > 2 * size * share + 16 for m in tree.members):  # a place with very many points
        pts = _few_a_place(pts, names, want)
    tree.members = [None] * len(tree.members)  # the sample stays here
    both = pts.select(F.lit(0).cast("long").alias("kind"), "id", F.lit(None).cast(kinds[1]).alias("q"), *names).union(asked.select(F.lit(1).cast("long"), F.lit(None).cast(kinds[0]), "q", *names))

    def route(batches):
        for b in batches:
            x = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(d)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(tree.route(x)), *b.columns], names=["tile", "kind", "id", "q", *names])

    place = ", ".join(f"{c} double" for c in names)
    routed = stored(both.mapInArrow(route, f"tile long, kind long, id {kinds[0]}, q {kinds[1]}, {place}"))
    pts, asked = routed.where("kind = 0"), routed.where("kind = 1")
    tiles, counts = len(tree.members), {}
    lo, hi, full = np.full((tiles, d), np.inf), np.full((tiles, d), -np.inf), np.zeros(tiles, bool)
    ends = [f(c).alias(t + c) for c in names for f, t in ((F.min, "lo"), (F.max, "hi"))]
    for b in routed.groupBy("tile", "kind").agg(F.count(F.lit(1)).alias("n"), *ends).collect():  # at most twice MAX_TILES
        if b["kind"]:
            counts[b["tile"]] = b["n"]
        else:
            lo[b["tile"]], hi[b["tile"]], full[b["tile"]] = [b["lo" + c] for c in names], [b["hi" + c] for c in names], b["n"] >= want
    if not counts:
        return none
    tree.bound(lo, hi)

    def solve(first: bool):
        def run(batches):
            for home, tile, q, far, x in _by_tile(batches, d, want):
                rows, at, dsq = tile.nearest(x, q if others else None, k, None if first else far)
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
                more: list = [None] * len(q)
                reach = _kth(rows, dsq, len(q), k)
                if first:
                    for i in np.flatnonzero(np.isinf(reach)).tolist() if full.any() else []:  # no farther than the farthest corner of a full tile
                        corner = np.maximum(np.abs(lo[full] - x[i]), np.abs(hi[full] - x[i]))
                        reach[i] = (corner * corner).sum(axis=1).min() * (1 + 1e-9)
                    row, other = tree.reached(x, reach)
                    row, other = row[other != home], other[other != home]
                    order = np.argsort(row, kind="stable")
                    row, other = row[order], other[order]
                    for i, part in zip(np.unique(row).tolist(), np.split(other, np.flatnonzero(np.diff(row)) + 1)):
                        more[i] = part
                lone = np.setdiff1d([i for i, m in enumerate(more) if m is not None], rows).astype(np.int64)  # found nothing at home but go on
                order = np.argsort(np.concatenate([rows, lone]), kind="stable")
                every = np.concatenate([rows, lone])[order]
                begin = np.append(True, every[1:] != every[:-1])[: len(every)]
                pad = lambda a, kind: pa.concat_arrays([a, pa.nulls(len(lone), kind)]).take(pa.array(order))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(q[every], q_type), pad(pa.array(tile.ids[at], id_type), id_type), pad(pa.array(dsq), pa.float64()), pad(pa.array(rank.astype(np.int32)), pa.int32()),
                        pa.array([more[i] is not None for i in every.tolist()], pa.bool_()), pa.array([more[i] if b else None for i, b in zip(every.tolist(), begin.tolist())], pa.list_(pa.int64())),
                        pa.array(reach[every]), *(pa.array(x[every, a]) for a in range(d)),
                    ],
                    names=["q", "id", "dsq", "rank", "open", "tiles", "far", *names],
                )

        return run

    def ask(rows: DataFrame, counts: dict, first: bool) -> DataFrame:
        """Rows (tile, q, far, places) against the points of their tiles; counts: rows of each tile."""
        split = F.broadcast(spark.createDataFrame([(int(t), -(-c // ASKED)) for t, c in counts.items()], "tile long, parts long"))  # at most MAX_TILES
        here = rows.join(split, "tile").select("tile", F.pmod(F.xxhash64("q"), F.col("parts")).alias("salt"), F.lit(1).cast("long").alias("kind"), F.lit(None).cast(kinds[0]).alias("id"), "q", "far", *names)
        there = pts.join(split, "tile")  # tiles that nobody asks stay away
        there = there.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), "kind", "id", "q", F.lit(None).cast("double").alias("far"), *names)
        dealt = there.union(here).repartition("tile", "salt").sortWithinPartitions("tile", "salt", "kind")
        return dealt.mapInArrow(solve(first), f"q {kinds[1]}, id {kinds[0]}, dsq double, rank int, open boolean, tiles array<long>, far double, {place}")

    home = stored(ask(asked.withColumn("far", F.lit(None).cast("double")), counts, True))
    away = home.where("tiles is not null").select(F.explode("tiles").alias("tile"), "q", "far", *names)
    counts = {r["tile"]: r["n"] for r in away.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MAX_TILES
    if not counts:
        return home.select(*columns)
    found = home.where("open and id is not null").select("q", "id", "dsq").union(ask(away, counts, False).select("q", "id", "dsq"))
    return home.where("not open").select(*columns).union(top_k(found, k).select(*columns))


def _few_a_place(pts: DataFrame, names: list[str], want: int) -> DataFrame:
    """The points with the `want` smallest ids of each place (limited in the map tasks before they meet)."""
    w = Window.partitionBy(*names).orderBy("id")
    return pts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= want).drop("_n")


def nearest_vectors(points: DataFrame, queries: DataFrame, k: int, point_id: str = "id", vector: str = "p", query_id: str = "id", slack: int = 8, max_bytes: int = 64 << 20) -> DataFrame:
    """(q, id, dsq, rank) for array columns of many dimensions.

    The queries are taken in slices of about max_bytes, one after the other: a slice is broadcast, every block of points
    returns its best k + slack of each query by matrix product, with exact distances in double precision, and the best of
    all blocks are stored before the next slice.
    """
    asked = queries.select(F.col(query_id).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts, out = max(1, -(-8 * n * (width or 1) // max_bytes)), None
    held = points.select(F.col(point_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).collect()
        shared = points.sparkSession.sparkContext.broadcast((np.array([r.q for r in rows], np.int64), np.array([r.v for r in rows], np.float64)))

        def run(batches, shared=shared):
            q, v = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if not len(ids) or not len(q):
                    continue
                p = np.array(batch.column(1).to_pylist(), np.float64)
                for at in range(0, len(ids), 2048):
                    x, name = p[at : at + 2048], ids[at : at + 2048]
                    for s in range(0, len(q), 4096):
                        w = v[s : s + 4096]
                        rough = (w * w).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * w @ x.T
                        m = min(k + slack, len(x))
                        near = np.argpartition(rough, m - 1, axis=1)[:, :m]
                        exact = ((x[near] - w[:, None, :]) ** 2).sum(2)
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q[s : s + 4096], m)), pa.array(name[near].ravel()), pa.array(exact.ravel())], names=["q", "id", "dsq"])

        best = top_k(held.mapInArrow(run, "q long, id long, dsq double"), k)
        if parts > 1:
            best = stored(best)
            shared.destroy()
        out = best if out is None else out.union(best)
    return out


def smallest_spacing(points: DataFrame, axes: list[str], inside, point_id: str = "id") -> DataFrame:
    """One row: the least distance between two different rows among the points that fulfil `inside` (0 for duplicates)."""
    held = points.where(inside)
    return nearest(held, held, axes, 1, point_id, point_id, others=True).agg(F.sqrt(F.min("dsq")).alias("spacing"))
