"""Levelled splits of point sets, near and far block pairs, and independent batches of ellipsoids."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .knn import nearest
from .ordering import offsets, ranked
from .spatial import Side, classes_of, members, range_join

FINISH = 4096
#: Links of one group at most while a table of classes is finished in it.
LINKS = 1 << 20


def _numpy_sort(p: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Order of recursive halving from `depth` on, axis by depth, descending, split at n // 2."""
    if len(ids) <= 1:
        return np.arange(len(ids))
    axis = depth % p.shape[1]
    order = np.lexsort((ids, -p[:, axis]))
    h = len(ids) // 2
    parts = [order[:h], order[h:]]
    return np.concatenate([x[_numpy_sort(p[x], ids[x], depth + 1)] for x in parts])


def geometric_sort(points: DataFrame, axes: list[str], key: str = "id", finish: int = FINISH) -> DataFrame:
    """(key, place): the order of recursive halving along axis depth mod d, descending, ties by key.

    The upper levels number all rows by one range sort of (node, coordinate, id), of which a node's first place is known;
    nodes of at most `finish` rows are finished in one group each.
    """
    cur = stored(points.select(F.col(key).alias("id"), *axes).withColumns({"lo": F.lit(0).cast("long"), "n": F.lit(points.count()).cast("long")}))
    depth = 0
    while not cur.where(F.col("n") > finish).isEmpty():
        order = ranked(cur, [F.col("lo"), F.col(axes[depth % len(axes)]).desc(), F.col("id")], "_place")  # the nodes tile the places
        h = F.floor(F.col("n") / 2)
        cur = stored(order.withColumn("_f", F.col("_place") - F.col("lo") < h).select("id", *axes, F.when(F.col("_f"), F.col("lo")).otherwise(F.col("lo") + h).alias("lo"), F.when(F.col("_f"), h).otherwise(F.col("n") - h).alias("n")))
        depth += 1

    def finish_node(pdf: pd.DataFrame) -> pd.DataFrame:
        order = _numpy_sort(pdf[axes].to_numpy(float), pdf["id"].to_numpy(), depth)
        return pd.DataFrame({key: pdf["id"].to_numpy()[order], "place": int(pdf["lo"].iloc[0]) + np.arange(len(order))})

    return cur.groupBy("lo").applyInPandas(finish_node, f"{key} long, place long")


def cluster_tree(points: DataFrame, axes: list[str], key: str = "id", min_size: int = 16) -> tuple[DataFrame, DataFrame]:
    """(clusters, members): halving along the widest axis, ascending, while a cluster has more than min_size points.

    clusters: (level, cluster, parent, n, lo_0.., hi_0..); members: (key, cluster) with the leaf of each point. The root is
    cluster 1 and the children of c are 2c and 2c + 1. While a cluster has over FINISH points, the rows are numbered by a
    range sort of all of them and each cluster's first place; below that by windows.
    """
    if min_size < 2:
        raise ValueError("min_size must be over 1")
    cur = stored(points.select(F.col(key).alias("id"), *axes).withColumn("c", F.lit(1).cast("long")))
    trees, leaves, level = [], [], 0
    boxes = [*(F.min(a).alias(f"lo_{i}") for i, a in enumerate(axes)), *(F.max(a).alias(f"hi_{i}") for i, a in enumerate(axes))]
    while True:
        nodes = stored(cur.groupBy("c").agg(F.count(F.lit(1)).alias("n"), *boxes))
        trees.append(nodes.select(F.lit(level).alias("level"), F.col("c").alias("cluster"), F.floor(F.col("c") / 2).alias("parent"), "n", *(f"{e}_{i}" for e in ("lo", "hi") for i in range(len(axes)))))
        split = nodes.where(F.col("n") > min_size)
        leaves.append(cur.join(nodes.where(F.col("n") <= min_size).select("c"), "c", "left_semi").select(F.col("id").alias(key), F.col("c").alias("cluster")))
        if split.isEmpty():
            break
        width = F.array(*(F.col(f"hi_{i}") - F.col(f"lo_{i}") for i in range(len(axes))))
        axis = F.array_position(width, F.array_max(width)).cast("int")
        held = cur.join(split.select("c", "n", axis.alias("_axis")), "c").withColumn("_x", F.element_at(F.array(*axes), F.col("_axis")))
        if split.where(F.col("n") > FINISH).isEmpty():
            numbered = held.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy("_x", "id")))
        else:
            at = offsets(split, "c", "n").select("c", "start")
            numbered = ranked(stored(held), [F.col("c"), F.col("_x"), F.col("id")], "_place").join(at, "c").withColumn("_r", F.col("_place") - F.col("start") + 1)
        cur = stored(numbered.select("id", *axes, (2 * F.col("c") + (F.col("_r") > F.floor(F.col("n") / 2)).cast("long")).alias("c")))
        level += 1
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(trees), union(leaves)


def block_pairs(clusters: DataFrame, eta: float = 1.0) -> DataFrame:
    """(row, col, kind): far pairs have box distance >= eta * min(diameters); near ones are two leaves; others split."""
    dims = sum(c.startswith("lo_") for c in clusters.columns)
    parents = clusters.select(F.col("parent").alias("cluster")).distinct()
    leaf = clusters.join(parents, "cluster", "left_anti").select("cluster", F.lit(True).alias("leaf"))
    nodes = stored(clusters.join(leaf, "cluster", "left").select("cluster", "parent", F.coalesce("leaf", F.lit(False)).alias("leaf"), *(c for c in clusters.columns if c[:3] in ("lo_", "hi_"))))
    side = lambda p: nodes.select(*(F.col(c).alias(p + c) for c in nodes.columns))
    diam = lambda p: F.sqrt(sum(((F.col(f"{p}hi_{i}") - F.col(f"{p}lo_{i}")) ** 2 for i in range(dims)), F.lit(0.0)))
    gaps = [F.greatest(F.col(f"r_lo_{i}") - F.col(f"c_hi_{i}"), F.col(f"c_lo_{i}") - F.col(f"r_hi_{i}"), F.lit(0.0)) for i in range(dims)]
    dist = F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    cur = nodes.where("cluster = 1").select(F.col("cluster").alias("row"), F.col("cluster").alias("col"))
    done = []
    while not cur.isEmpty():
        full = stored(cur.join(side("r_"), F.col("row") == F.col("r_cluster")).join(side("c_"), F.col("col") == F.col("c_cluster")).withColumn("kind", F.when(dist >= eta * F.least(diam("r_"), diam("c_")), "far").when(F.col("r_leaf") & F.col("c_leaf"), "near")))
        done.append(full.where("kind is not null").select("row", "col", "kind"))
        open_ = full.where("kind is null")
        rows = F.when(F.col("r_leaf"), F.array("row")).otherwise(F.array(2 * F.col("row"), 2 * F.col("row") + 1))
        cols = F.when(F.col("c_leaf"), F.array("col")).otherwise(F.array(2 * F.col("col"), 2 * F.col("col") + 1))
        cur = stored(open_.select(F.explode(rows).alias("row"), cols.alias("cs")).select("row", F.explode("cs").alias("col")))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def _golden(lam: np.ndarray, v: np.ndarray, tau: float, steps: int = 60) -> np.ndarray:
    """min over s in [0, 1] of 1 - s (1 - s) / tau^2 * sum v^2 / (1 + s (lam - 1)), for all rows at once."""
    k = lambda s: 1 - s * (1 - s) / tau**2 * (v**2 / (1 + s[:, None] * (lam - 1))).sum(1)
    a, b, g = np.zeros(len(lam)), np.ones(len(lam)), (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = b - g * (b - a), a + g * (b - a)
        left = k(x) < k(y)
        a, b = np.where(left, a, x), np.where(left, y, b)
    return k((a + b) / 2)


def ellipsoid_pairs(ellipsoids: DataFrame, tau: float, key: str = "ell_id", mu: str = "mu", sigma: str = "sigma") -> DataFrame:
    """(a, b), a < b: ellipsoids that intersect; boxes first, then the exact test in Arrow batches, once for equal ones."""
    dim = ellipsoids.select(F.size(mu).alias("n")).first()
    if dim is None:
        return ellipsoids.select(F.col(key).alias("a"), F.col(key).alias("b")).where(F.lit(False))
    n = range(dim["n"])
    r = lambda i: tau * F.sqrt(F.col(sigma)[i][i])
    held = ellipsoids.select(F.col(key).alias("id"), mu, sigma, *((F.col(mu)[i] - r(i)).alias(f"lo{i}") for i in n), *((F.col(mu)[i] + r(i)).alias(f"hi{i}") for i in n))
    s = Side(held, [f"lo{i}" for i in n], [f"hi{i}" for i in n], [mu, sigma])
    found = classes_of(s)
    if found:
        one = found.side.df.withColumnsRenamed({"_k": "id"})
        s = Side(one, s.lo, s.hi)
    near = range_join(s, s, F.col("l_id") < F.col("r_id")).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.col(f"l_{mu}").alias("ma"), F.col(f"r_{mu}").alias("mb"), F.col(f"l_{sigma}").alias("sa"), F.col(f"r_{sigma}").alias("sb"))

    def test(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            sa, sb = (np.array([[list(x) for x in m] for m in pdf[c]], float) for c in ("sa", "sb"))
            d = np.array(pdf["ma"].tolist(), float) - np.array(pdf["mb"].tolist(), float)
            inv = np.linalg.inv(np.linalg.cholesky(sa))
            lam, u = np.linalg.eigh(inv @ sb @ inv.transpose(0, 2, 1))
            v = np.einsum("nji,njk,nk->ni", u, inv, d)
            yield pdf.loc[_golden(lam, v, tau) >= 0, ["a", "b"]]

    kind = dict(near.dtypes)["a"]
    pairs = near.mapInPandas(test, f"a {kind}, b {kind}")
    if not found:
        return pairs
    twins = one.where(reduce(and_, [F.col(a) <= F.col(b) for a, b in zip(s.lo, s.hi)])).select(F.col("id").alias("a"), F.col("id").alias("b"))
    sizes = one.select("id", "_p")
    met = pairs.union(twins).toDF("l__k", "r__k").join(sizes.toDF("l__k", "l__p"), "l__k").join(sizes.toDF("r__k", "r__p"), "r__k")
    out = members(members(met, found, "l_", False), found, "r_", True).where((F.col("l__k") != F.col("r__k")) | (F.col("l_id") < F.col("r_id")))
    return out.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))


def _components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, l): the smallest id of each row's component; edges (a, b) in both directions, a label's own label taken each round."""
    cur = stored(ids.select("id", F.col("id").alias("l")))
    while True:
        label = cur.select(F.col("id").alias("b"), F.col("l").alias("m"))
        near = edges.join(label, "b").groupBy(F.col("a").alias("id")).agg(F.min("m").alias("m"))
        least = stored(cur.join(near, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("_old")))
        jump = least.select(F.col("id").alias("l"), F.col("l").alias("_j"))
        new = stored(least.join(jump, "l").select("id", F.col("_j").alias("l"), F.col("_j").eqNullSafe(F.col("_old")).alias("_same")))
        if new.where(~F.col("_same")).isEmpty():
            return new.select("id", "l")
        cur = new.select("id", "l")


def _first_fit(members: pd.DataFrame, links: pd.DataFrame, used: dict | None = None) -> np.ndarray:
    """The batch of each row (c, id), ids ascending: the first that neither its class nor a linked class (a, b) holds; used:
    the batches, as bits, that classes hold already."""
    near, used = links.groupby("a")["b"].agg(list).to_dict(), dict.fromkeys(members["c"], 0) | (used or {})
    out = []
    for c in members["c"]:
        taken = used[c]
        for b in near.get(c, ()):
            taken |= used.get(b, 0)
        bit = ~taken & (taken + 1)
        used[c] |= bit
        out.append(bit.bit_length() - 1)
    return np.array(out, dtype=np.int32)


def _farthest_first(state: pd.DataFrame, links: pd.DataFrame, nexts: pd.DataFrame, batch: int, most: int) -> tuple[list, np.ndarray]:
    """(class, id, batch) of the next batches, at most `most`, until every centre has been come to; and the distances then.

    state (c, mu, n, used, far), links (a, b) in both directions, nexts (c, id, r): members of place r within their class.
    """
    state = state.sort_values("c").reset_index(drop=True)
    c, mu, far = state["c"].to_numpy(), np.array(state["mu"].tolist(), float), state["far"].to_numpy(float).copy()
    used, n, at = state["used"].to_numpy().copy(), state["n"].to_numpy(), {v: k for k, v in enumerate(c)}
    near: list[list[int]] = [[] for _ in c]
    for a, b in zip(links["a"], links["b"]):
        if a in at and b in at:
            near[at[a]].append(at[b])
    ids = {(at[x], r): i for x, i, r in zip(nexts["c"], nexts["id"], nexts["r"])}
    out: list = []
    for step in range(most):
        left = np.flatnonzero(used < n)
        if not len(left) or far[left].max() == 0:
            break
        blocked, taken = np.zeros(len(c), bool), []
        for k in sorted(left.tolist(), key=lambda k: (-far[k], ids[k, used[k]])):
            if not blocked[k]:
                taken.append(k)
                blocked[near[k]] = True
        out += [(c[k], ids[k, used[k]], batch + step) for k in taken]
        used[taken] += 1
        for s in range(0, len(c), 1024):  # the places in slices
            dsq = np.zeros((len(c[s : s + 1024]), len(taken)))
            for x in mu.T:
                d = x[taken][None, :] - x[s : s + 1024, None]
                dsq += d * d
            far[s : s + 1024] = np.minimum(far[s : s + 1024], dsq.min(axis=1))
    return out, pd.DataFrame({"c": c, "far": far})


def _stretch(left: DataFrame, edges: DataFrame, nexts: DataFrame, batch: int, most: int, kind: str) -> DataFrame:
    """(c, id, batch, far): the members that _farthest_first takes, and the distances of the classes on rows without an id."""
    blank = {"mu": "array<double>", "n": "long", "used": "long", "far": "double", "b": kind, "id": kind, "r": "long"}
    wide = lambda df, what, c: df.select(F.lit(1).alias("g"), F.lit(what).alias("what"), F.col(c).alias("c"), *(F.col(x).cast(t).alias(x) if x in df.columns else (F.col(c) if x in ("b", "id") else F.array() if x == "mu" else F.lit(0)).cast(t).alias(x) for x, t in blank.items()))  # noqa: E731, no nulls, so that whole numbers stay whole
    both = wide(left, 0, "c").union(wide(edges, 1, "a")).union(wide(nexts.select("c", "id", "r"), 2, "c"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, links, nexts = (pdf[pdf["what"] == w] for w in (0, 1, 2))
        out, ends = _farthest_first(state[["c", "mu", "n", "used", "far"]], links[["c", "b"]].rename(columns={"c": "a"}), nexts, batch, most)
        rows = [(c, i, b, None) for c, i, b in out] + [(c, None, None, f) for c, f in zip(ends["c"], ends["far"])]
        return pd.DataFrame({n: pd.array([r[k] for r in rows], dtype=t) for k, (n, t) in enumerate((("c", object), ("id", object), ("batch", "Int32"), ("far", "Float64")))})

    return both.groupBy("g").applyInPandas(run, f"c {kind}, id {kind}, batch int, far double")


def ellipsoid_batches(ellipsoids: DataFrame, tau: float, key: str = "ell_id", mu: str = "mu", sigma: str = "sigma", max_batches: int | None = None, finish: int = 1 << 16) -> DataFrame:
    """(key, batch): farthest-first independent batches; every ellipsoid ends in one batch (or in none, beyond max_batches).

    In each batch the ellipsoids are ordered by distance to the nearest already picked centre, farthest first, then key;
    the greedy choice along that order is found in rounds: undecided ones that come before all undecided neighbours are
    taken and their neighbours dropped, which gives the sequential answer.

    Equal ellipsoids are one class, known by its smallest key, so links don't grow with copies; a batch takes at most the
    next member of a class. While there are at most `finish` classes and LINKS links, the batches up to the one that has come to every
    centre are made in one group, a stretch at a time with at most `finish` members. From then on the order is that of the
    keys for good and batches are a first fit: a class without links takes one batch after the other, the members of a
    component with up to `finish` members and links are fitted in one group, and larger components in the order of the keys,
    `finish` members at a time, with the links of their classes and the batches that these hold. Rows with null in the
    key, mu or sigma are left out.
    """
    rows = ellipsoids.select(F.col(key).alias("id"), F.col(mu).alias("mu"), F.col(sigma).alias("sigma")).dropna()
    classes = stored(rows.groupBy("mu", "sigma").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")))
    kind, empty = dict(classes.dtypes)["c"], ellipsoids.select(key, F.lit(0).alias("batch")).where(F.lit(False))
    first = classes.select(F.size("mu").alias("d")).first()
    if first is None:
        return empty
    dims = range(first["d"])
    start = offsets(classes, "c", "n").select("c", "start")
    order = ranked(stored(rows.join(classes, ["mu", "sigma"]).select("c", "id")), [F.col("c"), F.col("id")], "_place")
    members = stored(order.join(start, "c").select("c", "id", (F.col("_place") - F.col("start")).alias("r")))
    pairs = stored(ellipsoid_pairs(classes, tau, "c", "mu", "sigma"))
    edges = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    left = stored(classes.select("c", "mu", "n", F.lit(0).cast("long").alias("used"), F.lit(float("inf")).alias("far")))
    out, batch = [], 0

    def settled(left: DataFrame, batch: int) -> list[DataFrame]:
        """The batches of all that is left: first fit in the order of the keys."""
        ids = left.select(F.col("c").alias("id"))
        live = stored(edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
        parts = left.join(_components(live, ids).withColumnRenamed("id", "c"), "c")
        links = live.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("_d"))
        sizes = parts.join(links, "c", "left").groupBy("l").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.col("n") - F.col("used") + F.coalesce("_d", F.lit(0))).alias("_s"))
        parts = stored(parts.join(sizes, "l"))
        lone, small = F.col("_k") == 1, (F.col("_k") > 1) & (F.col("_s") <= finish)
        rest = lambda which: members.join(parts.where(which).select("c", "l", "used"), "c").where("r >= used")
        ones = rest(lone).select(F.col("id").alias(key), (F.lit(batch) + F.col("r") - F.col("used")).cast("int").alias("batch"))
        mine = live.join(parts.where(small).select(F.col("c").alias("a"), F.col("l").alias("m")), "a").select("a", "b", "m")

        def fit(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            return pd.DataFrame({key: pdf["id"].to_numpy(), "batch": batch + _first_fit(pdf, links)})

        fitted = stored(rest(small).select("id", "c", "l")).groupBy("l").cogroup(stored(mine).groupBy("m")).applyInPandas(fit, f"`{key}` {kind}, batch int")
        big = ~lone & ~small
        queue = stored(ranked(stored(rest(big).select("id", "c", "l")), [F.col("id")], "_place"))
        wide = stored(live.join(parts.where(big).select(F.col("c").alias("a"), F.col("l").alias("m")), "a").select("a", "b", "m"))
        done, total, size = [stored(ones), stored(fitted)], queue.count(), max(1, finish)
        placed = None  # (c, batch) of the members of larger components so far

        def go_on(pdf: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            pdf, known = pdf.sort_values("id"), links[links["held"].notna()]
            used = {c: sum(1 << (int(b) - batch) for b in held) for c, held in zip(known["a"], known["held"])}
            got = batch + _first_fit(pdf, links[links["held"].isna()], used)
            return pd.DataFrame({"c": pdf["c"].to_numpy(), "id": pdf["id"].to_numpy(), "batch": got})

        for start in range(0, total, size):
            block = stored(queue.where(F.col("_place").between(start, start + size - 1)).select("id", "c", "l"))
            mine = stored(wide.join(block.select(F.col("c").alias("a")).distinct(), "a", "left_semi"))
            table = mine.select("a", "b", "m", F.lit(None).cast("array<int>").alias("held"))
            if placed is not None:
                asked = mine.select(F.col("b").alias("c"), "m").union(block.select("c", F.col("l").alias("m"))).distinct()
                held = placed.join(asked, "c").groupBy("c", "m").agg(F.collect_set("batch").alias("held"))
                table = table.union(held.select(F.col("c").alias("a"), F.col("c").alias("b"), "m", "held"))
            new = stored(block.groupBy("l").cogroup(table.groupBy("m")).applyInPandas(go_on, f"c {kind}, id {kind}, batch int"))
            placed = new.select("c", "batch") if placed is None else placed.union(new.select("c", "batch"))
            done.append(new.select(F.col("id").alias(key), "batch"))
        return done

    links = edges.count()
    while not left.isEmpty() and (max_batches is None or batch < max_batches):
        open_ = left.agg(F.sum(F.col("n") - F.col("used")).alias("n"), F.max("far").alias("far"), F.count(F.lit(1)).alias("k")).first()
        if open_["far"] == 0:
            out.extend(settled(left, batch))
            break
        if open_["k"] <= finish and links // 2 <= LINKS:
            most = max(1, finish // open_["k"])
            nexts = members.join(left.select("c", "used"), "c").where((F.col("r") >= F.col("used")) & (F.col("r") < F.col("used") + most))
            done = stored(_stretch(left, edges, nexts, batch, most, kind))
            out.append(done.where("id is not null").select(F.col("id").alias(key), "batch"))
            taken = done.where("id is not null").groupBy("c").agg(F.count(F.lit(1)).alias("_t"))
            ends = done.where("id is null").select("c", F.col("far").alias("_far"))
            left = left.join(taken, "c", "left").join(ends, "c").withColumns({"used": F.col("used") + F.coalesce("_t", F.lit(0)), "far": F.col("_far")}).drop("_t", "_far")
            left = stored(left.where("used < n").select("c", "mu", "n", "used", "far"))
            batch = done.agg(F.max("batch")).first()[0] + 1
            continue
        at = stored(left.join(members.withColumnRenamed("r", "used"), ["c", "used"]).select("c", "id", F.struct((-F.col("far")).alias("f"), F.col("id").alias("id")).alias("o")))
        todo, taken = at, None
        while not todo.isEmpty():
            near = edges.join(todo.select(F.col("c").alias("a"), F.col("o").alias("oa")), "a").join(todo.select(F.col("c").alias("b"), F.col("o").alias("ob")), "b")
            blocked = near.where("ob < oa").select(F.col("a").alias("c")).distinct()
            win = stored(todo.join(blocked, "c", "left_anti").select("c", "id"))
            out_now = edges.join(win.select(F.col("c").alias("a")), "a").select(F.col("b").alias("c")).distinct()
            todo = stored(todo.join(win, "c", "left_anti").join(out_now, "c", "left_anti"))
            taken = win if taken is None else taken.union(win)
        taken = stored(taken)
        out.append(taken.select(F.col("id").alias(key), F.lit(batch).alias("batch")))
        left = left.join(taken.select("c", F.lit(1).alias("_t")), "c", "left").withColumn("used", F.col("used") + F.coalesce("_t", F.lit(0)))
        new = stored(left)
        rest, flat = new.where("used < n").drop("_t"), lambda df: df.select(F.col("c").alias("id"), *(F.col("mu")[i].alias(f"x{i}") for i in dims))
        if open_["far"] > 0:
            near = nearest(flat(new.where("_t = 1")), flat(rest), [f"x{i}" for i in dims], 1).select(F.col("q").alias("c"), F.col("dsq").alias("d"))
            rest = rest.join(near, "c").withColumn("far", F.least("far", "d")).drop("d")
        left = stored(rest.select("c", "mu", "n", "used", "far"))
        batch += 1
    if not out:
        return empty
    while len(out) > 1:  # in pairs, so that the plan of many batches stays shallow
        out = [a.union(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) // 2 * 2 :]
    return out[0] if max_batches is None else out[0].where(F.col("batch") < max_batches)
