"""Trie of conversation prefixes, as balanced parentheses in shards of a sorted order.

Each conversation becomes a path: the digests (128 bits of SHA-256 over role and text) of its turns, one after the other.
Sorted by path, conversations with a common prefix are neighbours, so a range of them is a piece of the trie in preorder.
A shard writes that piece as balanced parentheses. With the least and greatest excess of blocks, and of pairs of blocks
above them, the closing parenthesis of every node is found; it delimits the subtree, the rank of leaf pairs counts its
leaves and cumulative arrays over the preorder give its members and savings.

Nodes on the paths of a shard's first and last row (its spines) may go on in other shards. What hangs off them is added
up in two rows a shard; these rows form shards of their own, level by level, until one shard holds what is left. So hot
prefixes and groups of equal conversations, however large, are dealt over shards like all others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH = 16
#: Rows and turns of a shard at most (one path of more turns is a shard of its own).
SHARD_ROWS, SHARD_TURNS = 65_536, 1 << 20
#: Spine rows of a shard at the levels above.
SPINE_ROWS = 4096
#: Parentheses of a block of the excess index.
BLOCK = 64
#: Ids of a piece of an end list that several shards share.
PIECE = 512
NONE = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<k: string, w: bigint>>"
MEASURES = ("convs", "least", "leaves", "kids", "saved")
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SCHEMA = f"kind string, shard long, key binary, parent binary, {NODE}, path binary, weights array<long>, " + ", ".join(f"{m} array<long>" for m in MEASURES) + ", first long, ids string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


class Parentheses:
    """A balanced sequence with block minima and maxima of its excess, and pairs of blocks above them up to one."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        blocks = -(-len(bits) // BLOCK)
        self.padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max // 2, np.int64)
        self.padded[: len(bits)] = self.excess
        self.padded = self.padded.reshape(blocks, BLOCK)
        known = np.where(self.padded < np.iinfo(np.int64).max // 2, self.padded, -1)
        self.least, self.most = [self.padded.min(axis=1)], [known.max(axis=1)]
        while len(self.least[-1]) > 1:
            low, high = self.least[-1], self.most[-1]
            if len(low) % 2:
                low, high = np.append(low, np.iinfo(np.int64).max // 2), np.append(high, -1)
            self.least.append(low.reshape(-1, 2).min(axis=1))
            self.most.append(high.reshape(-1, 2).max(axis=1))

    def _holds(self, level: int, block: np.ndarray, target: np.ndarray) -> np.ndarray:
        inside = block < len(self.least[level])
        at = np.where(inside, block, 0)
        return inside & (self.least[level][at] <= target) & (target <= self.most[level][at])

    def _scan(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place in each block, behind offset `after`, where the excess is target; -1 if none."""
        out = np.full(len(block), -1, np.int64)
        for s in range(0, len(block), 8192):
            e = slice(s, s + 8192)
            hit = (self.padded[block[e]] == target[e, None]) & (np.arange(BLOCK) > after[e, None])
            first = hit.argmax(axis=1)
            out[e] = np.where(hit[np.arange(len(first)), first], block[e] * BLOCK + first, -1)
        return out

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching closing parenthesis of every opening one."""
        target = self.excess[opens] - 1
        out = self._scan(opens // BLOCK, opens % BLOCK, target)
        todo = np.flatnonzero(out < 0)
        block, goal, found = opens[todo] // BLOCK + 1, target[todo], np.full(len(todo), -1, np.int64)
        for level in range(len(self.least)):  # up: a right neighbour is looked at, a left one waits for its pair
            look = (found < 0) & ((block % 2 == 1) | (level == len(self.least) - 1))
            hit = look & self._holds(level, block, goal)
            found[hit] = level
            on = found < 0
            block[on] = (block[on] + 1) // 2
        for level in range(len(self.least) - 1, 0, -1):  # down: the left block first
            here = found == level
            left = 2 * block[here]
            block[here] = np.where(self._holds(level - 1, left, goal[here]), left, left + 1)
            found[here] = level - 1
        out[todo] = self._scan(block, np.full(len(todo), -1), goal)
        return out


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share."""
    top = min(len(a), len(b)) // WIDTH
    if a[: top * WIDTH] == b[: top * WIDTH]:
        return top
    low = 0
    while top - low > 1:  # the first difference lies in [low, top)
        mid = (low + top) // 2
        low, top = (mid, top) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid)
    return low


def _key(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


class Shard:
    """The piece of the trie that sorted rows span. A row has a path, the bytes of its turns, and either an id (it ends
    there) or five measures at every depth of its path: members, smallest member, leaves, children and savings."""

    def __init__(self, paths, weights, ids=None, measures=None, final=False):
        self.paths, self.weights, self.ids, self.final = paths, weights, ids, final
        rows, depths = len(paths), np.array([len(p) // WIDTH for p in paths], np.int64)
        shared = np.array([-1, *map(_common, paths, paths[1:])], np.int64)
        fresh = depths - shared
        self.stop = np.cumsum(fresh)
        n = int(self.stop[-1])
        # a closing run and an opening run for each row, then the last closing run
        closes = np.append(np.append(0, depths[:-1]) - np.maximum(shared, 0), depths[-1] + 1)
        closes[0] = 0
        lengths = np.empty(2 * rows + 1, np.int64)
        lengths[0::2], lengths[1::2] = closes, fresh
        self.tree = Parentheses(np.repeat(np.arange(2 * rows + 1) % 2 == 1, lengths))
        opens = np.flatnonzero(self.tree.bits)
        close = self.tree.find_close(opens)
        self.size = (close - opens + 1) // 2
        self.row = np.repeat(np.arange(rows), fresh)
        self.depth = np.arange(n) - (self.stop - fresh)[self.row] + shared[self.row] + 1
        self.bytes = np.zeros(n, np.int64)
        for r in np.flatnonzero(fresh).tolist():
            s, e = int(shared[r]), int(depths[r])
            self.bytes[self.stop[r] - (e - max(s, 0)) : self.stop[r]] = weights[r][max(s, 0) : e]
        self._spines(depths, shared)
        self._own(rows, depths, shared, measures, n)
        pair = np.append(self.tree.bits[:-1] & ~self.tree.bits[1:], False)
        pair[opens[self.own["kids"] > 0]] = False  # its children hang in other shards
        leaf = np.cumsum(pair)
        self.leaves = leaf[close] - leaf[opens] + pair[opens] + self._subtree(self.own["leaves"])
        self.convs = self._subtree(self.own["convs"])
        self.saved = self._subtree(self.own["saved"] + np.where(self.spine, 0, (self.convs - 1) * self.bytes))
        ends = np.stack([np.arange(n), np.arange(n) + self.size], 1).ravel()
        self.least = np.minimum.reduceat(np.append(self.own["least"], NONE), ends)[::2]
        child = np.flatnonzero(self.parent >= 0)
        self.kids = self.own["kids"] + np.bincount(self.parent[child], minlength=n)

    def _subtree(self, own: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(own))
        return total[np.arange(len(own)) + self.size] - total[:-1]

    def _spines(self, depths, shared):
        """Parents of all nodes, the nodes of the first and the last row, and which nodes these are."""
        n = len(self.depth)
        self.parent = np.arange(n) - 1
        stack, self.left = [], list(range(int(depths[0]) + 1))
        for r, stop in enumerate(self.stop.tolist()):
            s = int(shared[r])
            del stack[s + 1 :]
            first = stop - (int(depths[r]) - s)
            if first < stop:
                self.parent[first] = stack[-1] if stack else -1
                stack.extend(range(first, stop))
        self.right = stack
        self.spine = np.zeros(n, bool)
        if not self.final:
            self.spine[self.left], self.spine[self.right] = True, True

    def _own(self, rows, depths, shared, measures, n):
        self.own = {m: np.full(n, NONE if m == "least" else 0, np.int64) for m in MEASURES}
        if measures is None:
            self.end = self.stop - 1  # equal paths end at the same node
            np.add.at(self.own["convs"], self.end, 1)
            np.minimum.at(self.own["least"], self.end, np.array(self.ids, np.int64))
            return
        stack: list[int] = []
        for r, stop in enumerate(self.stop.tolist()):
            s = int(shared[r])
            del stack[s + 1 :]
            stack.extend(range(stop - (int(depths[r]) - s), stop))
            for m in MEASURES:
                put = np.minimum if m == "least" else np.add
                self.own[m][stack] = put(self.own[m][stack], measures[m][r])

    def _prefix(self, node: int) -> bytes:
        return self.paths[self.row[node]][: int(self.depth[node]) * WIDTH]

    def nodes(self, keyed: bool) -> tuple[dict, int]:
        """The columns of the finished nodes and their number. keyed: with their keys, and without the digests of their ends."""
        done = np.flatnonzero(~self.spine)
        parent = self.parent[done]
        known = (parent >= 0) & ~self.spine[parent]
        keys = {int(p): _key(self._prefix(int(p))) for p in np.unique(parent[(parent >= 0) & ~known])}
        data = {"conv_id": self.least[done], "depth": self.depth[done], "n_convs": self.convs[done], "n_children": self.kids[done], "n_leaves": self.leaves[done], "saved_tokens": self.saved[done]}
        columns = {k: pa.array(v) for k, v in data.items()}
        columns["parent_conv_id"] = pa.array(np.where(known, self.least[parent], 0), mask=~known)
        columns["parent"] = pa.array([None if k or p < 0 else keys[p] for p, k in zip(parent.tolist(), known.tolist())], pa.binary())
        if keyed:
            columns["key"] = pa.array([_key(self._prefix(i)) for i in done.tolist()], pa.binary())
        else:
            sha, ends = np.full(len(self.depth), EMPTY, object), self._ends()
            for node, at, to in ends:
                sha[node] = hashlib.sha256(",".join(map(str, self.ids[at:to])).encode()).hexdigest()
            columns["ends_sha256"] = pa.array(sha[done].tolist(), pa.string())
        return columns, len(done)

    def _ends(self):
        """(node, first row, last row + 1) of the nodes at which rows end."""
        node, at, count = np.unique(self.end, return_index=True, return_counts=True)
        return list(zip(node.tolist(), at.tolist(), (at + count).tolist()))

    def pieces(self) -> list[dict]:
        """End lists of spine nodes, in pieces."""
        out = []
        for node, at, to in self._ends():
            if self.spine[node]:
                key = _key(self._prefix(node))
                out += [{"key": key, "first": self.ids[s], "ids": ",".join(map(str, self.ids[s : min(s + PIECE, to)]))} for s in range(at, to, PIECE)]
        return out

    def spines(self) -> list[dict]:
        """The two spine rows: what hangs off each node of the first and of the last path (common ones: of the first)."""
        if self.final:
            return []
        hang = {m: v.copy() for m, v in self.own.items()}
        child = np.flatnonzero((self.parent >= 0) & ~self.spine)
        child = child[self.spine[self.parent[child]]]
        up = self.parent[child]
        for m, values in (("convs", self.convs), ("leaves", self.leaves), ("saved", self.saved), ("kids", np.ones(len(self.depth), np.int64))):
            np.add.at(hang[m], up, values[child])
        np.minimum.at(hang["least"], up, self.least[child])
        out, seen = [], set()
        for row, nodes in ((0, self.left), (len(self.paths) - 1, self.right)):
            mine = [i not in seen for i in nodes]
            seen.update(nodes)
            out.append({"path": self.paths[row], "weights": [int(w) for w in self.weights[row]]} | {m: [int(hang[m][i]) if ok else (NONE if m == "least" else 0) for i, ok in zip(nodes, mine)] for m in MEASURES})
        return out


def _batch(columns: dict, size: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])


def _shards(level: int, final: bool, rows: int, turns: int):
    """The Arrow function that makes shards of the sorted rows of a partition."""

    def run(batches):
        schema, number = _arrow_schema(), TaskContext.get().partitionId() << 24

        def emit(held):
            nonlocal number
            number += 1
            shard = Shard([h[0] for h in held], [h[1] for h in held], [h[2] for h in held] if not level else None, {m: [h[2 + k] for h in held] for k, m in enumerate(MEASURES)} if level else None, final)
            columns, size = shard.nodes(bool(level))
            tag = {"kind": "node", "shard": (level << 56) | number}
            for at in range(0, size, 16_384):
                part = {k: v.slice(at, 16_384) for k, v in columns.items()}
                n = min(16_384, size - at)
                yield _batch(part | {k: pa.array([v] * n) for k, v in tag.items()}, n, schema)
            for kind, found in (("spine", shard.spines()), ("piece", [] if level else shard.pieces())):
                for at in range(0, len(found), 256):
                    yield pa.RecordBatch.from_pylist([{f.name: None for f in schema} | {"kind": kind} | x for x in found[at : at + 256]], schema=schema)

        held, held_turns = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) >= rows or held_turns + len(row[1]) > turns):
                    yield from emit(held)
                    held, held_turns = [], 0
                held.append(row)
                held_turns += len(row[1])
        if held:
            yield from emit(held)

    return run


def _joined_digests(pieces: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 of the pieces of each key, comma-joined by their first id.

    A digest can't be put together from those of parts, so a key's pieces pass one task, one after the other and none
    kept; everything else about a hot key is done in its shards.
    """

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != last:
                    if state:
                        out.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return pieces.select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first").mapInArrow(run, "key binary, ends_sha256 string")


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by turn (null first; ties by digest), each with the digest of its
    role and text (null: empty) and the UTF-8 bytes of its text.

    Rows without a conversation id belong to none and are left out. Other columns don't matter. The digests of one
    conversation (some 50 bytes a turn), not its texts, are held together.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    one = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").cast("long").alias("turn"), digest.alias("k"), F.octet_length(text).cast("long").alias("w"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["k"].alias("k"), x["w"].alias("w"))).cast(TURNS).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Sequences in which conversation c starts with the first h turns of conversation c - c % 5 and goes on with its own
    turns after its first h; h = crc32 of the decimal c, modulo 9."""
    held = materialize(turns, "turns")
    none = F.array().cast(TURNS)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    base = held.select(F.col("conv_id").alias("_base"), F.col("turns").alias("_first"))
    rows = held.withColumn("_base", F.col("conv_id") - F.col("conv_id") % 5).join(base, "_base", "left").withColumn("_h", h)
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("_first", none), F.lit(1), F.col("_h")), rest).alias("turns"))


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS, spine_rows: int = SPINE_ROWS) -> DataFrame:
    """One row a node of the trie of all sequences: conv_id (smallest member), depth, parent_conv_id (of the root: null),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Members of a node are the sequences that start with its turns; saved_tokens adds, over its subtree, the members but
    one times the bytes of the node's last turn; ends_sha256 is over the ids of the sequences that end there, ascending
    and comma-joined. An empty sequence ends at the root. Without sequences there are no nodes. Ids are taken as unique.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["k"]), ""))
    rows = materialize(turns.select(path.alias("path"), F.transform("turns", lambda x: x["w"]).alias("weights"), "conv_id"), "paths")
    level, last, parts = 0, None, []
    while True:
        if not level:
            dealt, final = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"), False
        else:
            n, width = rows.agg(F.count(F.lit(1)), F.sum(F.size("weights") + 1)).first()
            if not n:
                break
            final = n <= 16 or (n <= spine_rows and width <= shard_turns) or (last is not None and 2 * n > last)
            shards = 1 if final else max(-(-n // spine_rows), -(-width // shard_turns))
            dealt, last = (rows.repartition(1) if final else rows.repartitionByRange(shards, "path")).sortWithinPartitions("path"), n
        most = (1 << 62, 1 << 62) if final else (spine_rows if level else shard_rows, shard_turns)
        out = materialize(dealt.mapInArrow(_shards(level, final, *most), SCHEMA), "trie")
        parts.append(out)
        rows = out.where("kind = 'spine'").select("path", "weights", *MEASURES)
        level += 1
        if final:
            break
    own = parts[0].where("kind = 'node'")
    upper = own.where(F.lit(False))
    for p in parts[1:]:
        upper = upper.union(p.where("kind = 'node'"))
    digests = _joined_digests(parts[0].where("kind = 'piece'")).withColumnRenamed("ends_sha256", "_sha")
    upper = materialize(upper.drop("ends_sha256").join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("_sha", F.lit(EMPTY))).drop("_sha"), "spine_nodes")
    nodes = own.select("shard", "parent", *COLUMNS).union(upper.select("shard", "parent", *COLUMNS))
    # The parent of a node that hangs off a spine: looked up once for each shard and spine node, then by shard, so that the
    # many children of a hot node don't meet.
    asked = nodes.where("parent is not null").select("shard", "parent").distinct()
    parents = asked.join(upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("_up")), "parent")
    hanging = nodes.where("parent is not null").join(parents, ["shard", "parent"]).withColumn("parent_conv_id", F.col("_up"))
    return nodes.where("parent is null").select(*COLUMNS).union(hanging.select(*COLUMNS))
