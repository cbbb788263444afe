"""Periodic runs of words by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
max(least, times * q) that no neighbouring word extends. In each text, suffixes are sorted, and the classes of
neighbouring suffixes are united by decreasing common prefix. Each class keeps its positions in order, so a union shows
which positions become neighbours. If two such positions lie at a distance d of at most their common prefix L, the words
from the first on have smallest period d for d + L words and no word after them goes on; if none before does, that is
a run. Every run is found so once: its first position and the one a period later cannot have another one of the class
between them, or the period would not be the smallest.

A run of `least` words or more that holds `times` periods repeats its first least - least // times words, so only
positions whose next words up to the largest power of two below that are found again in their text go on. They are found
for a whole batch of texts by doubling.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_rows

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed string"
#: Words of a block of an ordered set; longer blocks are halved.
BLOCK = 1024


class Ordered:
    """A growing set of positions in order, kept in blocks so that an insertion moves few of them."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def around(self, x: int) -> tuple[int, int]:
        """The members next to x, which is none itself; -1 where there is none."""
        k = bisect_left(self.tops, x)
        if k == len(self.blocks):
            return self.tops[-1], -1
        b = self.blocks[k]
        i = bisect_left(b, x)
        return (b[i - 1] if i else self.tops[k - 1] if k else -1), b[i]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        b = self.blocks[k]
        insort(b, x)
        self.tops[k] = b[-1]
        self.size += 1
        if len(b) > BLOCK:
            half = len(b) // 2
            self.blocks[k : k + 1] = [b[:half], b[half:]]
            self.tops[k : k + 1] = [b[half - 1], b[-1]]


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of numbers, by prefix doubling."""
    n, step = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        values, rank = np.unique(key, return_inverse=True)
        step *= 2
        if len(values) == n or step >= n:
            order = np.empty(n, np.int64)
            order[rank] = np.arange(n)
            return order


def neighbours(ids: list[int], order: np.ndarray, held: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(common prefix, position, position) of neighbouring suffixes among the held positions, by Kasai's scan.

    Held are all positions whose next `length` words occur twice, so a prefix that long is inherited from the last step.
    """
    order = order[held[order]]
    before = np.full(len(ids), -1, np.int64)
    before[order[1:]] = order[:-1]
    out, h, last, n = [], 0, -2, len(ids)
    for i in np.flatnonzero(held).tolist():
        h = h - 1 if i == last + 1 and h > length else 0
        j, last = int(before[i]), i
        if j < 0:
            h = 0
            continue
        top = n - max(i, j)
        while h < top and ids[i + h] == ids[j + h]:
            h += 1
        out.append((h, j, i))
    return out


def runs_of(ids: list[int], held: np.ndarray, length: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. held: positions at which a run can start, or more."""
    edges = neighbours(ids, suffix_order(np.array(ids, np.int64)), held, length)
    edges.sort(key=lambda e: -e[0])
    root: dict[int, int] = {}
    sets: dict[int, Ordered] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    found = []
    for prefix, a, b in edges:
        if prefix + prefix // (times - 1) < least:
            break  # edges come by decreasing prefix: no longer run can follow
        a, b = find(a), find(b)
        large, small = sets.pop(a, None) or Ordered(a), sets.pop(b, None) or Ordered(b)
        if large.size < small.size:
            a, b, large, small = b, a, small, large
        members, pairs = list(small), []
        for k, x in enumerate(members):
            below, above = large.around(x)
            if below >= 0 and (k == 0 or below > members[k - 1]):
                pairs.append((below, x))
            if above >= 0 and (k + 1 == len(members) or above < members[k + 1]):
                pairs.append((x, above))
        for x in members:
            large.add(x)
        root[b] = a
        sets[a] = large
        for x, y in pairs:
            d = y - x
            if prefix >= (times - 1) * d and prefix + d >= least and (x == 0 or ids[x - 1] != ids[y - 1]):
                found.append((x, d + prefix, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated(ids: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Whether the next `length` (a power of two) words from each position are found again; ids differ between texts and
    ends has the end of each position's text."""
    at, rank, step = np.arange(len(ids)), ids, 1
    while True:
        values, rank, count = np.unique(rank, return_inverse=True, return_counts=True)
        again = count[rank] > 1
        at, rank = at[again], rank[again]
        if step >= length or not len(at):
            break
        full = np.full(len(ids) + 1, -1, np.int64)
        full[at] = rank
        there = at + step < ends[at]
        at, rank = at[there], rank[there]
        follow = full[at + step]
        at, rank, follow = at[follow >= 0], rank[follow >= 0], follow[follow >= 0]
        rank = rank * len(values) + follow
        step *= 2
    out = np.zeros(len(ids), bool)
    out[at] = True
    return out


def _batch(texts: list[str], least: int, times: int):
    """(n words, runs, best run, collapsed text) of each text."""
    numbered, all_ids, sizes, base = [], [], [], 0
    for t in texts:
        words = t.encode().split()  # ASCII white space
        seen: dict[bytes, int] = {}
        ids = [seen.setdefault(w, len(seen)) for w in words]
        numbered.append((words, ids))
        all_ids.append(np.array(ids, np.int64) + base)
        base += len(seen)
        sizes.append(len(ids))
    stops = np.cumsum(sizes)
    length = 1 << max(0, (least - least // times).bit_length() - 1)
    held = repeated(np.concatenate(all_ids), np.repeat(stops, sizes), length)
    for (words, ids), stop, size in zip(numbered, stops.tolist(), sizes):
        own = held[stop - size : stop]
        runs = runs_of(ids, own, length, least, times) if own.any() else []
        best = None
        for r in runs:  # the greatest exact quotient; the first of equal ones
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        if runs:
            cover = np.zeros(size + 1, np.int64)
            for start, count, period in runs:
                cover[start + period] += 1
                cover[start + count] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
        yield size, runs, best, b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """(doc_id, n_words, runs, best, collapsed) for every row of docs.

    runs has all runs (start, length, period) of at least max(least, times * period) words by start, then period; best is
    the one with the greatest length / period (ties: smallest start, then period; none: null); collapsed is the text
    without the words that some run repeats after its first period, joined by one space. Words lie between ASCII white
    space. Null and empty texts have no words, no runs and an empty collapsed text; repeated rows and null ids each give a
    row. Texts are handled one by one within tasks that take 256 at a time and about 4 MB of them; one text of any length
    is in memory whole.
    """
    if least < 2 or times < 2:
        raise ValueError("least and times must be at least 2")
    fields = ["start", "length", "period"]

    def run(batches):
        struct = pa.struct([(f, pa.int64()) for f in fields])
        types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(struct)), ("best", struct), ("collapsed", pa.string())])
        for part in slices(batches, 256):
            names, texts = part.column(0).to_pylist(), part.column(1)
            at = 0
            while at < len(names):
                group, size = [], 0
                while at + len(group) < len(names) and (not group or size < 1 << 22):
                    group.append(texts[at + len(group)].as_py())
                    size += len(group[-1])
                rows = [{"doc_id": i, "n_words": n, "runs": [dict(zip(fields, r)) for r in runs], "best": best and dict(zip(fields, best)), "collapsed": kept} for i, (n, runs, best, kept) in zip(names[at:], _batch(group, least, times))]
                yield pa.RecordBatch.from_pylist(rows, schema=types)
                at += len(group)

    return text_rows(docs).mapInArrow(run, SCHEMA)


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the texts of ids with crc32(id) % 10 = 0 repeat from word a on with period p.

    With h = crc32 of the decimal id, g = h div 10 and n words: a = g % n and p = 1 + (n - a) div (3 + g % 8). Their words
    are joined by one space; other texts, and those of a null id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    a = F.col("_g") % F.size("_w")
    p = 1 + F.floor((F.size("_w") - F.col("_a")) / (3 + F.col("_g") % 8))
    rows = text_rows(docs).select("*", h.alias("_h"), g.alias("_g"))
    chosen = rows.select("*", F.when(F.col("_h") % 10 == 0, words).alias("_w")).select("*", F.when(F.size("_w") > 0, a).alias("_a")).select("*", F.when(F.col("_a").isNotNull(), p).alias("_p"))
    from_ = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    turned = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: F.element_at("_w", (from_(i) + 1).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("_p").isNotNull(), turned).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row a document of `with_periods`: the number of its runs, its strongest run and digests of runs and collapsed text."""
    found = periodic_runs(with_periods(docs))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{f}").alias(f) for f in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
