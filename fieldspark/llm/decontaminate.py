"""Benchmark decontamination by Wu-Manber search over words.

Texts and benchmark items become word lists; the patterns are the item windows. For each pattern length there is a
block shift table (how far the search may jump for the last two words under the window), suffix buckets (the patterns
with the same last two words, by their first word as prefix check) and a direct comparison of all words. Benchmarks larger
than one bounded slice are searched in several passes over slices of the items, each adding its hits to the rows, so
nothing that is broadcast outgrows the bound.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

WINDOW = 10
SLICE_BYTES = 8 << 20
#: A-Z to lower case; everything that is not a digit, a letter or non-ASCII to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def windows_of(text: str | None, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return []
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))]


class WuManber:
    """Search for patterns of m words each. patterns: words -> values."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list]):
        self.m, self.size = m, min(2, m)
        self.jump = m - self.size + 1
        self.shift: dict[bytes, dict[bytes, int]] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], list]]]] = {}
        for p, values in patterns.items():
            for end in range(self.size - 1, m):
                first = p[end - 1] if self.size == 2 else b""
                row = self.shift.setdefault(p[end], {})
                row[first] = min(row.get(first, self.jump), m - 1 - end)
            self.buckets.setdefault(p[-self.size :], {}).setdefault(p[0], []).append((list(p), values))

    def find(self, words: list[bytes]):
        """Yield (end index, values) of every occurrence."""
        m, n, shift, jump, two = self.m, len(words), self.shift, self.jump, self.size == 2
        at = m - 1
        while at < n:
            row = shift.get(words[at])
            if row is None:
                at += jump
                continue
            step = row.get(words[at - 1] if two else b"", jump)
            if step:
                at += step
                continue
            for pattern, values in self.buckets[tuple(words[at - self.size + 1 : at + 1])].get(words[at - m + 1], ()):
                if words[at - m + 1 : at + 1] == pattern:
                    yield at, values
            at += 1


def build(items: list[tuple[int, str]], window: int = WINDOW) -> list[WuManber]:
    by: dict[int, dict] = {}
    for item, text in items:
        for p in windows_of(text, window):
            by.setdefault(len(p), {}).setdefault(p, []).append(item)
    return [WuManber(m, pats) for m, pats in sorted(by.items())]


#: The tables of the slice that a Python worker searched last, by the slice's broadcast.
_TABLES: dict[tuple[int, int], list[WuManber]] = {}


def _tables(key: tuple[int, int], items: list[tuple[int, str]]) -> list[WuManber]:
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = build(items, key[1])
    return _TABLES[key]


def _slices(benchmark: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """The items with an id and a text, in parts of some slice_bytes of text each."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _shared(rows: DataFrame, part: DataFrame):
    return rows.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in part.collect()])  # bounded by slice_bytes


def _pass(rows: DataFrame, part: DataFrame, window: int) -> DataFrame:
    shared = _shared(rows, part)
    key = (shared._jbroadcast.id(), window)

    def run(batches):
        tables = _tables(key, shared.value)
        for batch in batches:
            n_words, spans, found = [], [], []
            for text, old, before in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words, hits, ids = words_of(text), list(zip(old[::2], old[1::2])), set(before)
                for search in tables:
                    for end, got in search.find(words):
                        hits.append((end - search.m + 1, end + 1))
                        ids.update(got)
                flat: list[int] = []
                for a, b in sorted(hits):
                    if flat and a <= flat[-1]:
                        flat[-1] = max(flat[-1], b)
                    else:
                        flat += [a, b]
                n_words.append(len(words)), spans.append(flat), found.append(sorted(ids))
            arrays = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(run, "doc_id long, text string, n_words long, spans array<long>, items array<long>")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, text, n_words, spans (flat list of half-open word intervals that are hit), items (sorted ids) for every row.

    Null texts have no words. Items without words match nothing; items with a null id are left out; an item_id that
    repeats stands for all its texts. Repeated documents give a row each. Empty tables give empty or unhit results.
    """
    rows = text_rows(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<long>")})
    for part in _slices(benchmark, slice_bytes):
        rows = _pass(rows, part, window)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row; see benchmark_hits for odd cases."""
    rows = benchmark_hits(docs, benchmark, window, slice_bytes)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs without any benchmark window, with all their columns.

    Rows are judged one by one as they pass, so repeated or null ids, repeated rows and column names don't matter. Null
    and empty texts stay; an empty benchmark keeps everything; an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    for part in _slices(benchmark, slice_bytes):
        shared = _shared(docs, part)

        def run(batches, shared=shared, key=(shared._jbroadcast.id(), window)):
            tables = _tables(key, shared.value)
            for batch in batches:
                clean = [not any(True for s in tables for _ in s.find(w)) for w in map(words_of, batch.column(at).to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
