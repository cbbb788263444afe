"""Removal of repeated 400-byte strings with suffix arrays.

Every window of 400 bytes names one anchor: its 64-byte gram of least hash (the rightmost of equals). Equal windows
name equal anchors at the same place, so windows are compared only under their anchor. An anchor occurrence owns the run
of windows that name it; the bytes of that run are its segment. Segments of anchors that occur again are sorted in
per-shard suffix arrays, a segment that repeats as a whole with the bytes of two of its places: Larsson-Sadakane
refinement in numpy (only unsorted groups are sorted again, with doubled depth), Kasai's longest common prefixes, and a
window is repeated if it shares 400 bytes with a neighbour among the windows. A shard is some hundred kilobytes of whole
anchors; equal segments are sorted once in it and their places counted, and the prefixes are those of windows only. An
anchor with very many different segments is cut over shards; each such shard sends one digest for each of its different
windows to a range of digests, and there each is looked up by binary search among the sorted digests of all shards.
Segments are told apart by 64-bit hashes of gram and bytes, windows across shards by 128-bit digests.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_test, materialize, slices, text_rows

LENGTH = 400
GRAM = 64
PIECE = 1 << 22
ROWS = 256
SHARD_BYTES = 1 << 20
#: An anchor of so many segments is less than 1 MiB in a shard, each segment twice.
HOT_SEGMENTS = 650
RANGE_ROWS = 500_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]

#: Masks of the first bytes of a word.
_FRONT = np.array([(1 << 64) - (1 << 64 - 8 * k) for k in range(8)], np.uint64)


def _anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first window, windows, place of the anchor) of every anchor occurrence of a text."""
    n = len(raw) - length + 1
    wide = length - gram + 1
    mask = np.uint64((1 << 24) - 1)
    for at in range(0, max(n, 0), PIECE):
        m = min(PIECE, n - at)
        grams = m + wide - 1
        words = [np.ndarray(grams, "<u8", raw, at + k, (1,)) for k in (0, gram // 2 - 4, gram - 8)]  # three words of the gram choose; all of it names
        with np.errstate(over="ignore"):
            h = (words[0] * _MIX[0]) ^ (words[1] * _MIX[1]) ^ (words[2] * _MIX[2])
            h ^= h >> np.uint64(29)
            h *= _MIX[3]
        key = (h & ~mask) | (mask - np.arange(grams, dtype=np.uint64))
        rows = -(-grams // wide)
        full = np.full(rows * wide, np.iinfo(np.uint64).max, np.uint64)
        full[:grams] = key
        table = full.reshape(rows, wide)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(behind[:m], ahead[wide - 1 : wide - 1 + m])
        place = (mask - (low & mask)).astype(np.int64)
        starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        for s, w, p in zip(starts.tolist(), np.diff(np.append(starts, m)).tolist(), place[starts].tolist()):
            yield s + at, w, p + at


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def occurrences(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, th, anchor, seg, width, starts): anchor occurrences of each text, equal segments of a text in one row."""

    def run(batches):
        for batch in slices(batches, ROWS):
            cols: list[list] = [[] for _ in range(6)]
            for doc, text, th in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                mine: dict[tuple, list[int]] = {}
                for s, w, p in _anchors(raw, length):
                    key = (_signed(xxhash.xxh64_intdigest(raw[p : p + GRAM])), _signed(xxhash.xxh3_64_intdigest(raw[s : s + w + length - 1])), w)
                    mine.setdefault(key, []).append(s)
                for (a, g, w), starts in mine.items():
                    for c, v in zip(cols, (doc, th, a, g, w, starts)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())))], names=["doc_id", "th", "anchor", "seg", "width", "starts"]
            )

    return rows.select("doc_id", "text", "th").mapInArrow(run, "doc_id long, th long, anchor long, seg long, width int, starts array<int>")


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of concatenated segments; ends[i]: end of i's segment. Up to 2^21 bytes.

    Suffixes stop at the end of their segment; those that are alike to that end stay in the order of their places, which
    keeps the order of a suffix and its successor consistent, as Kasai's method needs.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError("a shard must be smaller than 2 MiB")
    rest = (ends - np.arange(n)).astype(np.int32)  # bytes to the end of the segment
    depth = int(rest.max(initial=0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    left = np.minimum(rest, 7)
    key = np.ndarray(n, ">u8", padded, 0, (1,)).astype(np.uint64) & _FRONT[left] | left.astype(np.uint64)  # seven bytes and their number
    sa = np.argsort(key)
    sorted_ = key[sa]
    heads = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.zeros(n + depth, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(heads, np.arange(n, dtype=np.int32), 0))
    slots, h = np.arange(n, dtype=np.int32), 7
    while h < depth:
        # Larsson-Sadakane: groups of one are final; only the others are sorted again, by the rank h further on.
        open_ = ~heads
        open_[:-1] |= ~heads[1:]
        slots = slots[open_]
        if not len(slots):
            break
        at = sa[slots]
        further = np.where(rest[at] > h, rank[at + h] + 1, 0).astype(np.int64)
        both = (rank[at].astype(np.int64) << 42) | (further << 21) | at
        both.sort()  # the place in the low bits: no indirect sort
        at = both & ((1 << 21) - 1)
        sa[slots] = at
        both >>= 21
        heads = np.concatenate([[True], both[1:] != both[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(heads, np.arange(len(slots), dtype=np.int32), 0))]
        h *= 2
    return sa


def kasai(raw: bytes, sa: np.ndarray, starts: np.ndarray, stops: np.ndarray, cap: int, widths: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix in sa with the one before it, within the segments and up to cap. With widths, sa holds
    only the suffixes of the first `width` places of each segment.

    Kasai's chains (a place's common prefix is at least that of the place before it, less one, if the place after its
    partner is in sa too) run along each segment; the chains of all segments advance together, eight bytes a comparison.
    """
    n = len(raw)
    words = np.ndarray(n + 1, "<u8", raw + bytes(8), 0, (1,))
    sizes = stops - starts
    rest = np.append(np.repeat(stops, sizes) - np.arange(n), 0)
    before = np.full(n, n, np.int64)  # the first suffix has none before it: place n, where nothing is left
    before[sa[1:]] = sa[:-1]
    inside = np.zeros(n + 2, bool)
    inside[sa] = True
    long = sizes if widths is None else widths
    order = np.argsort(-long)  # longest chains first, so those that still run are in front
    begins, sizes, long = starts[order], sizes[order], long[order]
    running = np.searchsorted(-long, -np.arange(int(long[0]) if len(long) else 0)).tolist()
    out = np.zeros(n, np.int64)
    held, partner = np.zeros(len(begins), np.int64), np.full(len(begins), n, np.int64)
    for t, m in enumerate(running):
        i = begins[:m] + t
        j = before[i]
        top = np.minimum(np.minimum(sizes[:m] - t, rest[j]), cap)
        h = np.minimum(np.where(inside[partner[:m] + 1], np.maximum(held[:m] - 1, 0), 0), top)
        live = np.flatnonzero(h < top)
        if len(live):
            x, y, most, at = i[live], j[live], top[live], h[live]
            while len(live):
                apart = words[x + at] ^ words[y + at]
                same = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3  # equal bytes in front: 0 to 8
                at = np.minimum(at + same, most)
                h[live] = at
                on = (same == 8) & (at < most)
                live, x, y, most, at = live[on], x[on], y[on], most[on], at[on]
        held[:m], partner[:m] = h, j
        out[i] = h
    return out[sa]


def _runs(offsets: np.ndarray) -> list[int]:
    """Sorted integers as a flat list of half-open runs."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return np.stack([offsets[np.concatenate([[0], cut + 1])], offsets[np.concatenate([cut, [len(offsets) - 1]])] + 1], axis=1).ravel().tolist()


def repeated_windows(segments: list[bytes], widths: list[int], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each segment, those of its first `width` windows that occur at another place in the segments, and those that
    stand for a class of equal windows (one of each class).

    Suffixes of equal segments are neighbours in the array whatever else is in it, so such segments are sorted once and
    their places counted.
    """
    numbers: dict[tuple[bytes, int], int] = {}
    which = [numbers.setdefault(x, len(numbers)) for x in zip(segments, widths)]
    raw = b"".join(s for s, _ in numbers)
    wide = np.array([w for _, w in numbers], np.int64)
    sizes = np.array([len(s) for s, _ in numbers], np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    copies = np.bincount(which, minlength=len(numbers))
    owned = np.arange(len(raw)) - np.repeat(starts, sizes) < np.repeat(wide, sizes)
    sa = suffix_array(np.frombuffer(raw, np.uint8), np.repeat(stops, sizes))
    sa = sa[owned[sa]]  # the windows in their order
    near = kasai(raw, sa, starts, stops, length, wide)[1:] >= length
    hit, first = np.repeat(copies > 1, sizes) & owned, np.zeros(len(raw), bool)
    hit[sa[1:][near]] = True
    hit[sa[:-1][near]] = True
    first[sa[np.concatenate([[True], ~near])[: len(sa)]]] = True
    cut = [(s, s + w) for s, w in zip(starts.tolist(), wide.tolist())]
    hits, firsts = [np.flatnonzero(hit[a:b]) for a, b in cut], [np.flatnonzero(first[a:b]) for a, b in cut]
    met: set[int] = set()
    none = np.zeros(0, np.int64)
    return [hits[k] for k in which], [none if k in met or met.add(k) else firsts[k] for k in which]


_MARKS = "anchor long, seg long, runs array<int>"


def _marks(out: list[tuple]) -> pa.RecordBatch:
    a, g, r = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(g, pa.int64()), pa.array(r, pa.list_(pa.int32()))], names=["anchor", "seg", "runs"])


def _shards(batches, shard_bytes: int, split: bool):
    """Lists of (anchor, seg, width, bytes) of some shard_bytes; anchors stay whole unless they may be split. The second
    place of a segment, next to the first, takes no room in the arrays and is not counted."""
    held: list[tuple] = []
    size, last = 0, (None, None)
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            again = row[:2] == last
            if size >= shard_bytes and (split or row[0] != last[0]) and not again:
                yield held
                held, size = [], 0
            held.append(row)
            size, last = size + (0 if again else len(row[3])), row[:2]
    if held:
        yield held


def _shard_marks(segments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marks of segments whose anchors are whole in one shard."""

    def run(batches):
        for held in _shards(batches, shard_bytes, False):
            hits, _ = repeated_windows([s for *_, s in held], [w for _, _, w, _ in held], length)
            yield _marks([(a, g, _runs(r)) for (a, g, *_), r in zip(held, hits) if len(r)])

    rows = segments.select("anchor", "seg", "width", "bytes").repartition("anchor").sortWithinPartitions("anchor", "seg")
    return rows.mapInArrow(run, _MARKS)


def _merged_marks(segments: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marks of segments of an anchor that lies over many shards. A shard marks what repeats within it and sends a digest
    of one window of each class to a range of digests, where it is looked up by binary search."""
    kind = "anchor long, seg long, runs array<int>, d1 long, d2 long, at int"

    def shards(batches):
        for held in _shards(batches, shard_bytes, True):
            hits, firsts = repeated_windows([s for *_, s in held], [w for _, _, w, _ in held], length)
            rows = [(a, g, _runs(r), None, None, None) for (a, g, *_), r in zip(held, hits) if len(r)]
            for (a, g, _, s), r in zip(held, firsts):
                for k in r.tolist():
                    d = xxhash.xxh3_128_intdigest(s[k : k + length])
                    rows.append((a, g, None, _signed(d >> 64), _signed(d & (1 << 64) - 1), k))
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32()))], names=["anchor", "seg", "runs", "d1", "d2", "at"])

    spread = segments.select("anchor", "seg", "width", "bytes").repartition("anchor", "seg").mapInArrow(shards, kind)
    spread = materialize(spread, "hot-shards")
    digests = spread.where("at is not null")
    ranges = max(1, -(-digests.count() // RANGE_ROWS))

    def search(batches):
        parts = list(batches)  # one range: about RANGE_ROWS digests, a digest once a shard
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        d1, d2 = (rows.column(c).to_numpy() for c in ("d1", "d2"))
        both = np.empty(len(d1), [("d1", np.int64), ("d2", np.int64)])
        both["d1"], both["d2"] = d1, d2
        ordered = np.sort(both)
        found = np.searchsorted(ordered, both, "right") - np.searchsorted(ordered, both, "left") > 1
        a, g, at = (rows.column(c).to_numpy()[found].tolist() for c in ("anchor", "seg", "at"))
        yield _marks([(x, y, [z, z + 1]) for x, y, z in zip(a, g, at)])

    across = digests.select("anchor", "seg", "d1", "d2", "at").repartitionByRange(ranges, "d1").mapInArrow(search, _MARKS)
    return spread.where("runs is not null").select("anchor", "seg", "runs").union(across)


def document_marks(rows: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, th, marks) of the texts with repeats; marks: structs of (starts, runs of windows after each start)."""
    seen = materialize(occurrences(rows, length), "anchors")
    counts = seen.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("anchor")
    again = materialize(seen.join(materialize(counts, "repeated-anchors"), "anchor", "left_semi"), "anchor-places")
    place = lambda k: F.struct("doc_id", "th", F.element_at("starts", k).alias("start"))
    kinds = again.groupBy("anchor", "seg", "width").agg(F.sum(F.size("starts")).alias("n"), F.min(place(1)).alias("first"), F.max(place(-1)).alias("last"))
    kinds = materialize(kinds, "segments")
    per = materialize(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")), "anchor-kinds")
    places = F.explode(F.when(F.col("n") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("p")
    cuts = kinds.join(per, "anchor").select("anchor", "seg", "width", "kinds", places)
    asked = cuts.groupBy(F.col("p.doc_id").alias("d"), F.col("p.th").alias("t")).agg(F.collect_list(F.struct("anchor", "seg", "width", F.col("p.start").alias("start"), "kinds")).alias("cuts"))
    asked = materialize(asked, "segments-asked")
    near = rows.where(bitmap_test(asked, "t")(F.col("th"))).dropDuplicates(["doc_id", "th"])
    texts = near.join(asked, F.expr("th = t and doc_id <=> d")).select("text", "cuts")

    def cut(batches):
        for batch in slices(batches, ROWS):
            for text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                cols = zip(*((c["anchor"], c["seg"], c["width"], c["kinds"], raw[c["start"] : c["start"] + c["width"] + length - 1]) for c in cuts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["anchor", "seg", "width", "kinds", "bytes"])

    segments = materialize(texts.mapInArrow(cut, "anchor long, seg long, width int, kinds long, bytes binary"), "segment-bytes")
    parts = _shard_marks(segments.where(F.col("kinds") <= hot_segments), length, shard_bytes)
    hot = segments.where(F.col("kinds") > hot_segments)
    if not hot.isEmpty():
        parts = parts.union(_merged_marks(hot, length, shard_bytes))
    # A segment may be marked from two of its places or shards: their runs are put together.
    marks = materialize(parts.groupBy("anchor", "seg").agg(F.flatten(F.collect_set("runs")).alias("runs")), "window-marks")
    found = again.select("doc_id", "th", "anchor", "seg", "starts").join(marks, ["anchor", "seg"])
    return found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("starts", "runs")).alias("marks"))


def byte_spans(marks: list | None, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal half-open byte runs covered by the marked windows."""
    spans = sorted((s + a, s + b - 1 + length) for m in marks or () for s in m["starts"] for a, b in zip(m["runs"][::2], m["runs"][1::2]))
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot_segments: int = HOT_SEGMENTS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) for every row.

    Null text counts as empty; texts under `length` bytes keep everything. Repeated rows are copies of each other, so
    all of their windows repeat. A null doc_id is a document like any other. kept_text drops the bytes of characters
    that a cut splits. An empty table gives an empty result; other columns are not read.
    """
    rows = text_rows(docs).withColumn("th", F.xxhash64("text"))
    marks = materialize(document_marks(rows, length, shard_bytes, hot_segments).withColumnsRenamed({"doc_id": "d", "th": "t"}), "document-marks")
    kind = "array<struct<starts: array<int>, runs: array<int>>>"
    touched = bitmap_test(marks, "t")(F.col("th"))
    joined = rows.where(touched).join(marks, F.expr("th = t and doc_id <=> d"), "left").select("doc_id", "text", F.col("marks").cast(kind))
    plain = rows.where(~touched).select("doc_id", "text", F.lit(None).cast(kind).alias("marks"))

    def run(batches):
        for batch in slices(batches, ROWS):
            cols: list[list] = [[] for _ in range(5)]
            for doc, text, m in zip(*(c.to_pylist() for c in batch.columns)):
                raw, spans = text.encode(), byte_spans(m, length)
                digest, at, kept = hashlib.sha256(), 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                for k in kept:
                    digest.update(k)
                values = [len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest()]
                for c, v in zip(cols, [*values, b"".join(kept).decode(errors="ignore") if with_text else None]):
                    c.append(v)
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    out = joined.union(plain).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")
