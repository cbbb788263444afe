"""SimHash near-dedup with fuzzy Golay-code keys.

Fingerprints of 64 bits are cut into segments A (23 bits), B (23), C (9) and D (9). The perfect binary Golay code maps a
23-bit segment to the codewords near it: the decodings of the words within one flip of the segment are one or six
codewords, and two segments that differ in two bits or fewer share at least one of them (the decoding of a word between
them). With three differing bits or fewer in all, the pigeonhole principle leaves one of these cases, each with a key of
33 bits or more that both fingerprints emit:
  A and B equal; A equal and B near (<= 2); B equal and A near; A, C and D equal; B, C and D equal;
  A and B both near, and C equal, or D equal (A and B both differ, so C and D share one differing bit at most).
Fingerprints that share a key are compared by their exact Hamming distance. Only keys that two fingerprints share go on;
a key with many members is compared in blocks of bounded size, and each comparison returns a spanning forest of its
links instead of all pairs, which keeps the components whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, nested, text_rows
from .components import components

BITS = 3
SHINGLE = 3
BLOCK = 2048
SMALL_KEYS = 100_000
#: Fingerprints whose keys one task makes.
KEYED = 16_384
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GENERATOR = 0b101011100011


def fingerprint(text: str) -> int:
    """64-bit SimHash of a text: A-Z in lower case, words between ASCII white space, shingles of three words with
    repeats (fewer words: the whole sequence; none: 0), XXH64 with seed 42; a bit is 1 if set in over half the hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, n) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: n - SHINGLE + 1].tolist()
        stops = (ends - 1)[SHINGLE - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


class Golay:
    """Decoding of 23-bit words to 12-bit codeword indices by syndromes."""

    def __init__(self):
        self.unit = np.array([self._remainder(1 << j) for j in range(23)], np.int64)
        bytes_ = np.arange(256)
        self.parts = [np.zeros(256, np.int64) for _ in range(3)]
        for k in range(3):
            for j in range(8):
                if 8 * k + j < 23:
                    self.parts[k] ^= np.where(bytes_ >> j & 1, self.unit[8 * k + j], 0)
        self.error = np.zeros(2048, np.int64)
        flips = [0] + [1 << a for a in range(23)]
        flips += [1 << a | 1 << b for a in range(23) for b in range(a)]
        flips += [1 << a | 1 << b | 1 << c for a in range(23) for b in range(a) for c in range(b)]
        flips = np.array(flips, np.int64)
        self.error[self.syndrome(flips)] = flips  # a perfect code: each syndrome has exactly one such error

    @staticmethod
    def _remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GENERATOR << shift
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16 & 255]

    def near(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of the codewords near each word; repeated entries are -1."""
        syndromes = self.syndrome(words)[:, None] ^ np.concatenate([[0], self.unit])
        flipped = words[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])
        codes = np.sort((flipped ^ self.error[syndromes]) >> 11, axis=1)
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        out = np.full((len(words), 6), -1, np.int64)
        rank = np.cumsum(first, axis=1) - 1
        r, c = np.nonzero(first)
        out[r, rank[r, c]] = codes[r, c]
        return out


_GOLAY: list[Golay] = []


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, key) of all keys of an array of int64 fingerprints."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    u = fps.view(np.uint64)
    a, b = ((u >> np.uint64(s) & np.uint64((1 << 23) - 1)).astype(np.int64) for s in (0, 23))
    c, d = ((u >> np.uint64(s) & np.uint64(511)).astype(np.int64) for s in (46, 55))
    near_a, near_b = _GOLAY[0].near(a), _GOLAY[0].near(b)
    at, keys, own = [], [], np.arange(len(u))

    def add(kind, rows, bits):
        at.append(rows), keys.append(np.int64(kind) << 50 | bits)

    add(0, own, a << 23 | b)
    add(1, own, a << 18 | c << 9 | d)
    add(2, own, b << 18 | c << 9 | d)
    for kind, whole, near in ((3, a, near_b), (4, b, near_a)):
        r, k = np.nonzero(near >= 0)
        add(kind, r, whole[r] << 12 | near[r, k])
    both = (near_a[:, :, None] << 12 | near_b[:, None, :]).reshape(len(u), -1)
    both[((near_a < 0)[:, :, None] | (near_b < 0)[:, None, :]).reshape(len(u), -1)] = -1
    r, k = np.nonzero(both >= 0)
    for kind, rest in ((5, c), (6, d)):
        add(kind, r, both[r, k] << 9 | rest[r])
    return np.concatenate(at), np.concatenate(keys)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within BITS of each other (n - 1 links at most)."""
    todo, links = np.unique(fps.view(np.uint64)), []
    while len(todo) > 1:
        front, todo = todo[:1], todo[1:]
        while len(front) and len(todo):
            x, front = front[0], front[1:]
            hit = np.bitwise_count(todo ^ x) <= BITS
            if hit.any():
                links += [(int(x), int(y)) for y in todo[hit]]
                front, todo = np.concatenate([front, todo[hit]]), todo[~hit]
    return links


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp) for every row; fp is the fingerprint's 64 bits as a signed long, th the text's hash."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps)], names=["doc_id", "th", "fp"])

    return text_rows(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, keys = golay_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, block: int = BLOCK, small_keys: int = SMALL_KEYS) -> DataFrame:
    """(a, b): links between distinct fingerprints that join up all pairs within BITS, directly or through others."""
    distinct = distinct.repartition(max(1, -(-distinct.count() // KEYED)), "fp")  # some 70 keys each: small tasks
    shared = materialize(_keyed(distinct).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-keys")
    few = shared.count() <= small_keys  # the check of the broadcast's size; beyond it the join shuffles and AQE splits hot keys
    members = _keyed(distinct).join(F.broadcast(shared) if few else shared, "key")
    # A key with up to `block` members is one cell; a larger one is cut into blocks by a hash, a cell for each two blocks.
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    cells = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    sets = cells.groupBy("key", "i", "j").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            out = [x for fps in batch.column(0) for x in forest(fps.values.to_numpy())]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return sets.select("fps").mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, block: int = BLOCK, small_keys: int = SMALL_KEYS) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row.

    Null text counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows and
    ids give a row each; a null doc_id stays null and never names a component unless it is alone. An empty table gives
    an empty result. Columns other than doc_id and text are not read.
    """
    return _components(docs, block, small_keys).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(docs: DataFrame, block: int = BLOCK, small_keys: int = SMALL_KEYS) -> DataFrame:
    """(doc_id, th, fp, component_id, component) for every row; component is a fingerprint of the component."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    comp = components(links(distinct, block, small_keys))
    labelled = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialize(labelled.join(names, "component").select("fp", "component_id", "component"), "fingerprint-components")
    return rows.join(of, "fp").select("doc_id", "th", "fp", "component_id", "component")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, with all its columns: the one with the smallest doc_id (null ids last, repeats
    of an id by the smallest text hash; equal rows stay once).

    Null texts count as empty; texts without words are one component. An empty table gives an empty result. Rows are
    named by (doc_id, text hash), so different texts under one id are different rows, and no column name can clash.
    """
    placed = _components(docs).groupBy("component", F.col("doc_id").alias("id"), F.col("th").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "hash", "n")).alias("first")
    kept = materialize(placed.groupBy("component").agg(first).select("first.id", "first.hash", "first.n"), "kept-rows")
    rows, same = nested(docs), F.expr("id <=> doc_id and hash = th")
    once = rows.join(kept.where("n = 1"), same, "left_semi").select("row.*")
    if kept.where("n > 1").isEmpty():
        return once  # no equal rows among them, so the texts move once
    repeated = rows.join(kept.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "th"])
    return once.union(repeated.select("row.*"))
