"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Terms are hashed byte trigrams (log counts, inverse document frequency over all documents) and a few shape terms
(repeated neighbouring words, capitals, punctuation, distinct words, length). The latent space is the leading
eigenvectors of the labelled sample's Gram matrix. Labelled vectors are broadcast (their number is bounded by
max_labelled); each batch of documents is compared with all of them in one blocked product, and the nearest
neighbours' labels are averaged with weights of a power of their cosine.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_rows

TERMS = 2048
MAX_LABELLED = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
POWER = 16
SHAPE_WEIGHT = 0.5
THRESHOLD = 0.7
_SHARES = np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_EDGES = (_SHARES, _SHARES, _SHARES, np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8]), np.array([1, 5, 20, 60, 200, 1000]))
SHAPES = sum(len(e) + 1 for e in _EDGES)


def term_counts(raw: bytes) -> np.ndarray:
    """Counts of hashed byte trigrams."""
    out = np.zeros(TERMS, np.int64)
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(len(data) - 2, 0), 1 << 20):
        b = data[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(2246822519)) ^ (b[2:] * np.uint32(3266489917))
        out += np.bincount((h * np.uint32(668265263)) >> np.uint32(21), minlength=TERMS)
    return out


def shape_terms(text: str, raw: bytes) -> np.ndarray:
    """Thermometer-coded shape terms, scaled to at most SHAPE_WEIGHT a group."""
    words, data = text.split(), np.frombuffer(raw, np.uint8)
    kinds = np.bincount(data, minlength=256)[:128] if len(data) else np.zeros(128)
    size, n = max(1, len(data)), len(words)
    marks = kinds[33:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    values = (sum(map(operator.eq, words, words[1:])) / max(1, n - 1), kinds[65:91].sum() / size, marks / size, len(set(words)) / max(1, n), n)
    parts = []
    for v, edges in zip(values, _EDGES):
        k = int(np.searchsorted(edges, v))
        parts.append((np.arange(len(edges) + 1) >= k) * (SHAPE_WEIGHT / np.sqrt(len(edges) + 1)))
    return np.concatenate(parts).astype(np.float32)


def vectors(counts: np.ndarray, shapes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    z = np.log1p(counts.astype(np.float32)) * idf
    z /= np.maximum(1e-9, np.linalg.norm(z, axis=1, keepdims=True))
    return np.concatenate([z, shapes], axis=1)


def _unit(y: np.ndarray) -> np.ndarray:
    return y / np.maximum(1e-9, np.linalg.norm(y, axis=1, keepdims=True))


@dataclass
class QualityModel:
    idf: np.ndarray
    basis: np.ndarray
    labelled: np.ndarray
    labels: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        """Exact blocked cosine products against all labelled vectors; scores of 0.5 if there are none. All vectors as
        near as the last of the NEIGHBOURS nearest vote, so ties have no order."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        raws = [t.encode() for t in texts]
        z = vectors(np.stack([term_counts(r) for r in raws]), np.stack([shape_terms(t, r) for t, r in zip(texts, raws)]), self.idf)
        sims = _unit(z @ self.basis) @ self.labelled.T
        k = min(NEIGHBOURS, len(self.labels))
        last = np.partition(sims, -k, axis=1)[:, -k]
        row, near = np.nonzero(sims >= last[:, None])
        weights = np.maximum(sims[row, near].astype(np.float64), 1e-3) ** POWER
        n = len(texts)
        return np.clip(np.bincount(row, weights * self.labels[near], n) / np.bincount(row, weights, n), 0.0, 1.0)


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2: such rows never teach."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Document frequencies over all documents; labels from at most max_labelled rows (smallest hash of the id first).

    Labels of one id are averaged; null ids and null qualities are left out; a labelled id with several texts teaches
    the one with the smallest hash. lang, source and doc_id are not features.
    """
    taught = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    taught = taught.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("label"))
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def run(batches):
        seen, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            ids, out, tags, hashes = [], [], [], []
            for doc, text, label, h in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                counts = term_counts(raw)
                seen += counts > 0
                n += 1
                if label is not None:
                    ids.append(doc), tags.append(label), hashes.append(h)
                    out.append(np.minimum(counts, 65535).astype("<u2").tobytes() + shape_terms(text, raw).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.float64()), pa.array(hashes, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(ids), pa.list_(pa.int64()))], names=["doc_id", "label", "h", "features", "seen"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([[n, *seen.tolist()]], pa.list_(pa.int64()))], names=["doc_id", "label", "h", "features", "seen"])

    rows = text_rows(docs).join(F.broadcast(chosen), "doc_id", "left").select("doc_id", "text", "label", F.xxhash64("text").alias("h"))
    stats = materialize(rows.mapInArrow(run, "doc_id long, label double, h long, features binary, seen array<long>"), "quality-terms")
    sums = {r.pos: r.n for r in stats.where("seen is not null").select(F.posexplode("seen")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    n, seen = sums.get(0, 0), np.array([sums.get(i + 1, 0) for i in range(TERMS)], np.float64)
    idf = (np.log((1 + n) / (1 + seen)) + 0.1).astype(np.float32)
    sample = stats.where("features is not null").groupBy("doc_id").agg(F.min(F.struct("h", "label", "features")).alias("s"))
    got = sample.select("doc_id", "s.label", "s.features").orderBy("doc_id").collect()  # at most max_labelled rows
    if not got:
        return QualityModel(idf, np.zeros((TERMS + SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.stack([np.frombuffer(r.features, "<u2", TERMS) for r in got])
    shapes = np.stack([np.frombuffer(r.features, "<f4", SHAPES, 2 * TERMS) for r in got])
    z = vectors(counts, shapes, idf)
    basis = np.linalg.eigh(z.T @ z)[1][:, -min(DIMENSIONS, len(got)) :].astype(np.float32)
    return QualityModel(idf, basis, _unit(z @ basis), np.array([r.label for r in got]))


def with_scores(rows: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, text, score) of the rows (doc_id, text). Null text counts as empty."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by max_labelled and TERMS

    def run(batches):
        for part in slices(batches, 256):
            scores = shared.value.score([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=["doc_id", "text", "score"])

    return rows.mapInArrow(run, "doc_id long, text string, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null text counts as empty and is scored by its shape terms; repeated rows and ids give a row each; without any
    labelled row all scores are 0.5. An empty table gives an empty result. Extra columns are not read.
    """
    rows = text_rows(docs)
    scored = with_scores(rows, fit(rows, labels, max_labelled))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that score at least THRESHOLD, with all their columns, whatever their names.

    Rows are scored one by one, so repeated or null ids and repeated rows don't matter; null texts count as empty.
    Without any labelled row all scores are 0.5 and nothing stays. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_labelled))  # bounded by max_labelled and TERMS
    at = docs.columns.index("text")

    def run(batches):
        for part in slices(batches, 256):
            scores = shared.value.score([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array([s >= THRESHOLD for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
