"""Tokenise documents and write the ids as Simple-8b segments; read them back.

The rows are range-partitioned by doc_id, so each task writes one shard of consecutive documents as a few segments of
whole documents. A dataset is a Parquet folder with one row per segment: shard, segment, shard_start (ids of the shard
before it), doc_ids, lengths and the Simple-8b payload. The start of a document in the whole corpus is the sum of the
shards before it (one number a shard), plus shard_start, plus the lengths before it in its segment.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simple8b
from .common import byte_letters, scratch_path, text_rows, tokenizer_file

SEGMENT_IDS = 1 << 20
CACHE = 700_000
SEGMENTS = "shard int, segment int, shard_start long, doc_ids array<long>, lengths array<long>, payload binary"


class _Words(dict):
    """Ids (uint32 bytes) of words; a word that isn't there yet is encoded when it is first looked up."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = self.encode(word)
        return got


class WordEncoder:
    """Ids of a text through the tokenizers library, with each distinct word between ASCII white space encoded once.

    The vocabulary drops white space and lower-cases, so words encode independently and in lower case; that is checked
    when the file is loaded. Words of Latin letters, with at most one full stop or comma after them, are pieces of the
    splitting pattern as they stand and go to the library's merge model directly; all others go through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        if self._whole("a b") != self._whole("a") + self._whole("b") or self._whole("Ab\tB.") != self._whole("ab b ."):
            raise ValueError("this tokenizer keeps white space or case; words can't be encoded one by one")
        if [t.id for t in self.tok.model.tokenize("thereof")] != self._whole("thereof"):
            raise ValueError("this tokenizer's merge model can't be used on single words")
        self.words = _Words(self._word)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _plain(word: str) -> bool:
        return word.isalpha() and max(word) < "\u0250" and "\u0130" not in word

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self._plain(word):
            ids = [t.id for t in self.tok.model.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))]
        elif word[-1] in ".," and self._plain(word[:-1]):
            return self.words[raw[:-1]] + self.words[raw[-1:]]
        else:
            ids = self._whole(word)
        return array("I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE:
            self.words.clear()
        get, out = self.words.__getitem__, []
        for text in texts:
            raw = text.encode()
            words = (raw if b"<|" in raw else raw.lower()).split()  # special strings count only in their own case
            out.append(np.frombuffer(b"".join(map(get, words)), np.uint32))
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    path = tokenizer_file(path)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Write every document's ids, each document ended by end_id, in ascending doc_id order.

    Null text counts as empty (only end_id). Rows that repeat a doc_id follow each other in the order of a hash of
    their text. Null doc_ids come first. An empty table writes a dataset without segments.
    """

    def run(batches):
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        tail, segment, start = np.array([end_id], np.uint32), 0, 0
        ids, lens, parts, held = [], [], [], 0

        def flush():
            nonlocal segment, start, ids, lens, parts, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([simple8b.encode(np.concatenate(parts))], pa.binary())],
                names=["shard", "segment", "shard_start", "doc_ids", "lengths", "payload"],
            )
            segment, start, ids, lens, parts, held = segment + 1, start + held, [], [], [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, got in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids.append(doc), lens.append(len(got) + 1), parts.extend((got, tail))
                    held += len(got) + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
        if ids:
            yield flush()

    rows = text_rows(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, if asked for) of every document of a dataset, decoded from it."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(row["payload"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], np.int64))
                starts = ends - row["lengths"]
                parts = [ids[a:b] for a, b in zip(starts, ends)]
                cols = [pa.array([row["shard"]] * len(parts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["shard_start"], pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                names = ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    stored = spark.read.schema(SEGMENTS).parquet(path)
    totals = stored.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # One row a shard (a write task), so the running sum and the broadcast are as small as the task list.
    bases = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    extra = ", ids array<long>" if with_ids else ""
    docs = stored.mapInArrow(run, f"shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long{extra}")
    return docs.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_output(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of docs (to path, or a new shared scratch folder) and return read_tokens of what was written."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return read_tokens(spark, path)
