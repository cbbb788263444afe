"""Shared helpers: input checks, scratch tables in the cluster's shared folder, tokenizer paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir; an own folder only in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_file(path: str) -> str:
    """path itself if it exists where the task runs, else the public vocabulary file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as the empty string; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def nested(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, th): the rows of docs as structs, so that no column of theirs can clash with another name, with
    their id and text (null: empty) and the text's hash."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def slices(batches, rows: int):
    """Arrow batches in slices of at most so many rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


BITMAP_BITS = 22


def bitmap_test(keys: DataFrame, key: str):
    """A test `hash column -> boolean` that is true for every value of keys[key] (and for some others).

    The bitmap has 2^22 bits whatever the number of keys, so what the tasks get is bounded (65,536 longs, as the result of
    a scalar subquery); many keys only make it let more rows through. key is a long that is already a hash.
    """
    slot = lambda c: F.pmod(c, F.lit(1 << BITMAP_BITS))
    words = keys.select(slot(F.col(key)).alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("b"))
    dense = keys.sparkSession.range(1 << (BITMAP_BITS - 6)).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    table = materialize(dense.agg(F.array_sort(F.collect_list(F.struct("id", "b"))).alias("t")).select(F.transform("t", lambda x: x["b"]).alias("t")), "bitmap")

    def test(col):
        s = slot(col)
        word = F.element_at(table.scalar(), (F.floor(s / 64) + 1).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (s % 64).cast("int"))) != 0

    return test


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
