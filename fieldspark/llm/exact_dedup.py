"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut at places that its own content fixes (after punctuation and a space, between 512 and
4,096 characters), so equal texts have equal chunk lists. Chunks get 64-bit identifiers that are verified: the
distinct chunks are grouped with their hash, and hashes shared by different chunks (normally none) are told apart by
a rank. Texts are then compared by their ordered identifier lists, so a long text moves at most once, as chunks that
were already combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, nested

CHUNKS = r"(?s).{512,4096}?(?:(?<=[.,;:!?] )|\z)|.{1,4096}"


def normalise(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; only runs that aren't one space already are rewritten."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _hash(chunk: Column, hash_bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if hash_bits >= 64 else h.bitwiseAND(F.lit((1 << hash_bits) - 1).cast("long"))


def recipes(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_sha256, recipe) for every row; recipe is the ordered list of verified chunk identifiers.

    hash_bits below 64 is for tests of the collision path.
    """
    chunked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalise(F.col("text")).alias("norm"))
    chunks = F.regexp_extract_all("norm", F.lit(CHUNKS), F.lit(0))
    plain = materialize(
        chunked.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.transform(chunks, lambda c: _hash(c, hash_bits)).alias("recipe")), "recipes"
    )
    distinct = chunked.select(F.explode(chunks).alias("chunk")).select(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "chunk-clashes")
    if shared.isEmpty():
        return plain
    # Different chunks with one hash: number the texts of each such hash and rebuild the lists of the rows that use them.
    # The repeated-row key is the text's digest; the identifier of a clashing chunk is its (hash, rank), folded to a list.
    ranked = materialize(distinct.join(shared.select("h"), "h").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("rank")), "chunk-ranks")
    placed = chunked.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks).alias("pos", "chunk")).withColumn("h", _hash(F.col("chunk"), hash_bits)).distinct()
    placed = placed.join(ranked, ["h", "chunk"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    lists = placed.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "rank"))).alias("parts"))
    lists = lists.select("doc_id", "text_sha256", F.flatten(F.transform("parts", lambda p: F.array(p["h"], p["rank"].cast("long")))).alias("full"))
    return plain.alias("p").join(lists.alias("l"), F.expr("p.doc_id <=> l.doc_id and p.text_sha256 = l.text_sha256"), "left").select(
        "p.doc_id", "p.text_sha256", F.coalesce("l.full", "p.recipe").alias("recipe")
    )


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and empty texts are equal to each other. The smallest doc_id of a group stays; rows
    that repeat that doc_id with an equal text are reported as kept with it. A null doc_id is kept only in a group
    where every doc_id is null. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    rows = recipes(docs, hash_bits)
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shared = materialize(groups.where("group_size > 1"), "exact-groups")  # fresh partitions, so a hot group's join can be split
    return (
        rows.join(shared, "recipe", "left")
        .select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; rows that repeat an id and a normalised text stay once.

    Null texts count as empty. Rows are named by (doc_id, text digest), so different texts under one id are different
    rows, and no column name can clash. An empty table gives an empty result.
    """
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")).distinct()
    rows = nested(docs).withColumn("sha", F.sha2(normalise(F.col("text")), 256))
    return rows.join(kept, F.expr("id <=> doc_id and digest = sha"), "left_semi").dropDuplicates(["doc_id", "sha"]).select("row.*")
