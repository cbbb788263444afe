"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's shingles are its runs of nine characters at every position (a shorter line is one shingle), so an inserted
character changes only the runs that hold it. Signatures are minima of the 64-bit shingle hashes under XOR permutations;
a band is four of them, and every minimum serves two bands. Lines that agree in a band are candidates; their exact Jaccard
similarity of shingle sets decides. A pair is compared only if its sizes and parity bitmaps allow the similarity: a bit
holds the parity of the number of shingles with that hash remainder, so the bitmaps of two lines differ in at most as many
bits as their sets differ in shingles, and no similar pair is lost. Within a band's bucket each line is compared with the
line that occurs most often; buckets whose lines then still lie in different components are finished by comparing across
those components only, so that no link among candidates is lost and copies of one line never meet in all pairs. Components
come from distributed star rounds, and the first line of each (least doc_id, then line number) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_test, materialize, nested, text_rows
from .components import components

SHINGLE = 9
#: Neighbouring places whose hashes are folded before they meet the minima.
FOLD = 8
BANDS = 10
SIMILARITY = 0.8
#: 64-bit words of a parity bitmap.
PARITY = 8


def _seeds(n: int) -> list[int]:
    """Well spread 64-bit constants (splitmix64 of 1..n), as signed longs."""
    out, mask = [], (1 << 64) - 1
    for i in range(1, n + 1):
        z = i * 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        out.append(z - (1 << 64) if z >> 63 else z)
    return out


def _units(line: Column) -> Column:
    """The line in 16-bit units, in which every place is found at once."""
    return F.encode(F.coalesce(line, F.lit("")), "UTF-16BE")


def _last(units: Column) -> Column:
    """Place (1-based, in bytes) of the last shingle; a line shorter than a shingle has its whole self there."""
    return F.greatest(F.lit(1), F.octet_length(units) - (2 * SHINGLE - 1))


def _hash(units: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(units, place, F.lit(2 * SHINGLE)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line) of every line, th: the text's hash; an empty text has one empty line."""
    rows = text_rows(docs).withColumn("th", F.xxhash64("text"))
    return rows.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _hashed(docs: DataFrame) -> DataFrame:
    """Lines with something besides white space, with the 128 bits (lk, lk2) that stand for their text."""
    return lines_of(docs).where(F.col("line").rlike(r"\S")).select("doc_id", "th", "line_no", "line", F.xxhash64("line").alias("lk"), F.xxhash64(F.lit(1), "line").alias("lk2"))


def band_rows(bands: int) -> list[list[int]]:
    """The four minima of each band; every minimum is in two bands (edges and vertices of a circulant graph), so ten
    bands need twenty minima."""
    return [[b, (b - 1) % bands, bands + b, bands + (b - 3) % bands] for b in range(bands)]


def signatures(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(lk, lk2, doc, line, th, n, keys) of each distinct line: first place, number of occurrences, band keys."""
    distinct = _hashed(docs).groupBy("lk", "lk2").agg(F.first("line").alias("text"), F.min(F.struct("doc_id", "line_no", "th")).alias("first"), F.count(F.lit(1)).alias("n"))
    # The rows stay dealt by (lk, lk2), so the minima need no further shuffle.
    key = ["lk", "lk2", "doc", "line", "th", "n"]
    wide = distinct.select("lk", "lk2", F.col("first.doc_id").alias("doc"), F.col("first.line_no").alias("line"), F.col("first.th").alias("th"), "n", _units(F.col("text")).alias("u"))
    wide = wide.select(*key, "u", _last(F.col("u")).alias("last")).select("*", F.explode(F.sequence(F.lit(1), "last", F.lit(2 * FOLD))).alias("at"))
    places = [F.least(F.col("at") + 2 * k, F.col("last")) for k in range(FOLD)]  # a row for each FOLD places
    hashed = wide.select(*key, *(_hash(F.col("u"), at).alias(f"h{k}") for k, at in enumerate(places)))
    minima = [F.min(F.least(*(F.col(f"h{k}").bitwiseXOR(F.lit(c)) for k in range(FOLD)))).alias(f"m{i}") for i, c in enumerate(_seeds(2 * bands))]
    signed = hashed.groupBy(*key).agg(*minima)
    keys = [F.xxhash64(F.lit(b), *(F.col(f"m{i}") for i in rows)) for b, rows in enumerate(band_rows(bands))]
    return signed.select("lk", "lk2", "doc", "line", "th", "n", F.array(*keys).alias("keys"))


def _hashes(units: Column) -> Column:
    """Hashes of all shingles. The units are bound to a lambda variable, since a binary column is copied at each use."""
    of = lambda u: F.transform(F.sequence(F.lit(1), _last(u), F.lit(2)), lambda at: _hash(u, at))
    return F.element_at(F.transform(F.array(units), of), 1)


def _sketches(units: DataFrame) -> DataFrame:
    """(id, k, w): number of distinct shingles and the parity bitmap of the lines (id, u)."""
    each = units.select("id.lk", "id.lk2", F.explode(F.array_distinct(_hashes(F.col("u")))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("lk", "lk2", F.shiftright("h", 6).bitwiseAND(F.lit(PARITY - 1)).alias("word"), bit.alias("bit"))
    words = [F.bit_xor(F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(PARITY)]
    got = each.groupBy("lk", "lk2").agg(F.count(F.lit(1)).alias("k"), *words)
    return got.select(F.struct("lk", "lk2").alias("id"), "k", F.struct(*(f"w{i}" for i in range(PARITY))).alias("w"))


def _could(a: str, b: str, similarity: float) -> Column:
    """Whether sizes and parity bitmaps of two lines allow the similarity; a and b: columns with fields k and w."""
    ka, kb = F.col(f"{a}.k"), F.col(f"{b}.k")
    apart = sum((F.bit_count(F.col(f"{a}.w.w{i}").bitwiseXOR(F.col(f"{b}.w.w{i}"))) for i in range(PARITY)), F.lit(0))
    most = (1 - similarity) / (1 + similarity) + 1e-9  # of |a| + |b|, by which sets of that similarity may differ
    return (F.least(ka, kb) >= F.lit(similarity) * F.greatest(ka, kb)) & (apart <= F.lit(most) * (ka + kb))


def _verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, k: sum of their sizes) whose exact Jaccard similarity is high enough; the sets are never stored."""
    x = units.select(F.col("id").alias("a"), F.col("u").alias("ua"))
    y = units.select(F.col("id").alias("b"), F.col("u").alias("ub"))
    both = F.size(F.array_intersect(_hashes(F.col("ua")), _hashes(F.col("ub"))))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "k", both.alias("both"))
    return met.where(F.col("both") >= F.lit(similarity) * (F.col("k") - F.col("both"))).select("a", "b")


def _pair(a: str, b: str) -> list[Column]:
    x, y = F.col(f"{a}.id"), F.col(f"{b}.id")
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), (F.col(f"{a}.k") + F.col(f"{b}.k")).alias("k")]


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, line) of the wanted lines (id, doc, hash, line_no), each read at its first place."""
    places = text_rows(docs).withColumn("th", F.xxhash64("text")).where(bitmap_test(wanted, "hash")(F.col("th")))
    lines = places.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    same = F.expr("hash = th and line_no = no and doc <=> doc_id")
    return lines.join(wanted, same).select("id", "line").dropDuplicates(["id"])


def _first_met(a: str, b: str, bands: int) -> Column:
    """Whether `key` is the first band key that two lines share; a and b: columns with a field keys."""
    first = F.lit(None).cast("long")
    for i in reversed(range(bands)):
        first = F.when(F.col(f"{a}.keys")[i] == F.col(f"{b}.keys")[i], F.col(f"{a}.keys")[i]).otherwise(first)
    return first == F.col("key")


def line_components(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """(node, component) of the distinct lines that have similar ones; nodes are structs (lk, lk2)."""
    keyed = signed.select(F.explode("keys").alias("key"), "lk", "lk2", "n", "keys", F.struct("doc", "th", "line").alias("at"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "band-keys")
    hit = keyed.where(bitmap_test(shared, "key")(F.col("key"))).join(shared, "key", "left_semi")
    hit = materialize(hit.select("key", F.struct("lk", "lk2").alias("id"), "n", "keys", "at"), "band-members")
    wanted = hit.select("id", F.col("at.doc").alias("doc"), F.col("at.th").alias("hash"), F.col("at.line").alias("line_no")).distinct()
    wanted = materialize(wanted, "line-candidates")
    near = _texts_of(docs, wanted)
    units = materialize(near.select("id", _units(F.col("line")).alias("u")), "line-units")
    sketches = materialize(_sketches(units), "line-sketches")
    members = materialize(hit.join(sketches, "id").select("key", "n", F.struct("id", "k", "w", "keys").alias("x")), "band-lines")
    # The line that occurs most is likely the one that the others are edits of.
    pivots = materialize(members.groupBy("key").agg(F.max(F.struct("n", "x")).alias("top")).select("key", F.col("top.x").alias("p")), "band-pivots")
    pairs = members.join(pivots, "key").where((F.col("x.id") != F.col("p.id")) & _could("x", "p", similarity)).select(*_pair("x", "p"))
    links = materialize(_verified(materialize(pairs.distinct(), "line-pairs"), units, similarity), "line-links")
    comp = components(links)
    # Buckets that still hold lines of different components: compare across them, from all but the largest component.
    placed = members.join(comp, F.col("x.id") == comp["node"], "left").select("key", "x", F.coalesce("component", "x.id").alias("c"))
    placed = materialize(placed, "band-components")
    kinds = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "c")).alias("top"))
    mixed = materialize(kinds.where("kinds > 1").select("key", F.col("top.c").alias("top")).join(pivots.select("key", F.col("p.id").alias("pivot")), "key"), "mixed-buckets")
    inside = materialize(placed.join(mixed, "key").where("x.id <> pivot").select("key", "x", "c", (F.col("c") != F.col("top")).alias("stray")), "mixed-lines")
    strays = inside.where("stray").select("key", F.col("x").alias("y"), F.col("c").alias("cy"))
    met = strays.join(inside, "key").where((F.col("c") != F.col("cy")) & _could("x", "y", similarity) & _first_met("x", "y", bands) & (~F.col("stray") | (F.col("x.id") < F.col("y.id"))))
    more = materialize(_verified(materialize(met.select(*_pair("x", "y")).distinct(), "line-pairs"), units, similarity), "line-links")
    return comp if more.isEmpty() else components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def line_groups(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """doc_id, line_no, keep_doc_id, keep_line_no, kept for every line of every row of docs.

    A line is kept if it is the first (least doc_id, then line number, then text hash) of its component; equal lines are
    one. Lines of white space only are all kept. Null text counts as empty (one empty line); null doc_ids come before
    others; equal rows are one place, so their lines are kept or dropped together. An empty table gives an empty result.
    Columns other than doc_id and text are not read.
    """
    return _places(docs, similarity, bands).drop("th")


def _places(docs: DataFrame, similarity: float, bands: int = BANDS) -> DataFrame:
    """The rows of line_groups with the hash of the text that each line is in."""
    signed = materialize(signatures(docs, bands), "line-signatures")
    comp = line_components(docs, signed, similarity, bands).select(F.col("node.lk").alias("lk"), F.col("node.lk2").alias("lk2"), "component")
    comp = materialize(comp, "line-components")
    grouped = signed.where(bitmap_test(comp, "lk")(F.col("lk"))).join(comp, ["lk", "lk2"])
    place = F.struct("doc", "line", F.col("th").alias("hash"))
    firsts = grouped.groupBy("component").agg(F.min(place).alias("keep"))
    fuzzy = grouped.join(materialize(firsts, "line-firsts"), "component").select("lk", "lk2", "keep")
    copies = signed.where("n > 1").join(comp, ["lk", "lk2"], "left_anti").select("lk", "lk2", place.alias("keep"))
    keeps = materialize(fuzzy.union(copies), "line-keeps")
    own = F.struct(F.col("doc_id").alias("doc"), F.col("line_no").alias("line"), F.col("th").alias("hash"))
    places = lines_of(docs).select("doc_id", "th", "line_no", "line", F.when(F.col("line").rlike(r"\S"), F.xxhash64("line")).alias("lk"))
    met = F.when(bitmap_test(keeps, "lk")(F.col("lk")), F.col("lk"))
    places = places.select("doc_id", "th", "line_no", "line", met.alias("lk"))
    places = materialize(places.select("doc_id", "th", "line_no", "lk", F.when(F.col("lk").isNotNull(), F.xxhash64(F.lit(1), "line")).alias("lk2")), "line-places")
    found = places.where("lk is not null").join(keeps, ["lk", "lk2"], "left").select("doc_id", "th", "line_no", F.coalesce("keep", own).alias("keep"))
    alone = places.where("lk is null").select("doc_id", "th", "line_no", own.alias("keep"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep.doc")) & (F.col("line_no") == F.col("keep.line")) & (F.col("th") == F.col("keep.hash"))
    return found.union(alone).select("doc_id", "th", "line_no", F.col("keep.doc").alias("keep_doc_id"), F.col("keep.line").alias("keep_line_no"), kept.alias("kept"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with all its columns, its text without the lines that line_groups drops (null stays null).

    Rows are named by (doc_id, text hash), so different texts under one id lose only their own lines, and no column name
    can clash. A row whose lines all go keeps an empty text. An empty table gives an empty result.
    """
    gone = _places(docs, similarity).where("not kept").groupBy(F.col("doc_id").alias("id"), F.col("th").alias("hash")).agg(F.collect_set("line_no").alias("gone"))
    out = nested(docs).join(gone, F.expr("id <=> doc_id and hash = th"), "left")
    text = F.array_join(F.filter(F.split("text", "\n", -1), lambda _l, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)
    return out.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
