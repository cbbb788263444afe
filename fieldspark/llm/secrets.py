"""Secret scans: fixed patterns plus character Markov models, in DataFrame functions only.

Two first-order Markov chains over the characters `+` to `z` are trained from labelled samples, one on random strings
and one on ordinary identifiers; both samples are made by rule, so what is found in a text doesn't depend on others. A run of 20
or more key characters, or such a part of it that lies outside the spans of fixed patterns, is reported if its
log-likelihood ratio (random against ordinary) is over the threshold. The table of log ratios (80 x 80 numbers) is a constant in the plan.
Positions are code points: the lengths of the matches and of the text between them, summed along each text.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nested, text_rows

#: The patterns of the three base kinds.
VALUE = r"[A-Za-z0-9+/_.=-]+"
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(""" + VALUE + ")"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 or more characters in all
HEX = r"[0-9a-f]{24,}"
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Fixed value: the form of UUIDs, which are names rather than secrets although their digits are random.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
LOW, SYMBOLS = 43, 80  # '+' .. 'z'
MIN_RATIO = 10.0  # total log-likelihood ratio, in nats
SAMPLE_NAMES = 6000
LEAST_RUN = 20
RANDOM_STRINGS = 3000
_BLOCK = 256


#: Words that the ordinary identifiers of the sample are made of.
ORDINARY = """
account action active address agent amount array asset async audio author average background backup balance batch before
block body border boundary branch browser buffer button cache calendar category channel character chart check child city
class client cluster code column command comment common company complete component config connection console container
content context control copy count country create current customer data database date default delete delivery description
device dialog directory display document domain download driver editor element email empty enable entry error event example
exception export factory feature field file filter final first folder font form format frame function gateway global graph
group handler header height helper history host image import index input install instance integer interface internal invoice
item journal keyboard label language last layout length level library license limit line link list listener local location
""".split()
#: Endings and beginnings that give other words of the kinds that prose in Latin letters has.
PARTS = "the and ing tion ment ous able ever with that this from une des les que pour ent eur eau ette der die das und ein ich keit ung schaft los las por con cion dad mente del est".split()


def labelled_samples(spark: SparkSession, names: int = SAMPLE_NAMES, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(sample, random) labelled strings, made by rule: digests in hexadecimal, base64 and capital letters as random
    strings; words joined as identifiers, paths and plain runs as ordinary ones."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    random = spark.range(random_strings).select(
        F.explode(F.array(F.substring(digest, 1, 40), F.translate(coded, "=", ""), F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(coded, "+/=", "")), 1, 16)))).alias("sample"), F.lit(1).alias("random")
    )
    words, parts = F.array(*map(F.lit, ORDINARY)), F.array(*map(F.lit, PARTS))
    pick = lambda k: F.element_at(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(ORDINARY))).cast("int") + 1)
    piece = lambda k: F.element_at(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int") + 1)
    made = F.concat(*(piece(k) for k in range(3, 6)))
    a, b, c = F.when(F.col("id") % 3 == 0, made).otherwise(pick(0)), pick(1), pick(2)
    forms = [F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c), F.concat(a, made, c), F.upper(F.concat_ws("_", a, b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("-", F.initcap(a), b, (F.col("id") % 100).cast("string"))]
    form = F.element_at(F.array(*forms), (F.col("id") % len(forms)).cast("int") + 1)
    return random.union(spark.range(names).select(form.alias("sample"), F.lit(0).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """SYMBOLS x SYMBOLS log ratios of transition probabilities (random over ordinary), from (sample, random) rows.

    Characters outside the alphabet are skipped; half a count is added to every transition. Null samples are skipped.
    """
    codes = F.transform(F.split(F.regexp_replace("sample", f"[^{chr(LOW)}-{chr(LOW + SYMBOLS - 1)}]", ""), ""), lambda c: F.ascii(c) - LOW)
    chars = samples.where("sample is not null").select("random", F.filter(codes, lambda c: c >= 0).alias("c")).where(F.size("c") > 1)
    steps = chars.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.element_at("c", i) * SYMBOLS + F.element_at("c", i + 1))).alias("step"))
    counts = {(r.random, r.step): r.n for r in steps.groupBy("random", "step").agg(F.count(F.lit(1)).alias("n")).collect()}  # 2 x 6,400 rows at most

    def logs(label: int) -> list[float]:
        out = []
        for a in range(SYMBOLS):
            row = [counts.get((label, a * SYMBOLS + b), 0) + 0.5 for b in range(SYMBOLS)]
            out += [math.log(x / sum(row)) for x in row]
        return out

    return [round(x - y, 6) for x, y in zip(logs(1), logs(0))]


def _sums(lengths: Column) -> Column:
    """Running sums before each element, by sums of blocks so that long lists stay cheap."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))

    def before(_x: Column, i: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        return F.aggregate(F.slice(blocks, F.lit(1), b), zero, add) + F.aggregate(F.slice(lengths, b * _BLOCK + 1, i - b * _BLOCK), zero, add)

    return F.transform(lengths, before)


def _long(text: Column) -> Column:
    return F.char_length(text).cast("long")


def _spans(rows: DataFrame, name: str, pattern: str, kind: int, on: str) -> DataFrame:
    """Adds `name`: (start, kind, end, match, value) of every match; value is the first group if the pattern has one."""
    none = F.array().cast("array<string>")
    group = 1 if "(" + VALUE in pattern else 0
    rows = rows.withColumns({"_m": F.when(F.col(on), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none), "_v": F.when(F.col(on), F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).otherwise(none)})
    rows = rows.withColumn("_g", F.when(F.size("_m") > 0, F.slice(F.split("text", pattern, -1), F.lit(1), F.size("_m"))).otherwise(none))
    rows = rows.withColumn("_step", F.zip_with("_g", "_m", lambda g, m: _long(g) + _long(m)))
    rows = rows.withColumn("_at", F.when(F.size("_m") > 0, F.zip_with(_sums(F.col("_step")), "_g", lambda s, g: s + _long(g))).otherwise(F.array().cast("array<bigint>")))
    made = F.transform("_at", lambda s, i: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + _long(F.element_at("_m", i + 1))).alias("end"), F.element_at("_m", i + 1).alias("match"), F.element_at("_v", i + 1).alias("value")))
    return rows.withColumn(name, made).drop("_m", "_v", "_g", "_step", "_at")


def _ratio(table: Column, token: Column) -> Column:
    codes = F.transform(F.slice(F.split(token, ""), F.lit(1), F.char_length(token)), lambda c: F.ascii(c) - LOW)
    return F.aggregate(codes, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.element_at(table, a["last"] * SYMBOLS + c + 1))).alias("sum")), lambda a: a["sum"])


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _found(rows: DataFrame, ratios: Column, min_ratio: float) -> DataFrame:
    """Adds base and markov, arrays of (start, kind, end), to rows that have a text column; its other columns stay."""
    own = rows.columns
    low = F.lower("text")
    hinted = low.contains(WORDS[0])
    for w in WORDS[1:]:
        hinted = hinted | low.contains(w)
    rows = rows.withColumns({"_hint": hinted, "_run": F.col("text").rlike(RUN)})
    rows = _spans(rows, "assign", ASSIGN, 0, "_hint")
    rows = _spans(rows, "access", ACCESS, 1, "_run")
    rows = _spans(rows, "hex", HEX, 2, "_run")
    rows = _spans(rows, "markov", RUN, 3, "_run")
    bare = lambda name: F.transform(name, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    rows = rows.select(
        *own,
        bare(F.filter("assign", lambda s: F.char_length(s["value"]) >= 6)).alias("assign"),
        bare("access").alias("access"),
        bare("hex").alias("hex"),
        F.filter("markov", lambda s: ~s["match"].rlike(UUID)).alias("runs"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    text = lambda run, p: F.substring(run["match"], (p["start"] - run["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))
    parts = lambda run: F.transform(F.filter(_outside(run), lambda p: p["end"] - p["start"] >= LEAST_RUN), lambda p: F.struct(p["start"].alias("start"), F.lit(3).alias("kind"), p["end"].alias("end"), text(run, p).alias("match")))
    rows = rows.withColumn("markov", bare(F.filter(F.flatten(F.transform("runs", parts)), lambda s: _ratio(ratios, s["match"]) >= min_ratio))).drop("runs")
    return rows


def _outside(run: Column) -> Column:
    """The parts of a run (start, end) that lie outside all base spans: (start, end)."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    within = F.filter("base", lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    start = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("parts"))

    def step(acc: Column, b: Column) -> Column:  # base spans come by start and may overlap
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] > acc["at"], F.concat(acc["parts"], F.array(span(acc["at"], b["start"])))).otherwise(acc["parts"]).alias("parts"))

    return F.aggregate(within, start, step, lambda acc: F.when(run["end"] > acc["at"], F.concat(acc["parts"], F.array(span(acc["at"], run["end"])))).otherwise(acc["parts"]))


def _log_ratios(docs: DataFrame, table: list[float] | None) -> Column:
    return F.from_json(F.lit(json.dumps(table or train(labelled_samples(docs.sparkSession)))), "array<double>")


def secret_spans(docs: DataFrame, table: list[float] | None = None, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for every row.

    Base spans are whole matches; Markov spans are runs, or parts of runs outside base spans, of LEAST_RUN characters or
    more; UUIDs are none. Null text counts as
    empty and has no spans; repeated rows give a row each; an empty table gives an empty result; other columns are not
    read. table: log ratios from train(); by default trained on labelled_samples.
    """
    rows = _found(text_rows(docs), _log_ratios(docs, table), min_ratio)
    count = lambda name: F.size(name).cast("long").alias(f"n_{name}")
    return rows.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", "markov"))).alias("spans"))


def mask_secrets(docs: DataFrame, table: list[float] | None = None, min_ratio: float = MIN_RATIO, mask: str = "<secret>") -> DataFrame:
    """docs with all its columns, its text with every span of secret_spans replaced by the mask (spans that overlap: once).

    Null text stays null; texts without spans are unchanged; repeated rows and ids, and column names, don't matter. An
    empty table gives an empty result.
    """
    rows = _found(nested(docs).select("row", "text"), _log_ratios(docs, table), min_ratio)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), fresh.alias("out"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.char_length("text")))

    spans = F.array_sort(F.concat("base", "markov"))
    text = F.when(F.col("row.text").isNull() | (F.size(spans) == 0), F.col("row.text")).otherwise(F.aggregate(spans, start, step, end))
    return rows.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
