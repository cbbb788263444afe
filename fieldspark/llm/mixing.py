"""Mixing of domains to target token weights by soft membership, in DataFrame functions only.

A multinomial word classifier is trained on a bounded sample of the labelled documents (those with a row in the labels
table, whose domain is trusted) and gives every document a posterior over the domains. Nonnegative rates r are then
fitted by projected gradient so that the expected token totals sum(n * r * p_d) match the targets in the least squares
sense. A step lowers a document's rate by p . y, y being the residual times a step size: that is the gradient where each
rate counts by its tokens, so what it ends at is the least squares optimum. Only y (one number a domain) is shared, so a
rate is a fold over the history of y; every step is one aggregation over the small table of (tokens, posterior), whose
rates are written every few steps.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, nested

MAX_LABELLED = 4000
VOCABULARY = 8192
EVIDENCE = 4.0  # words of evidence a posterior may rest on; more are averaged down, which keeps memberships soft
STEPS = 400
TOLERANCE = 1e-5
#: What the residual's square may lie above the optimum, as a share of it; steps between two written tables.
SETTLED, WRITTEN = 0.02, 10
ALPHA = 0.7


def _words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+")


def domain_model(docs: DataFrame, labels: DataFrame, domain: str = "lang", max_labelled: int = MAX_LABELLED, vocabulary: int = VOCABULARY) -> tuple[list[str], list[tuple[float, float]], DataFrame]:
    """Domains, their (log prior, log size) and the table (word, entries) of log counts by domain; add-one smoothing.

    The sample is the max_labelled labelled ids of least hash; rows with a null id or domain teach nothing. All domains
    of the sample count. entries holds (d, log(n + 1)) for the domains that have the word, and (-1, 1) for the word
    itself; the log probability of a word in a domain is its log count, or zero, less the log size.
    """
    chosen = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    taught = docs.where(F.col(domain).isNotNull()).select("doc_id", F.col(domain).cast("string").alias("domain"), "text").join(F.broadcast(chosen), "doc_id")
    counts = materialize(taught.select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''").groupBy("domain", "word").agg(F.count(F.lit(1)).alias("n")), "domain-words")
    shares = {r.domain: r.n for r in taught.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(shares)
    if not names:
        return [], [], docs.sparkSession.createDataFrame([], "word string, entries array<struct<d:int,l:double>>")
    top = counts.groupBy("word").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "word").limit(vocabulary).select("word")
    place = (F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1).cast("int")
    known = materialize(counts.join(F.broadcast(top), "word").select("word", place.alias("d"), "n"), "domain-vocabulary")
    totals = {r.d: r.n for r in known.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    v = known.select("word").distinct().count()
    prior = np.log(np.array([shares[d] for d in names]) / sum(shares.values()))
    size = [math.log(max(totals.get(i, 0) + v, 1)) for i in range(len(names))]
    entry = F.struct("d", F.log(F.col("n") + 1.0).alias("l"))
    itself = F.array(F.struct(F.lit(-1).alias("d"), F.lit(1.0).alias("l")))
    return names, list(zip(prior.tolist(), size)), known.groupBy("word").agg(F.concat(itself, F.collect_list(entry)).alias("entries"))


def memberships(docs: DataFrame, labels: DataFrame, domain: str = "lang", keep: list[str] | None = None, **model) -> tuple[list[str], DataFrame]:
    """Domains and the table (kept columns, n_tokens, p): words between white space, and the posterior array."""
    names, prior, words = domain_model(docs, labels, domain, **model)
    keep = keep or ["doc_id"]
    key = [*keep, "_row", "n_tokens"]
    tagged = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.array_remove(_words(F.col("text")), "").alias("words")).select(*keep, "_row", F.size("words").cast("long").alias("n_tokens"), F.explode_outer("words").alias("word"))
    scored = tagged.join(F.broadcast(words), "word", "left").select(*key, F.explode_outer("entries").alias("e"))  # at most `vocabulary` words
    sums = scored.groupBy(*key, F.col("e.d").alias("d")).agg(F.sum("e.l").alias("s"))
    sums = sums.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "s")))).alias("m"))
    scale = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(1)))
    got = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))
    base = F.from_json(F.lit(json.dumps([{"i": i, "prior": a, "size": b} for i, (a, b) in enumerate(prior)])), "array<struct<i:int,prior:double,size:double>>")
    logits = F.transform(base, lambda b: b["prior"] + (got(b["i"]) - got(F.lit(-1)) * b["size"]) * scale) if names else F.array(F.lit(0.0))
    sums = sums.select(*keep, "n_tokens", logits.alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return names or ["unknown"], sums.select(*keep, "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def _dot(y: list[float]) -> Column:
    """p . y of a document."""
    return F.aggregate(F.zip_with("p", F.array(*map(F.lit, y)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _stepped(r: Column, y: list[float], share: float = 1.0) -> Column:
    """r + share * (max(0, r - p . y) - r)."""
    to = F.greatest(F.lit(0.0), r - _dot(y))
    return to if share == 1.0 else (1 - share) * r + share * to


def _totals(members: DataFrame, weight: Column, d: int) -> np.ndarray:
    """sum of weight * p by domain, one row a domain."""
    out = np.zeros(d)
    for r in members.select(weight.alias("w"), F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("v")).collect():
        out[r.i] = r.v or 0.0
    return out


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """members with a column `r`: nonnegative rates at which the expected shares are the least squares fit of targets.

    members: a stored table with (n_tokens, p). Starts from rates of one; documents count by their tokens. Step sizes are
    the spectral ones of Barzilai and Borwein, and each step ends at the least residual between its two ends. Ends when
    the residual is within tolerance, or when the conditions of the optimum (no gradient along positive rates, none
    downwards at rates of zero) bound what is left by SETTLED of its square; raises RuntimeError if neither comes within
    `steps`, as for targets that only a few documents come near.
    """
    d = len(targets)
    total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
    held = members.withColumn("r", F.lit(1.0))
    if not total:
        return held
    weight = F.col("n_tokens") / total
    shares = _totals(members, weight, d)
    size = 1.0  # no curvature is above one: posteriors sum to one, and so do the weights
    for step in range(1, steps + 1):
        residual = shares - targets
        if np.abs(residual).max() <= tolerance:
            return held
        to = _stepped(F.col("r"), (size * residual).tolist())
        sums = [F.sum(weight * F.col("_to") * F.col("p")[i]) for i in range(d)]
        row = held.where("n_tokens > 0").withColumn("_to", to).agg(*sums, F.sum(weight * (F.col("_to") - F.col("r")) * (F.col("_to") - F.col("r"))), F.min(_dot(residual.tolist()))).first()
        there, moved, least = np.array(row[:d]), row[d], row[d + 1]
        if abs(residual @ shares) + max(0.0, -least) * (1 + shares.sum()) <= SETTLED * (residual @ residual) / 2:
            return held
        ahead = there - shares
        if not ahead @ ahead:
            return held  # no step changes the shares
        share = float(min(1.0, max(0.0, -(residual @ ahead) / (ahead @ ahead))))
        held = held.withColumn("r", _stepped(F.col("r"), (size * residual).tolist(), share))
        shares, size = (1 - share) * shares + share * there, float(min(1e8, max(1e-3, moved / (ahead @ ahead))))
        if step % WRITTEN == 0:
            held = materialize(held, "rates")
            shares = _totals(held, weight * F.col("r"), d)
    raise RuntimeError(f"rates did not settle in {steps} steps; residual {np.abs(residual).max():.2g} of all tokens")


def targets_for(names: list[str], members: DataFrame, weights: dict[str, float] | None, alpha: float = ALPHA) -> list[float]:
    """Target shares: the given weights, or the expected shares raised to alpha; both scaled to sum to one.

    Weights for domains that the model does not know raise a ValueError, unless there are no documents.
    """
    if weights is None:
        raw = _totals(members, F.col("n_tokens"), len(names)) ** alpha
    else:
        unknown = sorted(set(weights) - set(names))
        if unknown and not members.isEmpty():
            raise ValueError(f"target weights for unknown domains: {', '.join(unknown)}")
        raw = np.array([weights.get(n, 0.0) for n in names], float)
    return (raw / raw.sum()).tolist() if raw.sum() else [1 / len(names)] * len(names)


def mixture(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, alpha: float = ALPHA, keep: list[str] | None = None, **model) -> DataFrame:
    """doc_id (or keep), n_tokens, domain, posterior, rate, copies for every row.

    domain is the likeliest one (of equal ones the first by name); rate is the fitted sampling rate; copies rounds it up or down by a hash of the id.
    Null or empty texts have no tokens and get the prior as posterior. Repeated rows give a row each; without labelled
    rows there is one domain "unknown" and all rates are one. An empty table gives an empty result.
    """
    names, members = memberships(docs, labels, domain, keep, **model)
    members = materialize(members, "memberships")
    members = fit_rates(members, targets_for(names, members, weights, alpha))
    first = members.columns[0]
    chance = F.pmod(F.xxhash64(F.lit("mixing"), first), F.lit(1_000_000)) / F.lit(1_000_000.0)
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("p", F.array_max("p")).cast("int"))
    out = members.withColumn("rate", F.round("r", 6))
    copies = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")
    return out.select(*(keep or ["doc_id"]), "n_tokens", best.alias("domain"), F.transform("p", lambda x: F.round(x, 6)).alias("posterior"), "rate", copies.alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs, each as often as its rate asks for, with all their columns.

    Rates belong to (doc_id, text), so rows that share a doc_id keep rates of their own; equal rows have equal rates. Null
    and empty texts count by the prior. An empty table gives an empty result.
    """
    rows = nested(docs)
    inner = rows.select("doc_id", "th", "text", F.col(f"row.`{domain}`").alias("domain"))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    rates = mixture(inner, taught, "domain", weights, alpha, ["doc_id", "th"]).groupBy(F.col("doc_id").alias("id"), F.col("th").alias("hash")).agg(F.max("copies").alias("copies"))
    out = rows.join(rates.where("copies > 0"), F.expr("id <=> doc_id and hash = th"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
