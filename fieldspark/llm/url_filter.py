"""URL filter: fixed rules first, then personalised PageRank over host edges.

Rules name a host (with its subdomains) and the start of a path; the longest one that fits decides. Hosts get a seed of
trust, the share of their pages that rules allow, and a seed of distrust, the share that rules block. Trust follows links
from host to host; distrust goes back from a host to those that link to it. What reaches a host in the limit decides
about its pages that no rule fits.

Host edges are the links in the pages (absolute or protocol-relative; relative ones stay on their host), summed for each
pair of hosts, and one edge each way between a host and its parent (the host without its first label) where both occur.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules of the query: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of trust and distrust that is passed on in a step.
DAMPING = 0.85
#: Rules at most: they become one expression.
MAX_RULES = 2000
#: Steps between two stored tables.
STEPS = 4
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, A-Z in lower case; empty for null and where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null and where there is no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits (equal lengths: the first in order of the text), else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    if any(action not in ("allow", "block") for action, _, _ in rules):
        raise ValueError("a rule's action is allow or block")
    out = F.lit(None).cast("struct<action: string, rule: string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) for pages (host, html, ...): links between different hosts, and parents."""
    linked = pages.where("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = materialize(links, "links")
    hosts = pages.where("host <> ''").select("host").distinct().union(links.select("dst")).distinct()
    child = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where("src <> dst and dst <> ''")
    family = child.join(hosts.select(F.col("host").alias("dst")), "dst").select("src", "dst")
    both = family.union(family.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit(1).cast("long").alias("n"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = 1e-4, max_steps: int = 100) -> DataFrame:
    """(host, trust, distrust) in the limit of x = seed + damping * W x, for seeds (host, trust, distrust).

    W passes a host's trust on over its edges in proportion to their number, and its distrust back to the hosts with edges
    to it, likewise. Values are in units of a seed, so a lone host keeps its seed. Ends when no value of a host changes by
    more than `tolerance` in STEPS steps; beyond max_steps with a warning. Hosts that nothing reaches have no row.
    """
    out, back = (edges.groupBy(c).agg(F.sum("n").alias(t)) for c, t in (("src", "_out"), ("dst", "_in")))
    weighed = edges.join(out, "src").join(back, "dst")
    zero = F.lit(0.0)
    ahead = weighed.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("_out")).alias("wt"), zero.alias("wd"))
    behind = weighed.select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("wt"), (F.col("n") / F.col("_in")).alias("wd"))
    moves = materialize(ahead.union(behind), "moves")
    seeds = materialize(seeds.select("host", F.col("trust").cast("double").alias("trust"), F.col("distrust").cast("double").alias("distrust")), "seeds")
    now, steps = seeds, 0
    if moves.isEmpty():
        return now
    while True:
        before = now
        for _ in range(STEPS):
            sent = moves.join(now, "host").select(F.col("to").alias("host"), (damping * F.col("wt") * F.col("trust")).alias("trust"), (damping * F.col("wd") * F.col("distrust")).alias("distrust"))
            now = sent.union(seeds).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        now, steps = materialize(now, "scores"), steps + STEPS
        was = before.select("host", F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
        gap = now.join(was, "host", "left").agg(F.max(F.greatest(F.abs(F.col("trust") - F.coalesce("_t", F.lit(0.0))), F.abs(F.col("distrust") - F.coalesce("_d", F.lit(0.0)))))).first()[0]
        if gap is None or gap <= tolerance:
            return now
        if steps >= max_steps:
            warnings.warn(f"scores did not settle in {steps} steps; the last {STEPS} changed one by {gap:.2g}", RuntimeWarning, stacklevel=2)
            return now


def host_scores(pages: DataFrame, threshold: float, **options) -> DataFrame:
    """(host, trust, distrust, verdict) for pages (host, rule, html): block where distrust exceeds trust by `threshold` or more, else allow."""
    judged = pages.where("host <> ''").groupBy("host").agg(*(F.avg(F.when(F.col("rule.action") == action, 1.0).otherwise(0.0)).alias(name) for action, name in (("allow", "trust"), ("block", "distrust"))))
    reached = propagate(host_edges(pages), judged.where("trust > 0 or distrust > 0"), **options)
    return reached.withColumn("verdict", F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages (page_id, url, html).

    rule is the longest rule that fits (like `net/`), else null; verdict is the rule's, else that of the host: block where
    its distrust exceeds its trust by `threshold` (in units of a wholly blocked host) or more. score is trust - distrust
    of the host, 0 where nothing reaches it. A null url or one without :// has an empty host and path, fits no rule and is
    allowed. Null html has no links. Repeated rows count, and each gives a row.
    """
    known = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    scores = host_scores(known, threshold, **options).select("host", (F.col("trust") - F.col("distrust")).alias("score"), F.col("verdict").alias("_verdict"))
    # A host with very many pages is split by Spark's skew join; scores have one row a host.
    out = known.drop("html").join(scores, "host", "left")
    return out.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce("rule.action", "_verdict", F.lit("allow")).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))
