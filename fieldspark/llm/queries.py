"""Registered queries of the numbered operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, fuzzy_lines, mixing, periodic_runs, prefix_counts, prefix_trie, quality, secrets, simhash, suffix_dedup, token_output, url_filter
from .common import documents


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simple8b_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(documents(spark, sf_dir))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


def op5_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_groups(documents(spark, sf_dir))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op9_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_simple8b_output, op3_soft_mixing, op4_secret_scan, op5_fuzzy_line_dedup, op6_benchmark_decontamination, op7_simhash_near_dedup, op8_suffix_array_dedup,
        op9_prefix_token_counts, op10_exact_dedup, op11_conversation_trie, op12_url_filter, op13_periodic_runs,
    )
}

ORACLES = {
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(n.norm) AS text_sha256
        FROM n JOIN g ON n.norm = g.norm""",
    # crc32 bit by bit; every node is a prefix, and savings and leaves of a node count for all its prefixes
    "op11_conversation_trie": """
        WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
             h AS (SELECT conv_id, turns, CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                     lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS BIGINT) AS h FROM own),
             built AS (SELECT h.conv_id, list_concat(CASE WHEN h.h = 0 THEN [] ELSE coalesce(b.turns, [])[1:h.h] END, h.turns[h.h + 1:]) AS turns
                       FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
             prefixes AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE turns[1:d] END AS p, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)),
             nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids,
                              CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(p[d].text)) END AS bytes FROM prefixes GROUP BY d, p),
             kids AS (SELECT d - 1 AS d, CASE WHEN d = 1 THEN [] ELSE p[1:d - 1] END AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
             full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.d = k.d AND n.p = k.p),
             up AS (SELECT k AS d, CASE WHEN k = 0 THEN [] ELSE p[1:k] END AS p, (n_convs - 1) * bytes AS saved, CAST(n_children = 0 AS BIGINT) AS leaf FROM (SELECT *, unnest(range(d + 1)) AS k FROM full_nodes)),
             sums AS (SELECT d, p, sum(saved) AS saved, sum(leaf) AS leaves FROM up GROUP BY d, p)
        SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
               CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
        FROM full_nodes n JOIN sums s ON n.d = s.d AND n.p = s.p LEFT JOIN nodes q ON q.d = n.d - 1 AND q.p = CASE WHEN n.d <= 1 THEN [] ELSE n.p[1:n.d - 1] END""",
}
