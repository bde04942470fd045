"""Queries of the operators of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelscope.llm import context_mixing
from panelscope.llm.bpe import round_trip
from panelscope.llm.centroid_clustering import CLUSTERS, ROUNDS, clustered
from panelscope.llm.exact_dedup import exact_groups
from panelscope.llm.hard_negatives import mined
from panelscope.llm.near_dedup import THRESHOLD_PCT, near_groups
from panelscope.llm.packing import pack_documents
from panelscope.llm.quality_model import quality
from panelscope.llm import quality_rules as rules
from panelscope.llm.quality_rules import quality_rules
from panelscope.llm.sharding import shard_documents
from panelscope.llm.suffix_dedup import without_repeats
from panelscope.llm.token_counts import token_counts
from panelscope.llm.toxicity import toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.scored(_documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(_documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_documents(spark, sf_dir)).drop("raw_key")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_documents(spark, sf_dir), THRESHOLD_PCT).drop("raw_key", "stays")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(_embeddings(spark, sf_dir))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(_embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_quality_rules, op3_lm_scoring, op4_bpe, op5_suffix_array,
        op6_exact_dedup, op7_packing, op8_minhash, op9_sharding, op10_quality,
        op11_token_counts, op12_hard_negatives, op13_centroid_clustering)
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _any(condition: str, values: tuple[str, ...]) -> str:
    quoted = (v.replace("'", "''") for v in values)
    return "(" + " OR ".join(condition.format(f"'{v}'") for v in quoted) + ")"


_RULES = f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
             l AS (SELECT doc_id, line, {_WORDS.format("line")} AS lw
                   FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
             judged AS (
                SELECT doc_id, line, len(lw) AS n,
                       len(list_filter(lw, lambda x: {_any("x = {}", rules.SEPARATORS)})) AS sep,
                       len(list_filter(lw, lambda x: regexp_matches(x, '[{rules.SYMBOLS}]'))) AS sym,
                       len(list_filter(lw, lambda x: ends_with(x, '!!'))) AS shout,
                       len(list_filter(lw, lambda x: {_any("ends_with(x, {})", rules.TERMINAL)})) AS stops,
                       {_any("contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {})",
                             rules.BOILERPLATE)} AS phrase
                FROM l WHERE len(lw) > 0),
             lines AS (
                SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN stops = 0 OR phrase
                       OR (sep >= {rules.MIN_SEPARATORS} AND 100 * sep >= {rules.MIN_SEPARATOR_PCT} * n)
                       OR 100 * sym > {rules.MAX_SYMBOL_PCT} * n OR 100 * shout > {rules.MAX_SHOUT_PCT} * n
                       THEN n ELSE 0 END) AS lost
                FROM judged GROUP BY doc_id),
             windows AS (
                SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS v
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
             covered AS (
                SELECT doc_id, count(DISTINCT k) AS c
                FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k
                      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS times FROM windows)
                      WHERE times > 1)
                GROUP BY doc_id),
             counted AS (
                SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
                       CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                       CAST(length(regexp_replace(t, '[^{rules.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
                       CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
                       CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
                FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
             based AS (
                SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PCT} * n_words
                       AS base_failed FROM counted)
        SELECT *, NOT base_failed AND 100 * n_lost_words <= {rules.MAX_LOST_PCT} * n_words AS kept FROM based"""

_INTEGERS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEGATIVES = f"""
        WITH v AS MATERIALIZED (
                SELECT row_number() OVER () AS r, vec_id, {_INTEGERS} AS e,
                       CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
             s AS MATERIALIZED (
                SELECT a.r AS ar, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS alike,
                       CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
                FROM v AS a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0),
             p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE alike),
             n AS (
                SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
                       s.score AS negative_score,
                       row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id) AS k
                FROM p JOIN s ON p.ar = s.ar WHERE p.k <= 5 AND NOT s.alike
                 AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM n WHERE k <= 3"""


def _clusters() -> str:
    """Every round as two CTEs: the assignment and the centroids that follow."""
    parts = [f"""v AS MATERIALIZED (
                SELECT row_number() OVER () AS r, vec_id, {_INTEGERS} AS e FROM embeddings
                WHERE len(embedding) = 64 AND {_FINITE})""",
             f"""c0 AS MATERIALIZED (
                SELECT row_number() OVER (ORDER BY h, e) - 1 AS k, e AS c
                FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, e FROM v
                      ORDER BY h, e LIMIT {CLUSTERS}))"""]
    for n in range(ROUNDS + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
                SELECT r, min(d).k AS k, min(d).d AS d
                FROM (SELECT r, {{'d': CAST(list_dot_product(e, e) - 2 * list_dot_product(e, c)
                      + list_dot_product(c, c) AS BIGINT), 'k': k}} AS d FROM v, c{n}) GROUP BY r)""")
        if n < ROUNDS:
            parts.append(f"""c{n + 1} AS MATERIALIZED (
                SELECT k, coalesce(m, c) AS c FROM c{n} LEFT JOIN (
                    SELECT k, list(f ORDER BY i) AS m FROM (
                        SELECT k, i, floor(sum(x) / count(*)) AS f
                        FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS i FROM v JOIN a{n} USING (r))
                        GROUP BY k, i) GROUP BY k) USING (k))""")
    return "WITH " + ",\n             ".join(parts) + f"""
        SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance,
               CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
               CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))
                   AS centroid_sha256
        FROM v JOIN a{ROUNDS} USING (r) JOIN c{ROUNDS} USING (k)"""


ORACLES: dict[str, str] = {
    "op12_hard_negatives": _NEGATIVES,
    "op13_centroid_clustering": _clusters(),
    "op2_quality_rules": _RULES,
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_FOLD}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size
                   FROM t GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM t JOIN g USING (text_sha256)""",
}
