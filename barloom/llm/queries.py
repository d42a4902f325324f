"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip_digest
from .chat_format import chat_report
from .common import table
from .embedding_dedup import embedding_dedup
from .exact_dedup import exact_dedup
from .hard_negatives import negative_report
from .html_extract import page_report
from .langid import language_report
from .line_dedup import line_report
from .mixing import mixed_digest
from .periodic_runs import run_report
from .quality import quality_report
from .simhash import simhash_dedup
from .suffix_dedup import suffix_report


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files are installed on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_digest(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_report(table(spark, sf_dir, "pages"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_report(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negative_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_language_id, op3_embedding_dedup, op4_quality_perplexity, op5_html_extract, op6_bpe_round_trip,
        op7_suffix_dedup, op8_line_dedup, op9_simhash_dedup, op10_exact_dedup,
        op11_chat_format, op12_periodic_runs, op13_hard_negatives)
}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": """
        WITH RECURSIVE docs AS (
            SELECT doc_id, source, coalesce(text, '') AS text, coalesce('s' || source, 'n') AS key,
                   coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS own FROM documents
        ), sizes AS (
            SELECT key, sum(length(text)) AS size FROM docs GROUP BY key HAVING sum(length(text)) > 0
        ), rates AS (
            SELECT key, pow(size::DOUBLE, 0.5) / (SELECT sum(pow(size::DOUBLE, 0.5)) FROM sizes)
                        * (SELECT sum(size) FROM sizes)::DOUBLE / size AS rate
            FROM sizes
        ), draws AS (
            SELECT key, greatest(1, ceil(rate / 32.0))::INT AS draws, rate / greatest(1, ceil(rate / 32.0)) AS mean FROM rates
        ), cdf AS (
            SELECT key, mean, draws, 0 AS j, exp(-mean) AS p, exp(-mean) AS c FROM draws
            UNION ALL
            SELECT key, mean, draws, j + 1, p * mean / (j + 1), c + p * mean / (j + 1) FROM cdf
            WHERE j < ceil(mean + 12 * sqrt(mean) + 30)
        ), tables AS (
            SELECT key, any_value(draws) AS draws, list(c ORDER BY j) AS cdf FROM cdf GROUP BY key
        ), drawn AS (
            SELECT doc_id, own, source, text, cdf, unnest(range(1, draws + 1)) AS i FROM docs JOIN tables USING (key)
        ), hashed AS (
            SELECT *, ('0x' || substr(md5('17:' || i || ':' || own), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM drawn
        ), counted AS (
            SELECT own, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(text) AS text,
                   sum(len(list_filter(cdf, lambda c: c < u)))::BIGINT AS n_copies
            FROM hashed GROUP BY own
        ), copies AS (
            SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted
        )
        SELECT doc_id, copy, n_copies, source,
               ('0x' || substr(md5('17:mix:' || own || ':' || copy), 1, 15))::BIGINT AS mix_key,
               sha256(text) AS text_sha256
        FROM copies
    """,
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
    "op11_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', x, 'user', x FROM (SELECT '\### Assistant: </turn> ok' AS x)
            UNION ALL SELECT -7, 1, 'assistant', x, 'assistant', x FROM (SELECT '\### Assistant: </turn> ok' AS x)
        ), said AS (
            SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
                   length(replace(replace(replace(text, '~', '~0'), '<turn>', '~1'), '</turn>', '~2'))
                   + length(replace(replace(replace(replace(role, '~', '~0'), '<turn>', '~1'), '</turn>', '~2'), chr(10), '~3')) + 15 AS size
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
               sum(length(loss))::BIGINT AS loss_chars,
               sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
               sum(size)::BIGINT AS formatted_chars
        FROM said GROUP BY conv_id
    """,
    "op13_hard_negatives": """
        WITH used AS (
            SELECT row_number() OVER () AS rid, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.rid, a.id AS anchor_id, b.rid AS other, b.id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM used a JOIN used b ON a.rid <> b.rid AND len(a.q) = len(b.q)
            WHERE a.id % 50 = 0
        ), positives AS (
            SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, id, other) <= 5
        )
        SELECT p.anchor_id, p.id AS positive_id,
               row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.id)::INT AS rank,
               n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.rid = p.rid AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3
    """,
}
