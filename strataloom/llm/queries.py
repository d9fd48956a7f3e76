"""The queries of this subpackage, one for each numbered operator, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.functions.runtime import share_package
from strataloom.llm import bpe_codec, chunk_codec, conversations, language_id, packing, phrases, pii, quality_model, quality_rules, simhash, token_counts, topk, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op1_simhash(table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op2_quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3_pii(table(spark, sf_dir, "documents"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.op4_bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op5_exact_topk(table(spark, sf_dir, "embeddings"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6_language_id(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8_best_fit_packing(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op9_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op10_url_rules(table(spark, sf_dir, "pages"))


def op11_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.op11_chunk_codec(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op12_phrases(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op13_conversation_repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_model, op3_pii, op4_bpe_codec, op5_exact_topk, op6_language_id, op7_quality_rules, op8_best_fit_packing, op9_token_counts, op10_url_rules, op11_chunk_codec, op12_phrases, op13_conversation_repair)}

ORACLES = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
            FROM v q JOIN v p ON q.vec_id <> p.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op12_phrases": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), lines AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
        ), counted AS (
            SELECT lang, words, phrase, count(*) AS f
            FROM (
                SELECT lang, words, unnest(list_transform(range(1, len(w) - words + 2), lambda i: array_to_string(w[i:i + words - 1], ' '))) AS phrase
                FROM lines, (VALUES (1), (2), (3), (4), (5)) t(words)
            )
            GROUP BY ALL HAVING f >= 100
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lines GROUP BY lang
        ), cuts AS (
            SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM counted WHERE words > 1
        ), scored AS (
            SELECT c.lang, c.words, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
                   CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cuts c
            JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
            JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), free AS (
            SELECT * FROM lowest s
            WHERE NOT EXISTS (
                SELECT 1 FROM counted g
                WHERE g.lang = s.lang AND g.words > s.words AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * g.f >= 100 * s.a
            )
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM free QUALIFY rank <= 2000
    """,
}
