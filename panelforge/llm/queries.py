"""Registered queries of the operators, over whole tables and whole texts, and their SQL where SQL can express them.

Operators that fit a model or write stage tables run those jobs when the query function is called; the rows come with the returned plan.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from panelforge.llm import chat, cuckoo, langid, merkle, merkle_sql, negatives, packing, pieces, quality, simhash, suffixes, topk, toxicity, viterbi
from panelforge.llm.common import table

PIECES = "piece_bpe_32k.model"
BYTES, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(table(spark, folder, "documents"))


def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that holds control strings in its texts."""
    said = r"\### Assistant: </turn> ok"
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(hard))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.with_components(table(spark, folder, "documents"))


def pack_tokens(docs: DataFrame) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(BYTES), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_tokens(table(spark, folder, "documents"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo.duplicates(table(spark, folder, "documents")).drop(cuckoo.ROW)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return viterbi.counts(table(spark, folder, "documents"), public_tokenizers.path(PIECES))


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The model is fitted when the query is called; scoring runs with the result."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(table(spark, folder, "documents"), tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": op1_pieces,
    "op2_suffixes": op2_suffixes,
    "op3_langid": op3_langid,
    "op4_chat": op4_chat,
    "op5_simhash": op5_simhash,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_topk": op10_topk,
    "op11_toxicity": op11_toxicity,
    "op12_negatives": op12_negatives,
    "op13_merkle": op13_merkle,
}

ORACLE: dict[str, str] = {
    "op12_negatives": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)
        ),
        s AS MATERIALIZED (
            SELECT a.r AS a, c.r AS c, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                CAST(coalesce(list_sum([a.e[i] * c.e[i] FOR i IN range(1, least(len(a.e), len(c.e)) + 1)]), 0) AS BIGINT) AS score
            FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 50 = 0
        ),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, c) <= 5),
        n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.vec_id, s.c) AS k,
                s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        )
        SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
    """,
    "op13_merkle": merkle_sql.manifest_sql(),
    "op4_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ),
        t AS (
            SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool' ELSE '=' || hex(role) END AS label,
                replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\### ') AS escaped,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + length(label) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
            bool_and(coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')) AS valid
        FROM t GROUP BY conv_id
    """,
    "op10_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)
        ),
        s AS (
            SELECT q.r AS q, q.vec_id AS query_id, c.r AS c, c.vec_id,
                CAST(coalesce(list_sum([q.e[i] * c.e[i] FOR i IN range(1, least(len(q.e), len(c.e)) + 1)]), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
        ),
        n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, c) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM n WHERE n <= 5
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
}
