"""The opN queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import chat, exact_dedup, nbsvm, ngram_join, packing, pieces, pii, toxicity, vector_dedup
from loomstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op8_digests(table(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_digests(table(spark, sf_dir, "documents"), PIECE_BPE)


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over JSON records of mixed layouts."""
    return chat.chat_layouts(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_packing, op2_ngram_join, op3_toxicity, op4_exact_dedup, op5_vector_dedup, op6_pii, op7_token_counts, op8_chat, op9_quality, op10_pieces, chat_layouts)
}
#: The links of op2 by counting shared shingles of all pairs, and their components by recursion.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, len(s) AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s
), p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), t AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (SELECT u, v FROM t UNION SELECT r.u, t.v FROM r JOIN t ON r.v = t.u)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n
"""
ORACLES: dict[str, str] = {"op2_ngram_join": OP2_SQL, "op4_exact_dedup": exact_dedup.ORACLE, "op5_vector_dedup": vector_dedup.ORACLE, "op8_chat": chat.ORACLE, "chat_layouts": chat.LAYOUTS_ORACLE}
