"""The corpus pipeline: quality classifier, exact dedup, near dedup, redaction, packing.

Each stage works on all rows that the one before it kept, and its decisions take effect. Null and empty
texts are scored like any text without words; equal to each other, one of them is left after exact dedup; the
near-duplicate stage links them with nothing, redaction leaves them as they are, and packing gives them one
end id. Rows with a null doc_id go through every stage: they stay unless a document has the same text, or the
same set of shingles. Of rows equal in doc_id and text one stays; of several texts under one doc_id each is
judged by itself. Ties go to the smallest doc_id. Texts of any length are read whole. An empty table stays
empty. Other columns pass through as they came, whatever their names; all but the last stage return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import exact_dedup, nbsvm, ngram_join, packing, pii
from loomstone.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nbsvm.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: Each stage's rows are written as Parquet and read again as the next one's docs.
STAGES: list[tuple[str, Stage]] = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("pii", redact), ("packing", pack)]

#: Classifier, tokenizer and trees have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
