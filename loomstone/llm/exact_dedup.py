"""Exact duplicates: rows are grouped by a 128-bit content hash, bytes are compared inside groups.

One pass reads the texts and leaves (doc_id, MD5, SHA-256) of each row; only these are shuffled. Hashes
that occur more than once set bits in a filter of bounded size. Texts whose hash passes it are grouped by
(hashes, text), copies first within each task, and different texts under one hash raise instead of being
merged. The filter only saves work: the fuller it is, the more texts are compared, never fewer.

Null text counts as empty; empty texts equal each other. Repeated rows (same doc_id and text) count
as members of the group. An empty table gives an empty result. Rows with a null doc_id are members
like any other but are never the one that stays unless the group has no other. Ties: all rows of the
doc_id that stays are `kept` in exact_groups(), which reports ids; drop_exact() keeps one row of them,
the least by a hash of its columns. A doc_id with several texts is judged text by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import docs_of, map_batches, pick_rows, slices, written

LEAST_BITS, MOST_BITS = 16, 28  # of the filter; 2**28 bits are 32 MB


def _normal(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of texts with A-Z lower-cased: on bytes, lower() changes nothing else."""
    return [(b or b"").lower() for b in texts.cast(pa.binary()).to_pylist()]


def _md5(made: list[bytes]) -> list[bytes]:
    return [hashlib.md5(b).digest() for b in made]


def _sha(made: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b).digest() for b in made]


def content_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, sha): MD5 and SHA-256 of each row's normalised text."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = _normal(batch.column(1))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_md5(made), pa.binary()), pa.array(_sha(made), pa.binary())], ["doc_id", "h", "sha"])

        return step

    return map_batches(docs_of(docs), make, "doc_id long, h binary, sha binary")


def _places(hashes: list[bytes], bits: int) -> np.ndarray:
    """Four bit positions for each hash, taken from its bytes."""
    words = np.frombuffer(b"".join(hashes), dtype="<u4").reshape(len(hashes), 4)
    return (words >> np.uint32(32 - bits)).astype(np.int64)


def _filter_of(groups: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bit table) of the hashes of groups; at most 2**MOST_BITS bits reach the driver."""
    n = groups.count()
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, 12 * n))))))

    def mark(batches):
        table = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in slices(batches):
            at = _places(batch.column(0).to_pylist(), bits)
            np.bitwise_or.at(table, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["t"])

    def join(batches):
        table = np.zeros(1 << (bits - 3), dtype=np.uint8)
        for batch in batches:
            for one in batch.column(0).to_pylist():
                table |= np.frombuffer(one, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["t"])

    marked = groups.select("h").coalesce(64).mapInArrow(mark, "t binary").repartition(8).mapInArrow(join, "t binary")
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in marked.collect():  # 8 tables of 32 MB at most
        table |= np.frombuffer(row["t"], dtype=np.uint8)
    return bits, table


def _texts(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(h, sha, text) of all rows whose hash is in `repeated`, and of few others."""
    bits, table = _filter_of(repeated)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 2**MOST_BITS bits at most

    def make():
        held = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = _normal(batch.column(1))
            h = _md5(made)
            at = _places(h, bits)
            hit = np.flatnonzero(((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)).tolist()
            some = [made[i] for i in hit]
            return pa.RecordBatch.from_arrays([pa.array([h[i] for i in hit], pa.binary()), pa.array(_sha(some), pa.binary()), pa.array(some, pa.binary())], ["h", "sha", "text"])

        return step

    return map_batches(docs_of(docs), make, "h binary, sha binary, text binary")


def _compare(texts: DataFrame) -> None:
    """Raises where texts (h, sha, text) that share both hashes hold different bytes; copies merge in each task first."""
    different = texts.distinct().groupBy("h", "sha").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not different.isEmpty():
        raise ValueError("two different texts share MD5 and SHA-256")


def _groups(docs: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, h, sha), groups (h, sha, keep_id, group_size)), both written, texts compared."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = written(content_hashes(docs), "hashes")
    groups = rows.groupBy("h", "sha").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # written, so that joins with it are between two plain exchanges and a hot group can be split
    groups = written(groups, "groups")
    _compare(_texts(docs, groups.filter("group_size > 1")))
    return rows, groups


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" keeps the smallest doc_id of a group (the stable choice), "max" the largest.
    """
    rows, groups = _groups(docs, keep)
    return rows.join(groups, ["h", "sha"]).select("doc_id", "keep_id", "group_size", _kept().alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs with one row of each group of equal texts; every column as it came."""
    rows, groups = _groups(docs, keep)
    stay = rows.join(groups, ["h", "sha"]).filter(_kept()).select(F.col("doc_id").alias("kept_id"), F.col("sha").alias("kept_key"), F.lit(True).alias("one"))
    return pick_rows(docs, rows, stay.distinct(), lambda texts: _sha(_normal(texts)))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
