"""Helpers that the training-data operators share: written tables in the shared folder, model
broadcast, and names that can't clash with a caller's columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.sources.shared import fresh

ROWS, BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside read and hand over texts in batches of at most ROWS rows, so that buffers stay small."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    held = {k: int(spark.conf.get(k)) for k in names}
    for k, n in held.items():
        spark.conf.set(k, str(min(n, ROWS) if n > 0 else ROWS))
    try:
        yield
    finally:
        for k, n in held.items():
            spark.conf.set(k, str(n))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost a reread. The
    table is deleted when the driver ends, as results that are not computed yet may still read it."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    held.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(held)
    return spark.read.schema(df.schema).parquet(path)


def docs_of(df: DataFrame) -> DataFrame:
    """(doc_id, text) with null text as empty, whatever other columns the table has."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most ROWS rows and, beyond one row, BYTES bytes, so that what a step holds
    beside a batch stays small. Empty batches are left out."""
    for batch in batches:
        left = [batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)][::-1]
        while left:
            one = left.pop()
            if one.num_rows > 1 and one.nbytes > BYTES:
                half = one.num_rows // 2
                left += [one.slice(half), one.slice(0, half)]
            else:
                yield one


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow over slices(), with per-task set-up: make() runs once a task and gives the function for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in slices(batches):
            step = step or make()
            yield step(batch)

    return df.mapInArrow(run, schema)


def fold(mod: int):
    """crc32 of doc_id as text, mod `mod`: the fold that decides what labels may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))


def pick_rows(docs: DataFrame, rows: DataFrame, stay: DataFrame, key_of: Callable[[pa.Array], list[bytes]]) -> DataFrame:
    """The rows of docs that stay, every column as it came.

    rows: (doc_id) of every row; stay: (kept_id, kept_key, one), where key_of gives the key of a text. Of
    rows equal in doc_id and key one stays where `one` is set, the least by a hash of its columns, else all.
    An id that stays and is the id of one row only needs no look at the texts.
    """
    stay = written(stay, "stay")
    once = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("doc_id").alias("kept_id"))
    plain = stay.join(once, "kept_id", "left_semi").select("kept_id").hint("merge")  # ids of about all rows: the same join at every size
    out = docs.join(plain, docs["doc_id"].cast("long") == plain["kept_id"], "left_semi")
    rest = written(stay.join(once, "kept_id", "left_anti"), "repeated")
    if rest.isEmpty():
        return out
    names = [f"c{i}" for i in range(len(docs.columns))]  # a caller's columns may have any name
    text, doc_id = docs.columns.index("text"), names[docs.columns.index("doc_id")]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(key_of(batch.column(text)), pa.binary())], [*names, "row_key"])

        return step

    ids = rest.select("kept_id").filter("kept_id IS NOT NULL").distinct()
    some = docs.join(ids, docs["doc_id"].cast("long") == ids["kept_id"], "left_semi").unionByName(docs.filter(docs["doc_id"].isNull())).toDF(*names)
    keyed = map_batches(some, make, T.StructType([*some.schema.fields, T.StructField("row_key", T.BinaryType())]))
    keyed = keyed.join(rest, F.col(doc_id).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("row_key") == F.col("kept_key")))
    whole = F.struct(*names)
    one = keyed.filter("one").groupBy("kept_id", "row_key").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("v"))
    found = one.select(*(F.col(f"v.{n}").alias(n) for n in names)).unionByName(keyed.filter("NOT one").select(*names))
    return out.unionByName(found.toDF(*docs.columns))
