"""Append-only logs: segments, retention, ordered reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators.mvcc import newest


def append(df: DataFrame, path: str, segment: int) -> None:
    """Writes rows (key, value, seq) as a segment; files of other segments are never touched."""
    df.withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(path)


def put(df: DataFrame, path: str, most: int) -> int:
    """Appends rows (key, value, seq) to the open segment, or to the next one when the open one has `most` rows;
    gives its number. A log that does not exist starts with segment 0."""
    spark = df.sparkSession
    try:
        last = read(spark, path).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("segment")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    segment = 0 if last is None else last["segment"] + (last["n"] >= most)
    append(df, path, segment)
    return segment


def delete(keys: DataFrame, path: str, most: int) -> int:
    """Appends tombstones of keys (key, seq)."""
    return put(keys.select("key", F.lit(None).cast("string").alias("value"), "seq"), path, most)


def state_at(df: DataFrame, seq: int) -> DataFrame:
    """(key, value) as of a place in the log, which counts."""
    return state(df.filter(F.col("seq") <= seq))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def segments(df: DataFrame, rows: int, order: str = "seq") -> DataFrame:
    """df with the segment of each row when segments are sealed after `rows` rows: plain arithmetic on seq."""
    return df.withColumn("segment", F.floor(F.col(order) / rows).cast("long"))


def keep_segments(df: DataFrame, n: int) -> DataFrame:
    """The open segment and the n newest sealed ones."""
    some = df.select("segment").distinct().withColumn("_n", F.dense_rank().over(Window.orderBy(F.desc("segment")))).filter(F.col("_n") <= n + 1)
    return df.join(some.select("segment"), "segment", "left_semi")


def keep_age(df: DataFrame, oldest, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= oldest)


def state(df: DataFrame) -> DataFrame:
    """(key, value) of the last entry of each key, without tombstones (null values)."""
    return newest(df.select("key", "value", "seq")).filter("value IS NOT NULL").select("key", "value")
