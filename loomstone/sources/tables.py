"""Readers. All go through Spark's own sources, so filters and columns are pushed into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(key, value) of the files under path; larger files than most_bytes are left out before they are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        df = df.filter(F.col("length") <= most_bytes)
    return df.select(F.col("path").alias("key"), F.col("content").alias("value"), F.col("length").alias("length"))


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp without zone (the session runs in UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))
