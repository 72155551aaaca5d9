"""Checks and statistics of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def references(name: str, df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """(reference, rows, missing): rows whose value is no key of the other table."""
    have = other.select(F.col(key).alias("_k")).distinct().withColumn("_have", F.lit(True))
    met = df.select(F.col(column).alias("_k")).join(have, "_k", "left")
    return met.agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_have").isNull()).alias("missing"))


def keys(name: str, df: DataFrame, column: str) -> DataFrame:
    """(name, rows, nulls, repeats) of a key column."""
    n = F.count(F.lit(1))
    return df.agg(F.lit(name).alias("name"), n.alias("rows"), (n - F.count(column)).alias("nulls"), (n - F.countDistinct(column)).alias("repeats"))


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n, low, high) of equal-width bins."""
    return df.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min(column), 2).alias("low"), F.round(F.max(column), 2).alias("high"))


def distinct_estimate(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns))


def compact(df: DataFrame, path: str, files: int) -> None:
    """Rewrites df as about `files` files, without a full shuffle."""
    df.coalesce(files).write.mode("errorifexists").parquet(path)


def compact_range(files: DataFrame, rows: DataFrame, path: str, low, high, key: str = "key") -> DataFrame:
    """Rewrites the rows of [low, high] that the files of a manifest (file, min_key, max_key, bytes) hold, and
    gives the files that the new ones replace. Rows outside the range stay where they are."""
    rows.filter(F.col(key).between(low, high)).sortWithinPartitions(key).write.mode("errorifexists").parquet(path)
    return files.filter((F.col("min_key") >= low) & (F.col("max_key") <= high))


def write_amplification(flushed: DataFrame, compacted: DataFrame) -> DataFrame:
    """(flushed, compacted, ratio): bytes written for each byte that came in, from tables with a `bytes` column."""
    one, two = (d.agg(F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias(n)) for d, n in ((flushed, "flushed"), (compacted, "compacted")))
    total = F.col("flushed") + F.col("compacted")
    return one.crossJoin(two).withColumn("ratio", F.when(F.col("flushed") > 0, F.round(total / F.col("flushed"), 6)))  # one row each


def vacuum_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, removed) rows of a vacuum."""
    one, two = before.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("after"))
    return one.crossJoin(two).withColumn("removed", F.col("before") - F.col("after"))  # one row each


def index_problems(index: DataFrame, df: DataFrame, primary: str) -> DataFrame:
    """(problem, n) of a secondary index (index_key, primary_key): entries of rows that are gone, and rows without an entry."""
    rows = df.select(F.col(primary).alias("primary_key"))
    gone = index.join(rows, "primary_key", "left_anti").agg(F.lit("dangling").alias("problem"), F.count(F.lit(1)).alias("n"))
    return gone.unionByName(rows.join(index.select("primary_key"), "primary_key", "left_anti").agg(F.lit("missing").alias("problem"), F.count(F.lit(1)).alias("n")))


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    """df with counters that its next action fills, without a pass of their own: rows, and named aggregates."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), seen


def distribution(df: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(n, low, high, mean, quantiles) of a measured column."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.percentile_approx(c, list(at)).alias("quantiles"))
