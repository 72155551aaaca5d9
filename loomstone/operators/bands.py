"""Bands of one number: running sums over an order, and rows counted in bands without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.sources.shared import checkpointed


def running(df: DataFrame, n: Column, *order: str) -> DataFrame:
    """df with the sum of n from the first row of an order to the row itself (`running`) and over all rows
    (`total`), in many tasks: ranges of the order are summed by themselves, and what lies before each range
    is added. Only a sum for each range is gathered in one task."""
    parts = checkpointed(df.withColumn("_n", n.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", before.alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("total"))
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_inside", inside).join(starts, "_part").withColumn("running", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside", "_n")


def counts(bands: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """(key, n): how many points (by, value) lie in the bands (key, by, low, high) of each key, ends included
    and keys without any left out.

    What a band holds is the points up to its high end less those before its low end. Points and ends are
    put in one order, so work grows with the rows and not with the pairs, however many rows share a group.
    """
    low, high = (F.struct(F.col(c).alias("_v"), F.lit(side).alias("_side")) for c, side in (("low", 0), ("high", 2)))
    ends = bands.filter("by IS NOT NULL AND low <= high").select(key, "by", F.inline(F.array(low, high)))
    rows = points.filter("by IS NOT NULL AND value IS NOT NULL").select(F.lit(None).cast(bands.schema[key].dataType).alias(key), "by", F.col("value").alias("_v"), F.lit(1).alias("_side"))
    placed = running(ends.unionByName(rows), F.col("_side") == 1, "by", "_v", "_side", key).filter("_side <> 1")
    return placed.groupBy(key).agg(F.sum(F.when(F.col("_side") == 2, F.col("running")).otherwise(-F.col("running"))).alias("n")).filter("n > 0")
