"""Time series: range scans, latest-before and as-of, aggregation, downsampling, buckets, retention, codecs.

A series table has a series column, an integer or timestamp `ts` and a value. Windows are anchored at the
scan's start, ranges are half-open, latest-before is inclusive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loomstone.operators import mvcc

KINDS = ("sum", "avg", "min", "max", "count")


def scan(df: DataFrame, start, end, series=None, by: str = "series", ts: str = "ts") -> DataFrame:
    """Points of [start, end), of one series or all."""
    out = df.filter((F.col(ts) >= start) & (F.col(ts) < end))
    return out if series is None else out.filter(F.col(by) == series)


def latest_before(df: DataFrame, at, by: str = "series", ts: str = "ts", value: str = "value") -> DataFrame:
    """Per series, the last point at or before `at`: one aggregation, no sort."""
    return df.filter(F.col(ts) <= at).groupBy(by).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))


def get(df: DataFrame, at, series, by: str = "series", ts: str = "ts") -> DataFrame:
    """The points of a series at exactly one time."""
    return df.filter((F.col(by) == series) & (F.col(ts) == at))


def bucket_points(df: DataFrame, size: int, by: str = "series", ts: str = "ts") -> DataFrame:
    """(by, bucket, points) of every bucket that has points."""
    return df.groupBy(by, bucket(F.col(ts), size).alias("bucket")).agg(F.count(F.lit(1)).alias("points"))


def visible(log: DataFrame, lsn: int, by: str = "series", ts: str = "ts") -> DataFrame:
    """The points of a change log (series, ts, value, is_deleted, txn_id, commit_lsn, seq) as of lsn."""
    return mvcc.visible(log, lsn, keys=(by, ts))


def asof(probes: DataFrame, points: DataFrame, by: str = "series", ts: str = "ts", value: str = "value", out: str = "asof_value", size: int | None = None) -> DataFrame:
    """probes with the value of the last point of their series at or before their ts.

    Both sides meet in one window per series over their union, so the cost is one shuffle and sort, and
    no probe is compared with more than its neighbour. Points at the same ts come before probes. With
    `size`, a whole number, a window holds one bucket of that much time, so a hot series is many tasks;
    probes before a bucket's first point take the last point of an earlier bucket, found among one row for
    each bucket.
    """
    if size is not None:
        at = lambda df: df.withColumn("_bucket", bucket(F.col(ts), size))
        near = asof(at(probes).withColumn("_series", F.struct(by, "_bucket")), at(points).select(F.struct(by, "_bucket").alias("_series"), ts, value), "_series", ts, value, out)
        last = at(points).groupBy(by, "_bucket").agg(F.struct(F.max(ts).alias("t"), F.max_by(value, F.col(ts)).alias("v")).alias("_last"))
        asked = near.select(by, "_bucket").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType))
        w = Window.partitionBy(by).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
        earlier = last.unionByName(asked).withColumn("_before", F.last("_last", ignorenulls=True).over(w)).groupBy(by, "_bucket").agg(F.first("_before", ignorenulls=True).alias("_before"))
        met = near.join(earlier, [by, "_bucket"], "left")
        none = F.col("asof_ts").isNull()
        return met.select(*probes.columns, F.when(none, F.col("_before.v")).otherwise(F.col(out)).alias(out), F.when(none, F.col("_before.t")).otherwise(F.col("asof_ts")).alias("asof_ts"))
    p = probes.select(*probes.columns, F.lit(1).alias("_probe"), F.lit(None).cast(points.schema[value].dataType).alias("_value"), F.lit(None).cast(points.schema[ts].dataType).alias("_at"))
    rest = [c for c in probes.columns if c not in (by, ts)]
    q = points.select(F.col(by), F.col(ts), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in rest), F.lit(0).alias("_probe"), F.col(value).alias("_value"), F.col(ts).alias("_at"))
    w = Window.partitionBy(by).orderBy(ts, "_probe").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = p.unionByName(q).withColumn(out, F.last("_value", ignorenulls=True).over(w)).withColumn("asof_ts", F.last("_at", ignorenulls=True).over(w))
    return both.filter("_probe = 1").select(*probes.columns, out, "asof_ts")


def aggregate(df: DataFrame, kind: str, value: Column | str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """sum, avg, min or max of the numbers (null where there is none), or count of all points."""
    v = F.col(value) if isinstance(value, str) else value
    pick = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if kind not in KINDS:
        raise ValueError(f"unknown aggregation {kind}")
    return df.groupBy(*by).agg((F.count(F.lit(1)) if kind == "count" else pick[kind](v)).alias(kind))


def downsample(df: DataFrame, start: int, end: int, interval: int, kind: str, value: Column | str = "value", ts: Column | str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., window_start, window_end, kind): windows of `interval` from `start`; empty ones are left out."""
    if interval <= 0:
        raise ValueError("the interval must be positive")
    t = F.col(ts) if isinstance(ts, str) else ts
    w = (t - F.pmod(t - start, F.lit(interval))).cast("long")  # whole numbers: nanoseconds don't fit a double
    rows = df.filter((t >= start) & (t < end)).withColumn("window_start", w)
    out = aggregate(rows, kind, value, (*by, "window_start"))
    return out.withColumn("window_end", F.least(F.col("window_start") + interval, F.lit(end)).cast("long"))


def last_write(df: DataFrame, seq: str = "seq", by: str = "series", ts: str = "ts") -> DataFrame:
    """One point for each (series, ts): the one written last."""
    rest = [c for c in df.columns if c not in (by, ts)]
    best = df.groupBy(by, ts).agg(F.max_by(F.struct(*rest), seq).alias("_v"))
    return best.select(by, ts, *(F.col("_v")[c].alias(c) for c in rest))


def without(df: DataFrame, removed: DataFrame, by: str = "series", ts: str = "ts") -> DataFrame:
    return df.join(removed.select(by, ts), [by, ts], "left_anti")


def bucket(ts: Column, size: int) -> Column:
    """Bucket number by floor division, so times before the epoch have buckets too."""
    return F.call_function("div", ts - F.pmod(ts, F.lit(size)), F.lit(size))


def bucket_start(number: Column, size: int) -> Column:
    return number * size


def keep_since(df: DataFrame, oldest, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) >= oldest)


def keep_age(df: DataFrame, age: int, ts: Column, by: str = "series") -> DataFrame:
    """Points no older than `age` before the newest of their series."""
    newest = df.groupBy(by).agg(F.max(ts).alias("_newest"))
    return df.join(newest, by).filter(ts >= F.col("_newest") - age).drop("_newest")


def keep_last(df: DataFrame, n: int, by: str = "series", ts: str = "ts") -> DataFrame:
    """The n newest points of each series; partitions are cut to n before the shuffle's sort ends (window group limit)."""
    w = Window.partitionBy(by).orderBy(F.col(ts).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def delta(df: DataFrame, value: str, by: str = "series", ts: str = "ts", out: str = "delta") -> DataFrame:
    """First value, then differences."""
    w = Window.partitionBy(by).orderBy(ts)
    return df.withColumn(out, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, delta_col: str = "delta", by: str = "series", pos: str = "pos", out: str = "value") -> DataFrame:
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(delta_col).over(w))


def delta_of_delta(df: DataFrame, value: str, by: str = "series", ts: str = "ts", out: str = "dod") -> DataFrame:
    """The first value, the first difference, then differences of differences."""
    w = Window.partitionBy(by).orderBy(ts)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return df.withColumn(out, F.when(one.isNull(), F.col(value)).when(two.isNull(), F.col(value) - one).otherwise(F.col(value) - 2 * one + two))


def undelta_of_delta(df: DataFrame, dod: str = "dod", by: str = "series", pos: str = "pos", out: str = "value") -> DataFrame:
    """The series again, by two running sums."""
    order = Window.partitionBy(by).orderBy(pos)
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.when(F.row_number().over(order) == 1, F.lit(0)).otherwise(F.col(dod))  # the first value is no difference
    rows = df.withColumn("_first", F.first(dod).over(run)).withColumn("_dod", later).withColumn("_step", F.sum("_dod").over(run))
    return rows.withColumn(out, F.col("_first") + F.sum("_step").over(run)).drop("_dod", "_first", "_step")


def xor_bits(df: DataFrame, value: str = "value", by: str = "series", ts: str = "ts") -> DataFrame:
    """(by, ts, xor): the bits of each double exclusive-or those of the one before (the first as it is)."""
    bits = double_bits(df, value)
    w = Window.partitionBy(by).orderBy(ts)
    return bits.select(by, ts, F.col("_bits").bitwiseXOR(F.coalesce(F.lag("_bits").over(w), F.lit(0).cast("long"))).alias("xor"))


def unxor_bits(df: DataFrame, by: str = "series", ts: str = "ts") -> DataFrame:
    """(by, ts, value) from xor_bits(): a running exclusive-or in a window; batches of bits become doubles."""

    @pandas_udf("double")
    def number(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(dtype="int64").view("float64"))

    w = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(by, ts, number(F.bit_xor("xor").over(w)).alias("value"))


def double_bits(df: DataFrame, value: str = "value") -> DataFrame:
    """df with _bits, the IEEE bits of a double (no built-in gives them)."""
    @pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        return pd.Series(v.to_numpy(dtype="float64").view("int64"))

    return df.withColumn("_bits", bits(F.col(value).cast("double")))


def stats(df: DataFrame, by: str = "series", value: str = "value") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("points"), F.countDistinct(by).alias("series"), F.coalesce(F.sum(F.octet_length(F.col(value).cast("string"))), F.lit(0)).alias("bytes"))
