"""Versions, snapshots and write-ahead logs as append-only change logs.

A change log has the columns key, value, is_deleted, txn_id, commit_lsn (null until committed) and seq
(the order of versions of a key). Readers see, for each key, the newest version visible to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_SCHEMA = "key string, value string, is_deleted boolean, txn_id long, commit_lsn long, seq long"


def sees(lsn: int | Column, active: Sequence[int] = (), own: int | None = None) -> Column:
    """Whether a version is visible at lsn (inclusive), past active transactions; own writes always are."""
    ok = F.col("commit_lsn").isNotNull() & (F.col("commit_lsn") <= lsn)
    if active:
        ok &= ~F.col("txn_id").isin(*active)
    return ok | (F.col("txn_id") == own) if own is not None else ok


def newest(log: DataFrame, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """The last version of each key: one aggregation with partial maxima, no sort of whole histories."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
    return best.select(*keys, *(F.col("_v")[c].alias(c) for c in rest))


def visible(log: DataFrame, lsn: int, active: Sequence[int] = (), own: int | None = None, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The state at lsn: newest visible versions without tombstones."""
    return newest(log.filter(sees(lsn, active, own)), keys).filter(~F.col("is_deleted"))


def history(log: DataFrame) -> DataFrame:
    """Each committed version with the LSN at which the next one replaces it."""
    w = Window.partitionBy("key").orderBy("seq")
    done = log.filter("commit_lsn IS NOT NULL")
    return done.withColumn("replaced_lsn", F.lead("commit_lsn").over(w))


def vacuum(log: DataFrame, watermark: int, keys: Sequence[str] = ("key",)) -> DataFrame:
    """What vacuum keeps: uncommitted versions, those at or past the watermark, and the newest below it."""
    old = F.col("commit_lsn") < watermark
    last = log.filter(old).groupBy(*keys).agg(F.max("seq").alias("_last"))
    return log.join(last, list(keys), "left").filter(F.col("commit_lsn").isNull() | ~old | (F.col("seq") == F.col("_last"))).drop("_last")


def verify(log: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """(problem, n) of a change log: versions of a key with one place, without a place, and without a transaction."""
    twice = log.groupBy(*keys, "seq").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").agg(F.lit("repeated seq").alias("problem"), F.count(F.lit(1)).alias("n"))
    each = log.agg(F.count_if(F.col("seq").isNull()).alias("no seq"), F.count_if(F.col("txn_id").isNull()).alias("no transaction"))
    return twice.unionByName(each.unpivot([], ["no seq", "no transaction"], "problem", "n"))


def commit(log: DataFrame, txn_id: int, lsn: int) -> DataFrame:
    """log with the transaction's versions published at lsn."""
    mine = (F.col("txn_id") == txn_id) & F.col("commit_lsn").isNull()
    return log.withColumn("commit_lsn", F.when(mine, F.lit(lsn).cast("long")).otherwise(F.col("commit_lsn")))


def rollback(log: DataFrame, txn_id: int) -> DataFrame:
    return log.filter(~((F.col("txn_id") == txn_id) & F.col("commit_lsn").isNull()))


def write_conflicts(locks: DataFrame) -> DataFrame:
    """(table_id, key, holder, loser) of locks (table_id, key, txn_id, start, finish): of overlapping
    transactions on a key, the first to lock holds it. A running maximum finds the holder: no self-join."""
    w = Window.partitionBy("table_id", "key").orderBy("start", "txn_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    held = locks.withColumn("_held", F.max(F.struct("finish", "txn_id")).over(before))
    return held.filter(F.col("_held.finish") > F.col("start")).select("table_id", "key", F.col("_held.txn_id").alias("holder"), F.col("txn_id").alias("loser"))


def read_conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn_id, key, writer): keys that a transaction read and another committed between its start and end."""
    r, w = reads.alias("r"), writes.alias("w")
    ok = (F.col("r.key") == F.col("w.key")) & (F.col("r.txn_id") != F.col("w.txn_id")) & (F.col("w.commit_lsn") > F.col("r.begin_lsn")) & (F.col("w.commit_lsn") <= F.col("r.end_lsn"))
    return r.join(w, ok).select(F.col("r.txn_id").alias("txn_id"), F.col("r.key").alias("key"), F.col("w.txn_id").alias("writer"))


def replay(records: DataFrame) -> DataFrame:
    """Write records of transactions that have a commit record, in LSN order."""
    done = records.filter(F.col("kind") == "commit").select("txn_id").distinct()
    return records.filter(F.col("kind") == "write").join(done, "txn_id", "left_semi")


def still_active(records: DataFrame) -> DataFrame:
    """Transactions that began and neither committed nor rolled back."""
    ended = records.filter(F.col("kind").isin("commit", "rollback")).select("txn_id").distinct()
    return records.filter(F.col("kind") == "begin").select("txn_id").distinct().join(ended, "txn_id", "left_anti")


def from_lsn(records: DataFrame, lsn: int) -> DataFrame:
    return records.filter(F.col("lsn") >= lsn)
