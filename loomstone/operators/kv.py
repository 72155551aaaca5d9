"""Ordered key-value tables: scans, seeks, reads, writes, batches and ordered indexes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators.mvcc import newest


def prefix(df: DataFrame, p: str, key: str = "key") -> DataFrame:
    """Keys that start with p, text or bytes."""
    return df.filter(F.startswith(F.col(key), F.lit(p)))


def between(df: DataFrame, low=None, high=None, low_open: bool = False, high_open: bool = True, key: str = "key") -> DataFrame:
    """Keys in a range with open, closed or absent ends; comparisons that Parquet statistics can prune by."""
    if low is not None:
        df = df.filter(F.col(key) > low if low_open else F.col(key) >= low)
    if high is not None:
        df = df.filter(F.col(key) < high if high_open else F.col(key) <= high)
    return df


def scan(df: DataFrame, key: str = "key", reverse: bool = False, first: int | None = None) -> DataFrame:
    """Rows by key; `first` keeps that many, as a top-k and not a sort."""
    out = df.orderBy(F.col(key).desc() if reverse else F.col(key).asc())
    return out if first is None else out.limit(first)


def seek(df: DataFrame, at, key: str = "key") -> DataFrame:
    """The row of the first key at or after `at`."""
    return between(df, low=at, key=key).orderBy(key).limit(1)


def seek_back(df: DataFrame, at, key: str = "key") -> DataFrame:
    """The row of the last key at or before `at`."""
    return between(df, high=at, high_open=False, key=key).orderBy(F.col(key).desc()).limit(1)


def get(df: DataFrame, at, key: str = "key") -> DataFrame:
    return df.filter(F.col(key) == at)


def batch_get(keys: DataFrame, df: DataFrame, key: str = "key") -> DataFrame:
    """A row for each asked key, with nulls where it is absent; the planner picks the join by size."""
    return keys.join(df, key, "left")


def contains(keys: DataFrame, df: DataFrame, key: str = "key") -> DataFrame:
    have = df.select(key).distinct().withColumn("found", F.lit(True))
    return keys.join(have, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def insert_conflicts(df: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """New rows whose key exists already."""
    return new.join(df.select(key), key, "left_semi")


def insert(df: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return df.unionByName(new.join(df.select(key), key, "left_anti"))


def update_misses(df: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    return changes.join(df.select(key), key, "left_anti")


def upsert(df: DataFrame, changes: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The state after changes, with `updated` true where a row was replaced and false where it is new."""
    old, new = df.select(key, F.col(value).alias("_old")), changes.select(key, F.col(value).alias("_new"))
    both = old.withColumn("_had", F.lit(True)).join(new.withColumn("_set", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("_old")).alias(value), F.when(F.col("_set"), F.coalesce("_had", F.lit(False))).alias("updated"))


def delete(df: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def _inside(low=None, high=None, low_open: bool = False, high_open: bool = True, key: str = "key") -> Column:
    out = F.col(key).isNotNull()
    if low is not None:
        out &= F.col(key) > low if low_open else F.col(key) >= low
    if high is not None:
        out &= F.col(key) < high if high_open else F.col(key) <= high
    return out


def range_delete(df: DataFrame, low=None, high=None, low_open: bool = False, high_open: bool = True, key: str = "key") -> DataFrame:
    """df without the keys of a range with open, closed or absent ends; null keys stay."""
    return df.filter(~F.coalesce(_inside(low, high, low_open, high_open, key), F.lit(False)))


def range_count(df: DataFrame, low=None, high=None, low_open: bool = False, high_open: bool = True, key: str = "key") -> DataFrame:
    """(deleted): how many rows range_delete() takes away."""
    return df.agg(F.count_if(_inside(low, high, low_open, high_open, key)).alias("deleted"))


RANGES = 1000  # range deletes that meet the state in one pass


def apply_batch(df: DataFrame, ops: DataFrame) -> DataFrame:
    """The state (key, value) after ops (seq, op, key, value). Of a key the last put or delete counts;
    range_delete takes the keys of [key, value) that were last written before it; merge does nothing.

    Range deletes meet the state RANGES at a time, each time in one broadcast of so many rows.
    """
    base = df.select("key", "value", F.lit("put").alias("op"), F.lit(-1).cast("long").alias("seq"))
    ops = ops.select("key", "value", "op", F.col("seq").cast("long").alias("seq"))
    out = newest(base.unionByName(ops.filter(F.col("op").isin("put", "delete")))).filter(F.col("op") == "put")
    ranges = ops.filter(F.col("op") == "range_delete").select(F.col("key").alias("_low"), F.col("value").alias("_high"), F.col("seq").alias("_at"))
    for k in range(-(-ranges.count() // RANGES)):
        some = ranges.orderBy("_at").offset(k * RANGES).limit(RANGES)
        out = out.join(F.broadcast(some), (F.col("key") >= F.col("_low")) & (F.col("key") < F.col("_high")) & (F.col("seq") < F.col("_at")), "left_anti")
    return out.select("key", "value")


def batch_report(ops: DataFrame) -> DataFrame:
    """attempted, applied, deleted and bytes written of a batch; merges and ranges are attempted, not counted as applied."""
    put, gone = F.col("op") == "put", F.col("op") == "delete"
    return ops.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(put | gone).alias("applied"), F.count_if(gone).alias("deleted"),
        F.coalesce(F.sum(F.when(put, F.octet_length("key") + F.octet_length("value"))), F.lit(0)).cast("long").alias("bytes_written"),
    )


def merge_runs(runs: Sequence[DataFrame], key: str = "key") -> DataFrame:
    """Sorted runs, highest priority first: the first run that has a key decides; tombstones hide it."""
    parts = [r.withColumn("_rank", F.lit(len(runs) - i)) for i, r in enumerate(runs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return newest(out, (key,), "_rank").filter(~F.col("is_deleted")).drop("_rank", "is_deleted")


def run_holds(keys: DataFrame, run: DataFrame, key: str = "key") -> DataFrame:
    """keys with what a sorted run says of each: value, or a tombstone, or nothing."""
    said = run.select(key, F.when(F.col("is_deleted"), "tombstone").otherwise("value").alias("said"))
    return keys.join(said, key, "left").withColumn("said", F.coalesce("said", F.lit("nothing")))


def overlapping(runs: DataFrame, low, high) -> DataFrame:
    """The files (min_key, max_key, ...) of a manifest whose key range meets [low, high]."""
    return runs.filter((F.col("max_key") >= low) & (F.col("min_key") <= high))


@dataclass
class Cursor:
    """A place in the order of a key column. Each move is one top-1 query with a pushed bound, so nothing is
    held open; key and value are null before the first move and past either end."""

    df: DataFrame
    key_name: str = "key"
    value_name: str = "value"
    key: Any = None
    value: Any = None

    def _to(self, found: DataFrame) -> bool:
        row = found.select(self.key_name, self.value_name).first()
        self.key, self.value = (row[0], row[1]) if row else (None, None)
        return row is not None

    def first(self) -> bool:
        return self._to(scan(self.df, self.key_name, first=1))

    def last(self) -> bool:
        return self._to(scan(self.df, self.key_name, reverse=True, first=1))

    def seek(self, at) -> bool:
        """To the first key at or after `at`."""
        return self._to(seek(self.df, at, self.key_name))

    def seek_prev(self, at) -> bool:
        """To the last key at or before `at`."""
        return self._to(seek_back(self.df, at, self.key_name))

    def next(self) -> bool:
        return self.key is not None and self._to(scan(between(self.df, low=self.key, low_open=True, key=self.key_name), self.key_name, first=1))

    def prev(self) -> bool:
        return self.key is not None and self._to(scan(between(self.df, high=self.key, key=self.key_name), self.key_name, reverse=True, first=1))


def index_of(df: DataFrame, entry: Column, primary: str) -> DataFrame:
    """An ordered secondary index: (index_key, primary_key)."""
    return df.select(entry.alias("index_key"), F.col(primary).alias("primary_key"))


def index_lookup(index: DataFrame, df: DataFrame, primary: str, low, high) -> DataFrame:
    """Rows of df whose index key is in [low, high)."""
    hit = between(index, low, high, key="index_key")
    return hit.join(df, hit["primary_key"] == df[primary]).drop("primary_key")


def statistics(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    k, v = F.octet_length(key).cast("long"), F.octet_length(value).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(k).alias("min_key_bytes"), F.max(k).alias("max_key_bytes"), F.round(F.avg(k), 6).alias("avg_key_bytes"),
        F.min(v).alias("min_value_bytes"), F.max(v).alias("max_value_bytes"), F.round(F.avg(v), 6).alias("avg_value_bytes"), F.sum(k + v).alias("total_bytes"),
    )
