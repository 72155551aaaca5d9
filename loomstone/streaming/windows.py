"""Streams over append logs: windowed aggregation with watermarks, sessions, deduplication, last values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators.mvcc import newest


def read_log(spark: SparkSession, path: str, schema, names: str = "*.parquet", files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of a folder whose names match."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(path)


def tumbling(events: DataFrame, size: str, late: str, value: str = "value", by: tuple[str, ...] = (), ts: str = "ts") -> DataFrame:
    """(window_start, window_end, by..., n, total) with events later than `late` left out."""
    w = F.window(ts, size)
    out = events.withWatermark(ts, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, late: str, value: str = "value", ts: str = "ts") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str, by: str, ts: str = "ts") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), by, "n")


def distinct_events(events: DataFrame, key: str, late: str, ts: str = "ts") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def running_last(events: DataFrame, by: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """(by, last_us, last_value) of each batch's keys, with the newest point so far kept as state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (-(2**62), None)
        for b in batches:
            i = b["us"].idxmax()
            if b["us"][i] >= at:
                at, last = int(b["us"][i]), float(b["value"][i])
        state.update((at, last))
        yield pd.DataFrame({by: [key[0]], "last_us": [at], "last_value": [last]})

    kind = events.schema[by].dataType.simpleString()
    rows = events.select(by, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, last_us long, last_value double", "at long, last double", "update", "NoTimeout")


def run_updates(df: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...]) -> DataFrame:
    """All that is there now: each batch writes the windows that it changed as Parquet, under its number, so that a
    batch that runs again takes its own place; the last row of each window counts."""
    _each_batch(df, path, checkpoint, "update")
    return newest(df.sparkSession.read.parquet(path), keys, "batch").drop("batch")


def run_complete(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """As run_updates(), for streams that give all windows in each batch: the last batch counts."""
    last = _each_batch(df, path, checkpoint, "complete")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch={last}")


def _each_batch(df: DataFrame, path: str, checkpoint: str, mode: str) -> int:
    done = [-1]

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done[0] = max(done[0], number)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done[0]


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, into a table in memory (tests and small results)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to(df: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, appended to Parquet exactly once."""
    df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
