"""A write-ahead log as an append-only Parquet dataset: records (lsn, txn_id, kind, table_id, op, key, value).

Each append is one batch with consecutive LSNs, dealt without a global sort: a batch's rows are numbered
by their order column. Readers use the functions of `operators.mvcc` (replay, still_active, from_lsn).
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Record kinds and write operations.
KINDS = ("begin", "write", "commit", "rollback", "prepare", "checkpoint")
OPERATIONS = (
    "put", "delete", "range_delete", "merge", "bloom_insert", "vector_insert", "vector_delete", "edge_insert", "edge_delete", "point_append",
    "geometry_insert", "geometry_delete", "document_index", "document_delete",
)
SCHEMA = "lsn long, txn_id long, kind string, table_id int, op string, key string, value string"


class Locked(RuntimeError):
    """Another writer has the log."""


@dataclass
class Wal:
    spark: SparkSession
    path: str
    next_lsn: int = 1

    def _lock(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_writer")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def close(self) -> None:
        """Lets another writer have the log."""
        fs, path = self._lock()
        fs.delete(path, False)
        self.next_lsn = 0

    @staticmethod
    def open(spark: SparkSession, path: str, take_over: bool = False) -> Wal:
        """A log that continues after the last record found. One writer has it until close(); take_over: of a
        writer that is known to have died."""
        log = Wal(spark, path)
        fs, lock = log._lock()
        if take_over:
            fs.delete(lock, False)
        try:
            fs.create(lock, False).close()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or "already exists" in str(e.java_exception):
                raise Locked(path) from None
            raise
        try:
            last = log.records().agg(F.max("lsn")).first()[0]
        except AnalysisException as e:  # a folder that does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        log.next_lsn = (last or 0) + 1
        return log

    def records(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _mark(self, txn_id: int | None, kind: str) -> int:
        if not self.next_lsn:
            raise Locked("the log was closed")
        lsn = self.next_lsn
        self.spark.createDataFrame([(lsn, txn_id, kind, None, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.next_lsn += 1
        return lsn

    def begin(self, txn_id: int) -> int:
        return self._mark(txn_id, "begin")

    def commit(self, txn_id: int) -> int:
        return self._mark(txn_id, "commit")

    def rollback(self, txn_id: int) -> int:
        return self._mark(txn_id, "rollback")

    def prepare(self, txn_id: int) -> int:
        return self._mark(txn_id, "prepare")

    def checkpoint(self) -> int:
        return self._mark(None, "checkpoint")

    def write(self, txn_id: int, table_id: int, op: str, rows: DataFrame) -> int:
        """Appends rows (n, key, value), n from 0 without gaps; gives the first LSN. The rows are counted while they
        are written, and the log goes on after the largest n."""
        if op not in OPERATIONS:
            raise ValueError(f"unknown operation {op}")
        if not self.next_lsn:
            raise Locked("the log was closed")
        first = self.next_lsn
        out = rows.select(
            (F.col("n") + first).cast("long").alias("lsn"), F.lit(txn_id).cast("long").alias("txn_id"), F.lit("write").alias("kind"), F.lit(table_id).cast("int").alias("table_id"),
            F.lit(op).alias("op"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        )
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("n"), F.max("lsn").alias("last")).write.mode("append").parquet(self.path)
        got = seen.get
        if got["n"]:
            self.next_lsn = got["last"] + 1
            if got["n"] != self.next_lsn - first:
                raise ValueError("the rows are not numbered from 0 without gaps")
        return first

    def truncated(self, lsn: int) -> DataFrame:
        """The records that truncation up to lsn would keep."""
        return self.records().filter(F.col("lsn") >= lsn)
