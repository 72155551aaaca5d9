"""The folder that driver and executors share, for checkpoints, stream state and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or the context's. One on this machine is made only in local
    mode, where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.getCheckpointDir():
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="loomstone-")
    if named and not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return (named or sc.getCheckpointDir()).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/loomstone-{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint()
