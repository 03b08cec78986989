"""Stages on disk: tables that are written to the folder which driver and executors share, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on a single machine whose session names no spark.checkpoint.dir, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/vispark"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on a cluster, spark.checkpoint.dir must name it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written and read back: made once, whatever is lost later."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
