"""Tables that are computed once and kept in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. A session without it (tests, one machine) gets a
    temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, checkpointed: later reads survive lost executors, and plans that refer to it twice don't grow."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def let_go(spark: SparkSession) -> None:
    """A hint to drop what earlier steps left and nothing refers to: the shuffle files and checkpoints go, and the driver's
    memory is given back, only as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
