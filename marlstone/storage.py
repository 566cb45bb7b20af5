"""Tables written between steps of an iterative operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_path(spark, name: str) -> str:
    """A fresh path in the folder that the cluster shares (``spark.checkpoint.dir``); where that is unset, a temporary one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
