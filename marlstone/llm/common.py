"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local temporary folder stands in on a local master
    (tests on one machine); on a cluster, whose machines don't share one, it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/marlstone/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a persisted frame the copy outlives executors, and its plan holds
    only a scan, so that later joins know its size.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` if it is a plain scan of Parquet files, else a copy that is."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    if plan.nodeName() == "LogicalRelation" and str(plan.relation().getClass().getSimpleName()) == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
        return docs
    return store(docs, name)


def keyed(docs: DataFrame, name: str, key: str = "__key") -> DataFrame:
    """``docs`` with a column ``key`` that tells its rows apart and is the same whenever and wherever they are read.

    It is a row's file and place there. A running number of partitions and rows
    wouldn't do: another frame's partitions, and even a scan's, may change from
    one reading to the next, as when executors come and go.
    """
    return scanned(docs, name).select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias(key))


def shielded(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions that return the columns they get: names that begin with __ are others while they run, so that none clashes with their own."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = [f"held {k} {c}" if c.startswith("__") else c for k, c in enumerate(docs.columns)]
        if names == docs.columns:
            return f(docs, *args, **kwargs)
        return f(docs.toDF(*names), *args, **kwargs).toDF(*docs.columns)

    return run


def forget(*frames: DataFrame) -> None:
    """Delete the files under frames made by ``store`` that nothing needs any more."""
    for df in frames:
        for file in df.inputFiles()[:1]:
            drop_path(df.sparkSession, file.rpartition("/")[0])


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def held_out() -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
