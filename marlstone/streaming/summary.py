"""Chunked analysis with resume: a file stream that takes what is new and stops.

The stream's checkpoint is the resume file: a run that is stopped goes on where
it was. A folder that was begun with other arguments is refused, so that results
never mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.states import fingerprint
from ..sources.writers import read_text
from ..storage import shared_path


def stream_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Append all new rows of a stream to Parquet files, once each."""
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def claimed(spark: SparkSession, root: str, **arguments) -> str:
    """``root``, which from now on belongs to these arguments; an error if it belongs to others."""
    known, now = read_text(spark, f"{root}/arguments"), fingerprint(**arguments)
    if known and known != [now]:
        raise ValueError(f"{root} was begun with other arguments")
    if not known:
        spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/arguments")
    return root


def analyse(spark: SparkSession, folder: str, pattern: str, per_row: Callable[[DataFrame], DataFrame], summary: Callable[[DataFrame], DataFrame], root: str | None = None, **arguments) -> DataFrame:
    """``summary`` of ``per_row`` over all files; equal to the batch result, with per-row results kept under ``root`` for the next run."""
    base = claimed(spark, root or shared_path(spark, "stream"), pattern=pattern, **arguments)
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    rows = per_row(stream_files(spark, folder, pattern, schema))
    run_available(rows, f"{base}/rows", f"{base}/checkpoint")
    return summary(spark.read.schema(rows.schema).parquet(f"{base}/rows"))


def publish(rows: DataFrame, snapshot: str, checkpoint: str, summary: Callable[[DataFrame], DataFrame]) -> None:
    """After each batch of a stream, ``summary`` of all rows so far, written as a new snapshot; ``latest`` reads the last one.

    A batch that is run again writes its rows and its snapshot once more, to the
    same place, so a reader never sees half of one or a row twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{snapshot}/rows/batch={number}")
        known = spark.read.schema(batch.schema).parquet(f"{snapshot}/rows")
        summary(known.drop("batch")).write.mode("overwrite").parquet(f"{snapshot}/snapshots/batch={number}")

    rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, snapshot: str) -> DataFrame:
    """The last snapshot that ``publish`` has written."""
    every = spark.read.parquet(f"{snapshot}/snapshots")
    return every.join(every.agg({"batch": "max"}).withColumnRenamed("max(batch)", "batch"), "batch", "left_semi").drop("batch")
