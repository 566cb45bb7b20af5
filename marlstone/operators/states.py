"""Work that is kept between runs: cached rows, shards, training results, metrics that are still fresh."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import finished_rows
from ..storage import written
from .joins import unfinished


def state_path(root: str, name: str, shards: int = 1, shard: int = 0) -> str:
    """Where a shard keeps ``name``; a run of one shard has no number."""
    if shards < 1 or not 0 <= shard < shards:
        raise ValueError(f"there is no shard {shard} of {shards}")
    return f"{root.rstrip('/')}/{name}" + (f".shard{shard:02d}of{shards:02d}" if shards > 1 else "")


def fingerprint(**arguments) -> str:
    """Names a run by all that its result depends on."""
    return hashlib.sha256(json.dumps(arguments, sort_keys=True, default=str).encode()).hexdigest()


class RowCache:
    """Result rows under a path, appended batch by batch; a run with other arguments than those it was begun with is refused."""

    def __init__(self, spark: SparkSession, path: str, schema: str, **arguments):
        self.spark, self.path, self.schema = spark, path, schema
        known, now = self._known(), fingerprint(**arguments)
        if known and known != [now]:
            raise ValueError(f"{path} was begun with other arguments")
        if not known:
            spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/arguments")

    def _known(self) -> list[str]:
        from ..sources.writers import read_text

        return read_text(self.spark, f"{self.path}/arguments")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/rows")

    def rows(self, keys: list[str], ord: str) -> DataFrame:
        """What is kept, once for each key: the first by ``ord``, as a batch may have been written again."""
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.createDataFrame([], self.schema)
        return finished_rows(self.spark.read.schema(self.schema).parquet(f"{self.path}/rows"), keys, ord)

    def missing(self, rows: DataFrame, key: str, ord: str) -> DataFrame:
        """Those of ``rows`` that aren't kept yet."""
        return unfinished(rows, self.rows([key], ord).select(key), key)


def merged_shards(parts: list[DataFrame], keys: list[str], ord: str) -> DataFrame:
    """The rows of all shards, once for each key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return finished_rows(out, keys, ord)


def training_key(config: dict, packs: DataFrame) -> DataFrame:
    """(task_id, variant, training_key): names a training by its configuration and its rows, so that packs which share both share its result.

    The rows' part is a sum of their hashes, so it neither depends on their order nor needs them in one place.
    """
    rows = packs.filter("split in ('train', 'dev')")
    part = lambda k: F.sum(F.conv(F.substring(F.sha1(F.concat_ws("\0", "split", "sample_id")), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    data = rows.groupBy("task_id", "variant").agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"d{k}") for k in range(4)])
    return data.select("task_id", "variant", F.sha1(F.concat_ws("\0", F.lit(fingerprint(config=config)), F.col("n").cast("string"), *[f"d{k}" for k in range(4)])).alias("training_key"))


def refreshed(known: DataFrame, scores: DataFrame, keys: list[str], compute) -> DataFrame:
    """Metrics of all runs: those of ``known`` (keys, digest, ...) whose scores have the same digest stay, the others are computed by ``compute(scores)``.

    What scores hold tells whether they are the same, not when they were written.
    """
    part = lambda k: F.sum(F.conv(F.substring(F.sha1(F.concat_ws("\0", "sample_id", F.col("score").cast("string"))), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    scores = written(scores, "scores")  # read for the digests and several times by what computes
    now = written(scores.groupBy(*keys).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), part(0), part(1)).alias("digest")), "digests")
    fresh = known.join(now, [*keys, "digest"], "left_semi")
    stale = now.join(fresh, keys, "left_anti")
    made = compute(scores.join(stale.select(*keys), keys, "left_semi")).join(now, keys)
    return fresh.select(*made.columns).unionByName(made)
