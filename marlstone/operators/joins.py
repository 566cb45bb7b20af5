"""Joins with the engine's own rules for duplicates, blanks and missing rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import salted
from ..functions.text import clean, strip


def enrich(scores: DataFrame, metadata: DataFrame, key: str = "sample_id", ord: str = "ord") -> DataFrame:
    """Scores with their metadata, by the trimmed key. Of duplicate metadata the last by ``ord`` holds.

    A score's own column overrides, even blank; only a blank label is repaired.
    """
    own = [c for c in metadata.columns if c not in (key, ord)]
    last = metadata.filter(clean(F.col(key)).isNotNull()).groupBy(strip(F.col(key)).alias("__key")).agg(F.max_by(F.struct(*own), ord).alias("__meta"))
    joined = scores.withColumn("__key", strip(F.col(key))).join(last, "__key", "left")
    label = F.coalesce(clean(F.col("label").cast("string")), F.col("__meta.label").cast("string")) if "label" in own and "label" in scores.columns else None
    kept = [label.alias("label") if c == "label" and label is not None else F.col(c) for c in scores.columns]
    return joined.select(*kept, *[F.col(f"__meta.{c}").alias(c) for c in own if c not in scores.columns])


def score_coverage(scores: DataFrame, expected: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: n_missing, n_duplicate and n_unexpected keys, from one full join of counts."""
    a = scores.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    b = expected.select(F.col(key).alias("k"), F.lit(True).alias("due")).distinct()
    both = a.join(b, "k", "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("n") > 1).alias("n_duplicate"), F.count_if(F.col("due").isNull()).alias("n_unexpected"))


def collect_results(jobs: DataFrame, results: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs with their result's status; ``missing result entry`` where there is none. Of several results the last by ``ord`` holds."""
    last = results.groupBy(key).agg(F.max_by("status", "ord").alias("status"))
    return jobs.join(last, key, "left").withColumn("status", F.coalesce("status", F.lit("missing result entry")))


def parent_value(rows: DataFrame, parents: DataFrame, value: str, out: str) -> DataFrame:
    """A value of each row's parent; the parents are looked up once, not per row."""
    return rows.join(parents.select(F.col("parent_id"), F.col(value).alias(out)).dropDuplicates(["parent_id"]), "parent_id", "left")


def unfinished(rows: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    return rows.join(finished.select(key), key, "left_anti")


def first_of_each(rows: DataFrame, key: str, ord: str) -> DataFrame:
    """The first row of each key by ``ord``."""
    columns = [c for c in rows.columns]
    return rows.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*columns), ord).alias("r")).select("r.*")


def prompt_reference(rows: DataFrame, salt: str, speaker: str = "speaker_id", parent: str = "parent_id") -> DataFrame:
    """(row columns, prompt): another parent of the same speaker, itself if there is none.

    A speaker's parents stand in salted-hash order and each takes its successor,
    the last the first: a window over distinct parents, never pairs of them.
    """
    ring = rows.select(speaker, parent).distinct().withColumn("__h", salted(salt, F.col(parent).cast("string")))
    order = Window.partitionBy(speaker).orderBy("__h", parent)
    following = F.coalesce(F.lead(parent).over(order), F.first(parent).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.join(ring.select(speaker, parent, following.alias("prompt")), [speaker, parent], "left")


def distinct_files(rows: DataFrame, paths: list[str], language: str) -> DataFrame:
    """Distinct (path, language) of several path columns, so that a model sees each file once."""
    return rows.select(F.explode(F.array(*[F.col(p) for p in paths])).alias("path"), language).filter("path is not null").distinct()


def union_named(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that one lacks are blank there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna("")


def missing_names(asked: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """The distinct names that are asked for and not known."""
    return asked.select(name).subtract(known.select(name))
