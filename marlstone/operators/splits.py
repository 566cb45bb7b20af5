"""Splits, ids and assignments over speakers, parents and generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import salted
from . import ranks

#: Split shares in their order.
SHARES = [("train", 0.70), ("dev", 0.15), ("test", 0.15)]


def apportion(totals: DataFrame, keys: list[str], total: str, shares: list[tuple[str, float]] = SHARES) -> DataFrame:
    """(keys, split, n): largest remainders, ties in the order of ``shares``; one row in, one per share out."""
    part = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(s).alias("split"), F.lit(float(r)).alias("ratio")) for k, (s, r) in enumerate(shares)]))
    long = totals.select(*keys, F.col(total).alias("total"), part.alias("p")).select(*keys, "total", "p.place", "p.split", (F.col("total") * F.col("p.ratio")).alias("exact"))
    long = long.withColumn("base", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("base"), 9))
    whole = Window.partitionBy(*keys)
    left = F.col("total") - F.sum("base").over(whole)
    return long.withColumn("left", left).withColumn("r", F.row_number().over(whole.orderBy(F.desc("rest"), "place"))).select(*keys, "split", (F.col("base") + (F.col("r") <= F.col("left")).cast("long")).alias("n"))


def assign_splits(speakers: DataFrame, language: str, speaker: str, salt: str, shares: list[tuple[str, float]] = SHARES) -> DataFrame:
    """Speakers of a language in salted-hash order, cut at the apportioned counts."""
    counts = apportion(speakers.groupBy(language).agg(F.count(F.lit(1)).alias("total")), [language], "total", shares)
    ends = Window.partitionBy(language).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    order = F.create_map(*[F.lit(x) for k, (s, _) in enumerate(shares) for x in (s, k)])
    cuts = counts.withColumn("place", order[F.col("split")]).withColumn("upto", F.sum("n").over(ends)).groupBy(language).agg(F.sort_array(F.collect_list(F.struct("place", "upto", "split"))).alias("cuts"))
    ranked = ranks.ranked(speakers.select(language, speaker, salted(salt, F.col(speaker).cast("string")).alias("__h")), [language], ["__h", speaker], "r")
    return ranked.join(cuts, language).select(language, speaker, F.get(F.filter("cuts", lambda c: F.col("r") <= c["upto"]), F.lit(0))["split"].alias("split"))


def dense_ids(rows: DataFrame, group: str, source: str, prefix: str) -> DataFrame:
    """(group, source, id): prefix, group and a four-digit number over the sorted sources."""
    numbered = ranks.ranked(rows.select(group, source).distinct(), [group], [source], "__r")
    return numbered.select(group, source, F.format_string(f"{prefix}_%s_%04d", F.col(group), F.col("__r")).alias("id"))


def round_robin(rows: DataFrame, token: str, names: list[str], per_row: int, salt: str) -> DataFrame:
    """(token, name): each row gets ``per_row`` of ``names``, loads as even as can be.

    Rows in salted-hash order; the rank is a place in its range plus the sizes of the ranges before, so no task sees all rows.
    """
    ranked = ranks.ranked(rows.select(F.col(token), salted(salt, F.col(token).cast("string")).alias("__h")), [], ["__h", token], "__r").withColumn("__r", F.col("__r") - 1)
    pick = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.get(F.array(*map(F.lit, names)), ((F.col("__r") * per_row + i) % len(names)).cast("int")))
    return ranked.select(token, F.explode(pick).alias("name"))


def curate(candidates: DataFrame, speaker: str, keep: int, least: int, band: tuple[float, float]) -> DataFrame:
    """Of each speaker's accepted candidates the best ``keep``; speakers with fewer than ``least`` go.

    Candidates need duration, speech_ratio, mean_db, sample_id. Best: inside the
    duration band by nearness to its centre, else by how far outside; then more
    speech, loudness near -20 dB, id.
    """
    low, high = band
    inside = F.col("duration").between(low, high)
    near = F.when(inside, F.abs(F.col("duration") - (low + high) / 2)).otherwise(F.greatest(low - F.col("duration"), F.col("duration") - high))
    keyed = candidates.withColumn("__o", F.struct(F.when(inside, 0).otherwise(1).alias("a"), near.alias("b"), (-F.col("speech_ratio")).alias("c"), F.abs(F.col("mean_db") + 20).alias("d"), F.col("sample_id").alias("e")))
    ranked = ranks.ranked(keyed, [speaker], ["__o"], "place", "__all_rows")
    return ranked.filter((F.col("__all_rows") >= least) & (F.col("place") <= keep)).drop("__all_rows", "__o")


def spread(rows: DataFrame, order: str, names: list[str], out: str) -> DataFrame:
    """``rows`` with ``names`` in turn, in their order."""
    ranked = ranks.ranked(rows, [], [order], "__r")
    return ranked.withColumn(out, F.get(F.array(*map(F.lit, names)), ((F.col("__r") - 1) % len(names)).cast("int"))).drop("__r")


def in_position(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their 1-based position in a total order: how a manifest is listed."""
    return ranks.ranked(rows, [], order, "position")


#: The orders in which manifests are listed.
ORDERS = {
    "deliveries": ["chain_family", "language", "split", "speaker_id", "sample_id"],
    "dataset": ["language", "split", "speaker_id", "sample_id"],
    "sources": ["language", "split", "speaker_id", "utterance_id"],
    "generated": ["language", "split", "speaker_id", "sample_id"],
}
