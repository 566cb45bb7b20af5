"""Binary detection metrics over (keys, score, label) with label text; higher scores mean bonafide.

All take the columns to group by, so that one query serves every run, task or
subgroup. Equal scores are ordered by ``tie`` where order matters (rank sums):
the column ``ord`` where rows have one, as that is the order of the input, else
sample_id. Rows whose label is unknown count in n_samples alone. Ranks and
running sums go by ranges (``ranks``), so a hot key is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import number
from ..functions.text import label_int, strip
from . import ranks


def scored(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """``rows`` with y (1 bonafide, 0 spoof, null unknown) and s (text that isn't a number is 0)."""
    return rows.withColumn("y", label_int(F.col(label))).withColumn("s", F.coalesce(number(F.col(score)), F.lit(0.0)))


def label_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    of = scored(rows)
    return of.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("n_bonafide"), F.count_if(F.col("y") == 0).alias("n_spoof"), F.count_if(F.col("y").isNull()).alias("n_unknown"))


def auc(rows: DataFrame, keys: list[str], tie: str | None = None) -> DataFrame:
    """Rank-sum AUC with ordinal ranks, from 0 to 1; 0 with one class."""
    tie = tie or ("ord" if "ord" in rows.columns else "sample_id")
    known = scored(rows).filter("y is not null")
    ranked = ranks.ranked(known.select(*keys, "s", tie, "y"), keys, ["s", tie])
    sums = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("y") == 1, F.col("rank"))).cast("double").alias("r"), F.count_if(F.col("y") == 1).cast("double").alias("p"), F.count_if(F.col("y") == 0).cast("double").alias("n"))
    value = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))
    return sums.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(0.0).alias("auc"))


def eer(rows: DataFrame, keys: list[str], degenerate: float = 1.0) -> DataFrame:
    """EER and its threshold at the first least |fnr - fpr| along the ROC; ``degenerate`` and 0 with one class.

    The ROC has a point for each distinct score, descending, without points in
    line with their neighbours, and (0, 0) at infinity before. Counts are summed
    per distinct score first, so ties never widen a range.
    """
    known = scored(rows).filter("y is not null")
    steps = known.groupBy(*keys, "s").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f"))
    curve = ranks.running(steps, keys, [F.desc("s")], {"tp": "t", "fp": "f"})
    # a point bends the curve unless the step before and the step after are in line: the last one always does
    bends = F.col("next_t").isNull() | F.col("first") | (F.col("next_t") != F.col("t")) | (F.col("next_f") != F.col("f"))
    corners = curve.filter(bends)
    totals = known.groupBy(*keys).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    start = totals.select(*keys, F.lit(float("inf")).alias("s"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    points = corners.select(*keys, "s", "tp", "fp").unionByName(start)
    rates = join_on(points, totals, keys).withColumn("fnr", 1 - F.col("tp") / F.col("p")).withColumn("fpr", F.col("fp") / F.col("n"))
    best = rates.filter("p > 0 and n > 0").groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), (-F.col("s")).alias("place"), F.col("fpr").alias("fpr"), F.col("fnr").alias("fnr"))).alias("at"))
    value = best.select(*keys, ((F.col("at.fpr") + F.col("at.fnr")) / 2).alias("eer"), (-F.col("at.place")).alias("threshold"))
    return join_on(totals.select(*keys), value, keys, "left").select(*keys, F.coalesce("eer", F.lit(degenerate)).alias("eer"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def eer_or_zero(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``eer``, but 0 with one class or without rows."""
    return eer(rows, keys, 0.0)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` and ``right`` by the keys; without keys ``right`` has one row."""
    if keys:
        return left.join(right, keys, how)
    return left.join(F.broadcast(right), F.lit(True), how)  # one row


def accuracy_f1(rows: DataFrame, keys: list[str], thresholds: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Accuracy and F1 of bonafide at ``threshold``, or at each group's own in ``thresholds`` (keys, threshold)."""
    known = scored(rows).filter("y is not null")
    known = join_on(known, thresholds, keys) if thresholds is not None else known.withColumn("threshold", F.lit(threshold))
    known = known.withColumn("hit", (F.col("s") >= F.col("threshold")).cast("int"))
    sums = known.groupBy(*keys).agg(F.avg((F.col("hit") == F.col("y")).cast("double")).alias("accuracy"), F.sum(F.col("hit") * F.col("y")).alias("tp"), F.sum("hit").alias("said"), F.sum("y").alias("p"))
    return sums.select(*keys, F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.when(F.col("said") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("said") + F.col("p"))).otherwise(0.0).alias("f1"))


def subgroups(rows: DataFrame, groupers: list[str]) -> DataFrame:
    """n, label counts, AUC and EER for every value of each grouper; blank is ``unknown``."""
    named = F.explode(F.array(*[F.struct(F.lit(g).alias("grouper"), F.coalesce(F.nullif(strip(F.col(g).cast("string")), F.lit("")), F.lit("unknown")).alias("value")) for g in groupers]))
    long = rows.select("sample_id", "score", "label", named.alias("g")).select("sample_id", "score", "label", "g.grouper", "g.value")
    keys = ["grouper", "value"]
    counts = label_counts(long, keys).withColumn("n_samples", F.col("n_bonafide") + F.col("n_spoof") + F.col("n_unknown"))
    out = counts.join(auc(long, keys), keys, "left").join(eer_or_zero(long, keys).select(*keys, "eer"), keys, "left")
    return out.select(*keys, "n_samples", "n_bonafide", "n_spoof", F.coalesce("auc", F.lit(0.0)).alias("auc"), F.coalesce("eer", F.lit(0.0)).alias("eer"))


def macro_average(per_variant: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """``per_variant`` and a row ``macro_avg`` of means for each key."""
    mean = per_variant.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics]).withColumn("variant", F.lit("macro_avg"))
    return per_variant.select(*keys, "variant", *metrics).unionByName(mean.select(*keys, "variant", *metrics))
