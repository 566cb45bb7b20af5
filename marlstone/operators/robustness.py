"""Robustness of scores under interventions: matched pairs, and lineages as graphs of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..storage import written
from .matching import graph_distances, lineages
from .metrics import scored


def complete_pairs(rows: DataFrame, group: str, *extra: str) -> DataFrame:
    """One row for each group id with exactly two rows of one known label, oriented by sample_id.

    Columns: group, id_l, id_r, s_l, s_r, y and each extra as the left row's value, else the right's, else ``unknown``.
    """
    own = scored(rows).withColumn("group", strip(F.col(group).cast("string"))).filter("group <> ''")
    extras = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in extra]
    # a group keeps two rows and its size, however large it is
    row = F.struct("sample_id", "s", "y", *extras)
    sides = own.groupBy("group").agg(F.min(row).alias("l"), F.max(row).alias("r"), F.count(F.lit(1)).alias("n")).filter("n = 2 and l.y = r.y")
    named = [F.coalesce(F.nullif(strip(F.when(F.col(f"l.{x}") != "", F.col(f"l.{x}")).otherwise(F.col(f"r.{x}"))), F.lit("")), F.lit("unknown")).alias(x) for x in extra]
    return sides.select("group", F.col("l.sample_id").alias("id_l"), F.col("r.sample_id").alias("id_r"), F.col("l.s").alias("s_l"), F.col("r.s").alias("s_r"), F.col("l.y").alias("y"), *named)


def score_iqr(rows: DataFrame) -> DataFrame:
    """One row: the interquartile range of all scores, 0 under two of them."""
    return scored(rows).agg(F.when(F.count(F.lit(1)) >= 2, F.expr("percentile(s, 0.75) - percentile(s, 0.25)")).otherwise(0.0).alias("iqr"))


def pair_robustness(rows: DataFrame, group: str, threshold: float, breakdown: str | None = None) -> DataFrame:
    """One row for all pairs, each label, and each breakdown value.

    scope and value name the row; pairs, consistency, joint_accuracy, risk and
    drift (over the IQR of all scores) are its figures. Without pairs the row
    ``all`` has zeros.
    """
    rows = written(rows.select("sample_id", "score", "label", group, *([breakdown] if breakdown else [])), "paired")  # read for the pairs and for all scores
    iqr = score_iqr(rows)
    pairs = complete_pairs(rows, group, *([breakdown] if breakdown else []))
    hit = lambda s: (F.col(s) >= F.lit(threshold)).cast("int")
    judged = pairs.select(
        (hit("s_l") == hit("s_r")).cast("double").alias("same"), ((hit("s_l") == F.col("y")) & (hit("s_r") == F.col("y"))).cast("double").alias("right"),
        (0.5 * ((hit("s_l") != F.col("y")).cast("double") + (hit("s_r") != F.col("y")).cast("double"))).alias("wrong"), F.abs(F.col("s_l") - F.col("s_r")).alias("moved"),
        F.when(F.col("y") == 1, "bonafide").otherwise("spoof").alias("label"), *([F.col(breakdown).alias("part")] if breakdown else []),
    )
    scopes = [F.struct(F.lit("all").alias("scope"), F.lit("").alias("value")), F.struct(F.lit("label").alias("scope"), F.col("label").alias("value"))]
    if breakdown:
        scopes.append(F.struct(F.lit(breakdown).alias("scope"), F.col("part").alias("value")))
    long = judged.select("*", F.explode(F.array(*scopes)).alias("at"))
    sums = long.groupBy("at.scope", "at.value").agg(F.count(F.lit(1)).alias("pairs"), F.avg("same").alias("consistency"), F.avg("right").alias("joint_accuracy"), F.avg("wrong").alias("risk"), F.avg("moved").alias("moved"))
    whole = rows.sparkSession.createDataFrame([("all", "")], "scope string, value string")
    sums = sums.join(whole, ["scope", "value"], "full").fillna(0).crossJoin(F.broadcast(iqr))  # iqr is one row
    return sums.select("scope", "value", "pairs", "consistency", "joint_accuracy", "risk", (F.col("moved") / F.when(F.col("iqr") > 1e-12, F.col("iqr")).otherwise(1.0)).alias("drift"))


def lineage_radii(rows: DataFrame, threshold: float) -> DataFrame:
    """Per lineage of two rows or more: label, radius (distance of the nearest wrong row, null if none) and reach.

    The reference is the row with the shortest chain, then the least sample_id;
    rows that no edits lead to from it are left out.
    """
    own = written(scored(lineages(rows)).select("lineage", "sample_id", "sig", "s", "y"), "lineages")
    first = own.groupBy("lineage").agg(F.min_by("sig", F.struct(F.size("sig"), "sample_id")).alias("sig"), F.count(F.lit(1)).alias("n")).filter("n >= 2").select("lineage", "sig")
    own = own.join(first.select("lineage"), "lineage", "left_semi")
    distances = graph_distances(own.select("lineage", "sig"), first, ["lineage"])
    placed = own.join(distances, ["lineage", "sig"])
    wrong = (F.col("s") >= F.lit(threshold)).cast("int") != F.col("y")
    return placed.groupBy("lineage").agg(F.max(F.when(F.col("y") == 1, "bonafide").otherwise("spoof")).alias("label"), F.min(F.when(wrong, F.col("distance"))).alias("radius"), F.max("distance").alias("reach"))


def lineage_robustness(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (metric, value): n_lineages, mean_radius, mean_radius_capped, aurc_chain, robust_at_k and means by label."""
    radii = lineage_radii(rows, threshold)
    top = radii.agg(F.coalesce(F.max("reach"), F.lit(0)).alias("top"))
    capped = radii.crossJoin(F.broadcast(top)).withColumn("capped", F.coalesce(F.col("radius"), F.col("top") + 1))  # top is one row
    at_k = capped.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("k"), (F.col("radius").isNull() | (F.col("radius") > F.col("k"))).cast("double").alias("ok")).groupBy("k").agg(F.avg("ok").alias("value"))
    whole = capped.agg(F.count(F.lit(1)).cast("double").alias("n_lineages"), F.coalesce(F.avg("radius"), F.lit(0.0)).alias("mean_radius"), F.coalesce(F.avg("capped"), F.lit(0.0)).alias("mean_radius_capped"))
    out = whole.unpivot([], ["n_lineages", "mean_radius", "mean_radius_capped"], "metric", "value")
    out = out.unionByName(at_k.agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("value")).select(F.lit("aurc_chain").alias("metric"), "value"))
    out = out.unionByName(at_k.select(F.concat(F.lit("robust_at_"), F.col("k").cast("string")).alias("metric"), "value"))
    return out.unionByName(capped.groupBy("label").agg(F.avg("capped").alias("value")).select(F.concat(F.lit("mean_radius_"), F.col("label")).alias("metric"), "value"))
