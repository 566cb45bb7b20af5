"""Metrics of whole runs: thresholds, base metrics, what a task's profile adds, and runs of many packs at once.

A run is a (task_id, variant, baseline). Base metrics of all runs are one keyed
query; pair and lineage metrics are composed for one run at a time, with the
run's threshold as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from ..storage import written
from . import joins, metrics, robustness
from .splits import spread

#: Profile -> the column of its pairs, the column it breaks them down by, and that breakdown's name.
PROFILES = {
    "operator_substitution": ("operator_substitution_group_id", "operator_substitution_detail", "by_substitution_pattern"),
    "parameter_perturbation": ("parameter_perturbation_group_id", "parameter_perturbation_axis", "by_axis"),
    "order_swap": ("order_swap_group_id", None, None),
    "minimal_order_swap": ("order_swap_group_id", None, None),
}
#: The figures of pairs.
PAIR_FIGURES = {"pairs": "pair_count", "consistency": "pair_consistency_rate", "joint_accuracy": "pair_joint_accuracy", "risk": "pair_symmetric_misclassification_risk", "drift": "mean_normalized_score_drift"}


def _roc(own: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bonafide, n_spoof, n_samples, eer, threshold) of scored rows; eer is 1 and threshold 0 with one class, null without known labels."""
    counts = metrics.label_counts(own, keys).withColumn("n_samples", F.col("n_bonafide") + F.col("n_spoof") + F.col("n_unknown")).drop("n_unknown")
    return metrics.join_on(counts, metrics.eer(own, keys), keys, "left")


def _two_classes() -> Column:
    return (F.col("n_bonafide") > 0) & (F.col("n_spoof") > 0)


def _calibrated() -> Column:
    return F.when(F.col("n_bonafide") + F.col("n_spoof") > 0, F.col("threshold")).otherwise(0.5)


def thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calibrated, paired): the threshold of the EER (0.5 without scored rows, 0 with one class), and that of pairs (0.5 in both cases)."""
    return _roc(rows, keys).select(*keys, _calibrated().alias("calibrated"), F.when(_two_classes(), _calibrated()).otherwise(0.5).alias("paired"))


def base_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eer, auc, accuracy, f1, calibrated_threshold, n_samples) of scores with labels; rows of unknown label count in n_samples alone."""
    own = written(rows.select(*keys, *[c for c in ("sample_id", "ord", "score", "label") if c in rows.columns]), "scores")  # several metrics read them
    roc = written(_roc(own, keys), "roc")
    at = roc.select(*keys, _calibrated().alias("threshold"))
    out = roc.select(*keys, F.when(_two_classes(), F.col("eer")).otherwise(0.0).alias("eer"), _calibrated().alias("calibrated_threshold"), "n_samples")
    for part in (metrics.auc(own, keys), metrics.accuracy_f1(own, keys, at)):
        out = metrics.join_on(out, part, keys, "left")
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("eer", "auc", "accuracy", "f1")], "calibrated_threshold", "n_samples")


def names_of_pairs(profile: str) -> dict[str, str]:
    """A pair figure's column under a profile; swaps have no prefix but for their count and their labels."""
    if profile in ("order_swap", "minimal_order_swap"):
        return {k: (f"order_swap_{v}" if k == "pairs" else v) for k, v in PAIR_FIGURES.items()} | {"label": "order_swap_robustness_by_label"}
    return {k: f"{profile}_{v}" for k, v in PAIR_FIGURES.items()} | {"label": f"{profile}_pair_robustness_by_label", "breakdown": f"{profile}_pair_robustness_{PROFILES[profile][2]}"}


def run_metrics(scores: DataFrame, profile: str = "binary") -> DataFrame:
    """All metrics of one run as rows (metric, part, value): base metrics, the profile's, and subgroups where columns for them are there.

    ``scores`` are enriched: labels, and the profile's group columns or sig, are in them.
    """
    base = base_metrics(scores, [])
    out = _long(base.withColumn("n_samples", F.col("n_samples").cast("double")), ["eer", "auc", "accuracy", "f1", "calibrated_threshold", "n_samples"])
    if profile in PROFILES or profile == "delivery_robustness":
        threshold = thresholds(scores, []).first()["paired"]  # one number
        if profile == "delivery_robustness":
            out = out.unionByName(robustness.lineage_robustness(scores, threshold).select("metric", F.lit("").alias("part"), "value"))
        else:
            group, detail, _ = PROFILES[profile]
            names = names_of_pairs(profile)
            pairs = robustness.pair_robustness(scores, group, threshold, detail).withColumn("pairs", F.col("pairs").cast("double"))
            whole = _long(pairs.filter("scope = 'all'"), list(PAIR_FIGURES), names)
            parts = pairs.filter("scope <> 'all'").select(F.when(F.col("scope") == "label", names["label"]).otherwise(F.lit(names.get("breakdown"))).alias("under"), *["value", *PAIR_FIGURES])
            parts = parts.unpivot(["under", "value"], ["pairs", "consistency", "joint_accuracy"], "figure", "v").select(F.concat_ws(".", "under", "figure").alias("metric"), F.col("value").alias("part"), F.col("v").alias("value"))
            out = out.unionByName(whole).unionByName(parts)
    groupers = [c for c in ("chain_template_id", "chain_length", "language", "generator_family") if c in scores.columns]
    if groupers:
        sub = metrics.subgroups(scores, groupers).select(F.concat(F.lit("subgroup."), "grouper").alias("under"), "value", *[F.col(c).cast("double") for c in ("n_samples", "auc", "eer")])
        out = out.unionByName(sub.unpivot(["under", "value"], ["n_samples", "auc", "eer"], "figure", "v").select(F.concat_ws(".", "under", "figure").alias("metric"), F.col("value").alias("part"), F.col("v").alias("value")))
    return out


def _long(row: DataFrame, columns: list[str], names: dict[str, str] | None = None) -> DataFrame:
    names = names or {}
    return row.select(*[F.col(c).alias(names.get(c, c)) for c in columns]).unpivot([], [names.get(c, c) for c in columns], "metric", "value").select("metric", F.lit("").alias("part"), "value")


def checked_coverage(scores: DataFrame, expected: DataFrame, key: str = "sample_id") -> DataFrame:
    """``scores``, or an error if keys are missing, double or not expected; blank keys aren't looked at, and nothing is checked where nothing is expected."""
    named = lambda rows: rows.select(clean(F.col(key).cast("string")).alias(key)).filter(F.col(key).isNotNull())
    due = named(expected)
    if due.isEmpty():
        return scores
    n = joins.score_coverage(named(scores), due).first()
    if n["n_missing"] or n["n_duplicate"] or n["n_unexpected"]:
        raise ValueError(f"scores don't cover their pack: missing={n['n_missing']} duplicate={n['n_duplicate']} unexpected={n['n_unexpected']}")
    return scores


def label_map(scores: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """``scores`` with blank labels filled from ``labels`` (key, label, ord): the last of a key holds."""
    last = labels.filter(clean(F.col(key)).isNotNull()).groupBy(clean(F.col(key)).alias("__key")).agg(F.max_by("label", "ord").alias("__label"))
    joined = scores.withColumn("__key", clean(F.col(key))).join(last, "__key", "left")
    label = F.coalesce(clean(F.col("label")), F.col("__label"), F.col("label"))
    return joined.select(*[label.alias("label") if c == "label" else F.col(c) for c in scores.columns])


def runs_of(packs: DataFrame, baselines: list[str]) -> DataFrame:
    """(task_id, variant, baseline): every pack with every baseline, a short list."""
    named = F.explode(F.array(*map(F.lit, baselines))).alias("baseline")
    return packs.select("task_id", "variant").distinct().select("task_id", "variant", named)


def metrics_of_runs(scores: DataFrame, packs: DataFrame, labels: DataFrame) -> DataFrame:
    """Base metrics of every run: ``scores`` (task_id, variant, baseline, sample_id, score) of the packs' test rows, with labels by sample_id."""
    test = packs.filter("split = 'test'").select("task_id", "variant", "sample_id")
    met = scores.join(test, ["task_id", "variant", "sample_id"], "left_semi").join(labels.select("sample_id", "label"), "sample_id", "left")
    return base_metrics(met, ["task_id", "variant", "baseline"])


def with_macro(per_run: DataFrame, task: str = "in_chain_detection") -> DataFrame:
    """Runs and, for each baseline, the mean of EER and AUC over the variants of ``task``."""
    own = per_run.select("task_id", "variant", "baseline", "eer", "auc")
    mean = own.filter(F.col("task_id") == task).groupBy("baseline").agg(F.avg("eer").alias("eer"), F.avg("auc").alias("auc"))
    return own.unionByName(mean.select(F.lit(task).alias("task_id"), F.lit("macro_avg").alias("variant"), "baseline", "eer", "auc"))


def on_devices(jobs: DataFrame, devices: list[str], order: str = "ord", sticky: str = "training_key") -> DataFrame:
    """Jobs with a device each, in turn; jobs of one training key stay on the device of the first of them.

    Keys in the order of their first job take the devices in turn, as do jobs
    without a key, each as a key of its own.
    """
    keyed = jobs.withColumn("__key", F.coalesce(F.concat(F.lit("k"), F.col(sticky)), F.concat(F.lit("j"), F.col(order).cast("string"))))
    firsts = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return keyed.join(spread(firsts, "__first", devices, "device").select("__key", "device"), "__key").drop("__key")
