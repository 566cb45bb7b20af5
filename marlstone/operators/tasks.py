"""Task packs: long tables (task_id, variant, split, sample_id), one row for each use of a row.

Rows need sample_id, split, chain_family, chain_template_id, label, ord; the
intervention tasks also the columns that ``matching.annotate`` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import salted
from ..functions.text import fold_name
from ..storage import written
from . import ranks
from .robustness import complete_pairs

#: The families that tasks know.
FAMILIES = ["direct", "platform_like", "telephony", "simreplay", "hybrid"]
PACK = ["task_id", "variant", "split", "sample_id"]
#: A row's order, which packs carry on from rows that have it under this name, so that packs which are cut meet no rows again.
PLACE = "__place"


def _carried(rows: DataFrame) -> list[str]:
    return [PLACE] if PLACE in rows.columns else []


def _usable(pack: DataFrame) -> DataFrame:
    """Variants that have train and test rows."""
    whole = pack.groupBy("task_id", "variant").agg(F.count_if(F.col("split") == "train").alias("a"), F.count_if(F.col("split") == "test").alias("b")).filter("a > 0 and b > 0")
    return pack.join(F.broadcast(whole.select("task_id", "variant")), ["task_id", "variant"], "left_semi")  # a row per variant


def supported(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("chain_family").isin(FAMILIES) & F.col("split").isin("train", "dev", "test"))


def in_chain(rows: DataFrame) -> DataFrame:
    """A variant for each family."""
    return _usable(supported(rows).select(F.lit("in_chain_detection").alias("task_id"), F.col("chain_family").alias("variant"), "split", "sample_id", *_carried(rows)))


def template_holdout(rows: DataFrame, dev_share: float = 0.1) -> DataFrame:
    """A fold for each template of a family: it is the test, the others' train and dev rows train.

    A fold without dev rows takes a tenth of its train rows (at least one, one
    stays), by salted hash. Rows meet folds through their family's few templates;
    what a fold holds follows from the counts of templates, so rows meet no rows.
    """
    own = written(supported(rows).select("chain_family", "chain_template_id", "split", "sample_id", *_carried(rows)), "holdout")
    counts = own.groupBy("chain_family", "chain_template_id", "split").agg(F.count(F.lit(1)).alias("n"))
    folds = counts.select("chain_family", F.col("chain_template_id").alias("held")).distinct()
    several = folds.groupBy("chain_family").agg(F.count(F.lit(1)).alias("t")).filter("t > 1").select("chain_family")
    test, rest = (F.col("chain_template_id") == F.col("held")) & (F.col("split") == "test"), (F.col("chain_template_id") != F.col("held")) & (F.col("split") != "test")
    named = folds.join(several, "chain_family", "left_semi").withColumn("variant", fold_name(F.col("chain_family"), F.col("held")))
    met = counts.join(named, "chain_family").filter(test | rest)
    of = lambda split: F.coalesce(F.sum(F.when(F.col("split") == split, F.col("n"))), F.lit(0)).alias(split)
    usable = met.groupBy("variant").agg(*[of(s) for s in ("train", "dev", "test")]).filter("train > 0 and test > 0")
    plan = written(named.join(usable, "variant").select("chain_family", "held", "variant", ((F.col("dev") == 0) & (F.col("train") > 1)).alias("lends")), "folds")
    used = own.join(F.broadcast(plan), "chain_family").filter(test | rest)  # a row per family and template
    lent = F.col("lends") & (F.col("split") == "train")
    shown = lambda frame, split: frame.select(F.lit("template_holdout").alias("task_id"), "variant", split.alias("split"), "sample_id", *_carried(rows))
    out = shown(used.filter(~lent), F.col("split"))
    if plan.filter("lends").isEmpty():
        return out
    take = lambda n: F.least(n - 1, F.greatest(F.lit(1), F.bround(n * dev_share).cast("long")))
    movable = used.filter(lent).select("variant", "sample_id", *_carried(rows), salted(F.concat(F.lit("dev:"), F.col("variant")), F.col("sample_id")).alias("h"))
    moved = ranks.lowest(movable, ["variant"], "h", "sample_id", take)
    return out.unionByName(shown(moved, F.when(F.col("chosen"), "dev").otherwise("train")))


def _train_dev(rows: DataFrame, task: str) -> DataFrame:
    return supported(rows).filter("split in ('train', 'dev')").select(F.lit(task).alias("task_id"), F.lit("default").alias("variant"), "split", "sample_id", *_carried(rows))


def paired(rows: DataFrame, task: str, group: str, where: Column | None = None) -> DataFrame:
    """All train and dev rows; of the test rows the complete pairs of one label."""
    test = supported(rows).filter("split = 'test'")
    test = test if where is None else test.filter(where)
    pairs = complete_pairs(test.withColumn("score", F.lit(0.0)), group).select(F.explode(F.array("id_l", "id_r")).alias("sample_id"))
    pairs = pairs.join(test.select("sample_id", PLACE), "sample_id") if _carried(rows) else pairs
    return _usable(_train_dev(rows, task).unionByName(pairs.select(F.lit(task).alias("task_id"), F.lit("default").alias("variant"), F.lit("test").alias("split"), "sample_id", *_carried(rows))))


def operator_substitution(rows: DataFrame) -> DataFrame:
    return paired(rows, "operator_substitution", "substitution_group_id")


def parameter_perturbation(rows: DataFrame) -> DataFrame:
    return paired(rows, "parameter_perturbation", "parameter_group_id")


def order_swap(rows: DataFrame) -> DataFrame:
    """Swap pairs of adjacent steps; matching came first, so a distant match may have used an adjacent partner."""
    return paired(rows, "order_swap", "swap_group_id", F.col("swap_gap") == 1)


def delivery_robustness(rows: DataFrame) -> DataFrame:
    """Test rows of lineages (parent, family, known label) with at least two rows."""
    from .matching import lineages

    test = lineages(supported(rows).filter("split = 'test'"))
    enough = test.groupBy("lineage").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("lineage")
    own = test.join(enough, "lineage", "left_semi").select(F.lit("delivery_robustness").alias("task_id"), F.lit("default").alias("variant"), "split", "sample_id", *_carried(rows))
    return _usable(_train_dev(rows, "delivery_robustness").unionByName(own))


def pack_counts(packs: DataFrame) -> DataFrame:
    """(task_id, variant, split, n) with totals over splits and variants (a ROLLUP)."""
    out = packs.rollup("task_id", "variant", "split").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*[F.coalesce(c, F.lit("total")).alias(c) for c in ("task_id", "variant", "split")], "n")


def sample_pack(pack: DataFrame, ratio: dict[str, float], salt: str = "pack") -> DataFrame:
    """``ratio`` of each split of each variant, at least one row; salted by task and split alone where variants share training rows."""
    own = pack.withColumn("__h", salted(F.concat_ws(":", F.lit(salt), "split"), F.col("sample_id")))
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ratio.items() for x in kv]), F.col("split")), F.lit(1.0))
    take = lambda n: F.greatest(F.lit(1), F.bround(n * share).cast("long"))
    return ranks.lowest(own, ["task_id", "variant", "split"], "__h", "sample_id", take).filter("chosen").select(PACK + _carried(pack))


#: Splits in their order, and what folds may be asked for.
SPLITS = ["train", "dev", "test"]
PROTOCOLS, SCOPES = {"template_holdout": ["in_chain_detection"]}, ["per_family"]
ANNOTATIONS = ["operator_multiset_key", "swap_group_id", "path_group_id", "parameter_group_id", "substitution_group_id"]
BUILDERS = {"in_chain_detection": in_chain, "operator_substitution": operator_substitution, "parameter_perturbation": parameter_perturbation, "order_swap": order_swap, "delivery_robustness": delivery_robustness}


def ratio(value: float | str, name: str = "sample_ratio") -> float:
    out = float(value)
    if not 0 < out <= 1:
        raise ValueError(f"{name} must be above 0 and at most 1, not {value}")
    return out


def split_ratios(value, name: str = "sample_ratio") -> dict[str, float]:
    """A ratio for each split from one number, three of them, or a mapping with exactly the three."""
    if isinstance(value, (int, float)):
        return dict.fromkeys(SPLITS, ratio(value, name))
    if isinstance(value, (list, tuple)) and len(value) == len(SPLITS):
        return {s: ratio(v, f"{name}.{s}") for s, v in zip(SPLITS, value)}
    if isinstance(value, dict) and set(value) == set(SPLITS):
        return {s: ratio(value[s], f"{name}.{s}") for s in SPLITS}
    raise ValueError(f"{name} must be a number, or one for each of {', '.join(SPLITS)}")


def task_ratios(task_ids: list[str], value) -> dict[str, dict[str, float]]:
    """Ratios by task: one number for all, or a mapping from some of them."""
    if value is None:
        return {}
    if isinstance(value, (int, float)):
        return {t: split_ratios(value) for t in task_ids}
    if not isinstance(value, dict) or set(value) - set(task_ids):
        raise ValueError(f"sample_ratio must be a number or map tasks among {', '.join(task_ids)}")
    return {t: split_ratios(v, f"sample_ratio.{t}") for t, v in value.items()}


def generalization(raw, task_ids: list[str]) -> dict[str, str] | None:
    """A checked request for folds: protocol and scope; None or blank asks for none."""
    if raw is None or raw == "":
        return None
    if not isinstance(raw, dict) or str(raw.get("protocol", "")).strip() not in PROTOCOLS:
        raise ValueError(f"generalization needs a protocol of {', '.join(PROTOCOLS)}")
    protocol, scope = str(raw["protocol"]).strip(), str(raw.get("scope") or "").strip() or SCOPES[0]
    if scope not in SCOPES:
        raise ValueError(f"generalization.scope must be one of {', '.join(SCOPES)}")
    others = [t for t in task_ids if t not in PROTOCOLS[protocol]]
    if others:
        raise ValueError(f"{protocol} isn't for {', '.join(others)}")
    return {"protocol": protocol, "scope": scope}


def annotated(rows: DataFrame) -> DataFrame:
    """``rows``, mined and matched if any of the columns is missing that this gives."""
    from .matching import annotate

    missing = [c for c in ANNOTATIONS if c not in rows.columns]
    # what is there of them is dropped, so that no group id of an earlier matching stays
    return annotate(rows.drop(*ANNOTATIONS, "parameter_axis", "substitution_detail", "swap_gap", "path_step_index", "path_endpoint_key")) if missing else rows


#: Rows of a key that one task may gather to rank them; Spark cuts no partition's rows above a thousand.
FEW = 1000


def truncated(packs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The first rows by ``ord`` of each split of each pack. Splits without a limit aren't ranked; of small limits each partition keeps no more than it needs."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("split"))
    cut, keys, most = packs.filter(F.col("split").isin(*limits)), ["task_id", "variant", "split"], max(limits.values())
    if most <= FEW:
        kept = cut.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).filter(F.col("__r") <= most)
    else:
        kept = ranks.ranked(cut, keys, ["ord"], "__r")
    whole = packs.filter(F.col("split").isNull() | ~F.col("split").isin(*limits))
    return whole.unionByName(kept.filter(F.col("__r") <= limit).drop("__r"))


def build_packs(rows: DataFrame, task_ids: list[str], config: dict | None = None) -> DataFrame:
    """Packs of all ``task_ids``, sampled by ``config``'s sample_ratio and cut by its limits (split -> rows).

    Rows are written once, annotated if a task asks for groups. Within a task the in-chain
    one samples test rows by family.
    """
    config = config or {}
    folds, ratios = generalization(config.get("generalization"), task_ids), task_ratios(task_ids, config.get("sample_ratio"))
    grouped = {"operator_substitution", "parameter_perturbation", "order_swap"}
    placed = rows.withColumn(PLACE, F.col("ord")) if config.get("limits") else rows
    used = [c for c in ("sample_id", "parent_id", "split", "chain_family", "chain_template_id", "label", PLACE) if c in placed.columns]
    own = written(annotated(placed), "annotated") if grouped & set(task_ids) else written(placed.select(used), "rows")
    out = None
    for task in task_ids:
        made = template_holdout(own) if folds and task == "in_chain_detection" else BUILDERS[task](own)
        if task in ratios:
            made = sample_pack(made, ratios[task])
        out = made if out is None else out.unionByName(made)
    if config.get("limits"):
        out = truncated(out.withColumnRenamed(PLACE, "ord"), config["limits"]).select(PACK)
    return out
