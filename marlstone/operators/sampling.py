"""Deterministic samples, order and limits. Samples rank rows by sha1 of a salt and the row's token, ties by ``ord``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import salted
from ..functions.text import strip
from ..storage import written
from . import ranks


def target_size(n: Column, ratio: float) -> Column:
    """min(n, max(1, n * ratio rounded half to even))."""
    return n if ratio >= 1 else F.least(n, F.greatest(F.lit(1), F.bround(n * F.lit(float(ratio))).cast("long")))


#: Rows that one task may gather to choose from.
TOP = 10_000


def bottom_k(rows: DataFrame, k: int, salt: str, token: str = "sample_id", tie: str = "ord") -> DataFrame:
    """k rows of all; a top-k on each partition where k is small, else by counts of the hashes, so no task sorts or gathers the table."""
    hashed = rows.withColumn("__hash", salted(salt, F.col(token).cast("string")))
    if k <= TOP:
        return hashed.orderBy("__hash", tie).limit(k).drop("__hash")
    return ranks.lowest(written(hashed, "hashed"), [], "__hash", tie, lambda n: F.lit(k)).filter("chosen").drop("__hash", "chosen")


def ratio_sample(rows: DataFrame, ratio: float, salt: str, token: str = "sample_id", tie: str = "ord") -> DataFrame:
    if ratio >= 1:
        return rows
    hashed = written(rows.withColumn("__hash", salted(salt, F.col(token).cast("string"))), "hashed")
    return ranks.lowest(hashed, [], "__hash", tie, lambda n: target_size(n, ratio)).filter("chosen").drop("__hash", "chosen")


def stratified(rows: DataFrame, ratio: float, salt: str, group: str, token: str = "sample_id", tie: str = "ord") -> DataFrame:
    """``ratio`` of each group; the salt includes the group.

    Only (group, hash, tie) is ranked; the rows themselves meet the choice in a semi-join.
    """
    if ratio >= 1:
        return rows
    own = rows.select(F.col(group).cast("string").alias("__g"), F.col(tie).alias("__t"), salted(F.concat(F.lit(salt + ":"), F.col(group).cast("string")), F.col(token).cast("string")).alias("__h"))
    chosen = ranks.ranked(own, ["__g"], ["__h", "__t"], "__r", "__all_rows").filter(F.col("__r") <= target_size(F.col("__all_rows"), ratio)).select("__t")
    return rows.join(chosen, rows[tie] == chosen["__t"], "left_semi")


def unit_sample(rows: DataFrame, ratio: float, salt: str, group: str, unit: str) -> DataFrame:
    """Whole units (pairs, lineages) of each group: units are ranked, then their rows kept."""
    units = rows.select(F.col(group).alias("ord_group"), F.col(unit).cast("string").alias("unit")).distinct()
    chosen = stratified(units.withColumnRenamed("ord_group", "grp").withColumn("ord", F.concat_ws("\0", "grp", "unit")), ratio, salt, "grp", "unit").select("grp", "unit")
    return rows.join(chosen, (rows[group] == chosen["grp"]) & (rows[unit].cast("string") == chosen["unit"]), "left_semi")


def first_n(rows: DataFrame, n: dict[str, int], split: str = "split", ord: str = "ord") -> DataFrame:
    """The first n rows of each split; blank split is train; splits that aren't named stay whole."""
    of = F.coalesce(F.nullif(strip(F.col(split)), F.lit("")), F.lit("train"))
    limits = F.create_map(*[F.lit(x) for kv in n.items() for x in kv]) if n else None
    if limits is None:
        return rows
    ranked = ranks.ranked(rows.withColumn("__split", of), ["__split"], [ord], "__r").withColumn("__limit", F.try_element_at(limits, F.col("__split")))
    return ranked.filter("__limit is null or __r <= __limit").drop("__r", "__limit", "__split")


def smoke(rows: DataFrame, limit: int = 500) -> DataFrame:
    """A third of ``limit`` of each split."""
    third = limit // 3
    return first_n(rows, {"train": third, "dev": third, "test": third})
