"""Counts and coverage. Every figure of a report comes from one pass where its groupings allow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import number
from ..functions.text import clean, strip


def group_by_field(rows: DataFrame, field: str, keep_blank: bool = False) -> DataFrame:
    """(value, n) of a trimmed field; blanks are dropped or kept as a group of their own."""
    own = rows.select(strip(F.coalesce(F.col(field).cast("string"), F.lit(""))).alias("value"))
    return (own if keep_blank else own.filter("value <> ''")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def grouped_counts(rows: DataFrame, sets: list[tuple[str, ...]], distinct: str | None = None) -> DataFrame:
    """(grouping, key, n) for each set of columns, in one aggregation over GROUPING SETS; with ``distinct`` also its distinct values."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.count_distinct(distinct).alias("distinct_values")] if distinct else [])
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*aggs, F.grouping_id().alias("gid"))
    width = len(names)
    label = {sum(0 if c in s else 1 << (width - 1 - k) for k, c in enumerate(names)): s for s in sets}
    which = F.coalesce(*[F.when(F.col("gid") == g, F.lit("/".join(s) or "all")) for g, s in label.items()])
    key = F.coalesce(*[F.when(F.col("gid") == g, F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s])) for g, s in label.items()])
    return grouped.select(which.alias("grouping"), key.alias("key"), "n", *(["distinct_values"] if distinct else []))


def duplicate_keys(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): how many values of each field occur more than once."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("x.*")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("field").agg(F.count_if(F.col("c") > 1).alias("n"))


def split_overlap(rows: DataFrame, split: str, speaker: str) -> DataFrame:
    """(split_a, split_b, shared) for all pairs of splits, zeros included, and whether they are disjoint."""
    members = rows.select(F.col(split).alias("split"), F.col(speaker).alias("speaker")).distinct()
    names = members.select("split").distinct()
    both = members.groupBy("speaker").agg(F.collect_set("split").alias("splits")).filter("size(splits) > 1")
    pairs = F.explode(F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b"))))))
    shared = both.select(pairs.alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count(F.lit(1)).alias("shared"))
    frame = names.select(F.col("split").alias("split_a")).crossJoin(names.select(F.col("split").alias("split_b"))).filter("split_a < split_b")  # split names, a handful
    return frame.join(shared, ["split_a", "split_b"], "left").select("split_a", "split_b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.col("shared").isNull().alias("disjoint"))


def parent_coverage(rows: DataFrame, required: list[str], parent: str = "parent_id", family: str = "chain_family") -> DataFrame:
    """(state, n): parents whose families include all ``required``, and each missing family with its parents."""
    want = F.array(*map(F.lit, required))
    # one flag per required family, so a parent's state doesn't grow with its rows
    own = rows.groupBy(parent).agg(F.collect_set(F.when(F.col(family).isin(required), F.col(family))).alias("have")).select(F.array_except(want, F.col("have")).alias("missing"))
    states = F.when(F.size("missing") == 0, F.array(F.lit("complete"))).otherwise(F.concat(F.array(F.lit("incomplete")), F.transform("missing", lambda m: F.concat(F.lit("missing:"), m))))
    return own.select(F.explode(states).alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def status_summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Rows, parents, ok share and field means: overall, by family, by family and language (a ROLLUP)."""
    means = [F.avg(number(F.col(f))).alias(f"mean_{f}") for f in fields]
    out = rows.rollup("chain_family", "language").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(clean(F.col("parent_id").cast("string"))).alias("parents"), F.count_if(F.col("status") == "ok").alias("ok_rows"), F.grouping_id().alias("gid"), *means
    )
    level = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "family").otherwise("family_language")
    ratio = F.when(F.col("rows") > 0, F.col("ok_rows") / F.col("rows"))
    return out.select(level.alias("level"), F.coalesce("chain_family", F.lit("")).alias("chain_family"), F.coalesce("language", F.lit("")).alias("language"), "rows", "parents", "ok_rows", ratio.alias("ok_fraction"), *[f"mean_{f}" for f in fields])


def top_text(rows: DataFrame, field: str, k: int = 5) -> DataFrame:
    """One row: the k commonest values as ``value=count`` text, ties by value."""
    top = rows.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "value")))  # k entries
    return top.agg(F.array_join(F.transform(lines, lambda x: F.concat(x["value"], F.lit("="), (-x["o"]).cast("string"))), ", ").alias("summary"))


def table_digest(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n, digest): independent of order, mergeable, a sum of row hashes modulo 2**128; equal tables have equal digests."""
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(columns or rows.columns)]), {"ignoreNullFields": "false"})
    part = lambda k: F.sum(F.conv(F.substring(F.sha1(text), 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"d{k}") for k in range(4)])
    return sums.select("n", F.concat_ws("-", *[F.coalesce(F.col(f"d{k}"), F.lit(0)).cast("string") for k in range(4)]).alias("digest"))


def ordered_digest(rows: DataFrame, keys: list[str], ord: str, value: Column) -> DataFrame:
    """sha1 of the values of each key in order; for packs and other lists that fit one row."""
    return rows.groupBy(*keys).agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("o"), value.alias("v")))), lambda x: x["v"]), "\n")).alias("digest"))
