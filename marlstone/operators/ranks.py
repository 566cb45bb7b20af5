"""Ranks and running sums within keys, without a task that sees all of a key.

Rows are range-sorted by (keys, order) and written; the place of a row in its
range, plus what the earlier ranges hold of its key, is its rank. What is summed
over ranges is one row for each key and range, so a key that holds a third of
all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

_AT = (1 << 33) - 1


def _sorted(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` with __part and __at, their range and place; ties that ``order`` leaves are settled once, by the copy."""
    by = [*keys, *order]
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    return placed.withColumn("__part", F.shiftrightunsigned("__id", 33).cast("int")).withColumn("__at", F.col("__id").bitwiseAND(_AT)).drop("__id")


def _met(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the row of their range and key; null keys are keys like others."""
    right = small.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k {i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in ("__part", *keys)])
    test = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"__k {i}"))
    return rows.join(right, test).drop("__p", *[f"__k {i}" for i in range(len(keys))])


def _before(small: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """``small`` with what the earlier ranges of a key hold in place of what its own holds; a row per key and range."""
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return small.select("__part", *keys, *[c for c in small.columns if c not in ("__part", *keys, *sums)], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def ranked(rows: DataFrame, keys: list[str], order: list[str | Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """``rows`` with their 1-based rank within the keys, and the key's number of rows if ``size`` names a column for it."""
    placed = _sorted(rows, keys, order)
    own = placed.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    if size:
        own = own.withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    met = _met(placed, _before(own, keys, ["__n"]), keys)
    made = met.withColumn(rank, F.col("__n") + F.col("__at") - F.col("__low") + 1)
    made = made.withColumn(size, F.col("__all")) if size else made
    return made.select(*rows.columns, rank, *([size] if size else []))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with running sums (name -> column) up to and with each row, next_<column> of the row that follows in its key, and whether it is the first."""
    placed = _sorted(rows, keys, order)
    inside = Window.partitionBy("__part", *keys).orderBy("__at")  # a range at most
    totals = [F.sum(c).alias(f"__s {name}") for name, c in sums.items()]
    firsts = [F.min_by(c, "__at").alias(f"__f {name}") for name, c in sums.items()]
    own = placed.groupBy("__part", *keys).agg(*totals, *firsts)
    over = Window.partitionBy(*keys).orderBy("__part")  # a row per range
    own = own.select(*own.columns, *[F.lead(f"__f {name}").over(over).alias(f"__next {name}") for name in sums], F.lag("__part").over(over).isNull().alias("__opens"))
    own = _before(own, keys, [f"__s {name}" for name in sums])
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    made = _met(placed, own, keys)
    columns = [(F.sum(c).over(run) + F.col(f"__s {name}")).alias(name) for name, c in sums.items()]
    following = [F.coalesce(F.lead(c).over(inside), F.col(f"__next {name}")).alias(f"next_{c}") for name, c in sums.items()]
    first = (F.lag("__at").over(inside).isNull() & F.col("__opens")).alias("first")
    return made.select(*rows.columns, *columns, *following, first)


def lowest(rows: DataFrame, keys: list[str], by: str, tie: str | Column, take: Callable[[Column], Column], flag: str = "chosen", width: int = 3) -> DataFrame:
    """``rows`` with ``flag``: whether a row is among the first ``take``(rows of its key) by (by, tie). ``by`` is text, a hash best.

    Rows are counted by the first ``width`` characters of ``by``. Whole such bins lie before or after the place where a
    key's count is reached; only the bin that holds the place is ranked, so of hashes 1 row of 4,096 is sorted. ``rows``
    are read three times and must not change between, so they are best written.
    """
    own = rows.withColumn("__bin", F.coalesce(F.substring(by, 1, width), F.lit("")))
    counts = own.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    upto, whole = Window.partitionBy(*keys).orderBy("__bin"), Window.partitionBy(*keys)  # a row per key and bin
    summed = counts.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__due", F.least(take(F.sum("__n").over(whole)), F.sum("__n").over(whole)))
    edge = summed.filter("__due > __upto - __n and __due <= __upto")
    right = edge.select(*[F.col(k).alias(f"__k {i}") for i, k in enumerate(keys)], F.col("__bin").alias("__edge"), (F.col("__due") - F.col("__upto") + F.col("__n")).alias("__rest"))
    test = F.lit(True)
    for i, k in enumerate(keys):
        test = test & F.col(k).eqNullSafe(F.col(f"__k {i}"))
    met = own.join(right if keys else F.broadcast(right), test, "left")  # without keys it is one row
    columns = [F.col(c) for c in rows.columns]
    clear = met.filter("__edge is null or __bin <> __edge").select(*columns, F.coalesce(F.col("__bin") < F.col("__edge"), F.lit(False)).alias(flag))
    tied = met.filter("__bin = __edge").select(*columns, "__rest")
    return clear.unionByName(ranked(tied, keys, [by, tie], "__r").select(*columns, (F.col("__r") <= F.col("__rest")).alias(flag)))
