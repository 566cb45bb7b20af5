"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions alone.

A source's documents, by doc_id, are cut into blocks of ``block``. Weights are
turned into slots per frame (``frame`` slots, at least one per source, largest
remainders). Block k of a source with n of N slots may not run before
floor(k N / n) and must run before ceil((k + 1) N / n); in each slot the
released block with the earliest deadline runs, ties by source. As the weights
fill the frame, every deadline is met, so at any time each source is less than
one block from its share. The schedule repeats from frame to frame, so only one
frame is computed, by a fold over its slots; a block's slot then is arithmetic.

Ranks within a source need no window over the source: the rows are range-sorted
by (source, doc_id), and a rank is a row's place in its range plus the sizes of
the ranges before it minus the rows of the sources before its own.

Every row is kept. When a source runs out its slots stay empty, and the others
go on in proportion to their weights. Defined results: null source is a source
of its own (the first in order); null doc_ids come first in their source; rows
that repeat are rows of their own; weights of sources that have none given, or
less than 1, count as 1. An empty table gives an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, scanned, shielded, store

BLOCK, FRAME = 16, 1024
#: Sources up to which the per-source tables are broadcast; beyond, Spark joins as it sees fit.
BROADCAST_SOURCES = 50_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def slots_per_frame(counts: DataFrame, frame: int, weights: DataFrame | None = None) -> DataFrame:
    """(source, rows, index, slots) from (source, rows); without weights they are floor(sqrt(rows)).

    A row per source, so ordering them in one task is small.
    """
    if weights is None:
        weighted = counts.withColumn("weight", F.floor(F.sqrt("rows")))
    else:
        given = weights.select(F.col("source").alias("w_source"), F.col("weight").cast("long").alias("weight")).groupBy("w_source").agg(F.max("weight").alias("weight"))
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    weighted = weighted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long"))
    whole = Window.partitionBy()
    ordered = weighted.withColumn("index", F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))) - 1)
    ordered = ordered.withColumn("spare", F.lit(frame) - F.count(F.lit(1)).over(whole)).withColumn("total", F.sum("weight").over(whole))
    ordered = ordered.withColumn("base", F.expr("spare * weight div total")).withColumn("rest", F.expr("spare * weight % total"))
    ordered = ordered.withColumn("left", F.col("spare") - F.sum("base").over(whole))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "index"))
    return ordered.select("source", "rows", F.col("index").cast("int").alias("index"), (1 + F.col("base") + (place <= F.col("left")).cast("long")).cast("long").alias("slots"))


def frame_schedule(slots: DataFrame, frame: int) -> DataFrame:
    """(source, nth, in_frame, release, deadline): which slot of a frame each source's nth block gets."""
    one = slots.agg(F.expr("transform(array_sort(collect_list(struct(index, slots))), x -> x.slots)").alias("n")).filter("size(n) > 0")
    best = f"""array_min(transform(filter(sequence(0, size(n) - 1), i -> a.done[i] < n[i] AND a.done[i] * {frame} div n[i] <= t),
        i -> named_struct('deadline', ((a.done[i] + 1) * {frame} + n[i] - 1) div n[i], 'i', CAST(i AS bigint)))).i"""
    fold = f"""aggregate(sequence(0, {frame - 1}), named_struct('done', array_repeat(0L, size(n)), 'picks', CAST(array() AS array<bigint>)),
        (a, t) -> transform(array({best}), p -> named_struct('done', transform(a.done, (d, i) -> IF(i = p, d + 1L, d)), 'picks', concat(a.picks, array(p))))[0]).picks"""
    picked = one.select(F.posexplode(F.expr(fold)).alias("in_frame", "index"))
    nth = F.row_number().over(Window.partitionBy("index").orderBy("in_frame")) - 1
    return (
        picked.withColumn("nth", nth.cast("long"))
        .join(slots, "index")
        .select("source", "nth", F.col("in_frame").cast("long").alias("in_frame"), F.expr(f"nth * {frame} div slots").alias("release"), F.expr(f"((nth + 1) * {frame} + slots - 1) div slots").alias("deadline"))
    )


def mix_order(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """Per row of ``docs``: row, doc_id, source, block, slot, release, deadline and mix_order.

    mix_order is unique and sorts the rows into the mixed stream. row is the key
    that ``keyed`` gives the row (of a copy of ``docs``, if that isn't a scan).
    """
    light = keyed(docs.select("doc_id", "source"), "documents", "row").select("row", F.col("doc_id").cast("long").alias("doc_id"), "source")
    order = ["source", "doc_id", "row"]
    placed = store(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "mixing")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33)).withColumn("at", F.col("place").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))  # a row per range
    counts = store(placed.groupBy("source").agg(F.count(F.lit(1)).alias("rows")), "sources")
    n = counts.count()
    while frame < 2 * n:
        frame *= 2
    slots = slots_per_frame(counts, frame, weights)
    earlier = Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    sources = store(slots.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "slots")
    plan = store(frame_schedule(sources.select("source", "index", "slots"), frame), "frame")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    ranked = (
        placed.join(F.broadcast(bases), "part")
        .join(_small(sources.select(F.col("source").alias("s_source"), "slots", "start"), n), same("source", "s_source"))
        .withColumn("rank", F.col("base") + F.col("at") - F.col("start"))
        .withColumn("block", F.expr(f"rank div {block}"))
        .withColumn("nth", F.expr("block % slots"))
        .withColumn("cycle", F.expr("block div slots"))
    )
    timed = ranked.join(_small(plan.select(F.col("source").alias("p_source"), F.col("nth").alias("p_nth"), "in_frame", "release", "deadline"), n), same("source", "p_source") & (F.col("nth") == F.col("p_nth")))
    shift = F.col("cycle") * frame
    slot = shift + F.col("in_frame")
    return timed.select("row", "doc_id", "source", "block", slot.alias("slot"), (shift + F.col("release")).alias("release"), (shift + F.col("deadline")).alias("deadline"), (slot * block + F.col("rank") % block).alias("mix_order"))


@shielded
def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, frame: int = FRAME) -> DataFrame:
    """``docs``, all columns and rows, range-sorted into the mixed stream, so that files written from it follow it."""
    docs = scanned(docs, "documents")
    order = mix_order(docs, weights, block, frame).select(F.col("row").alias("__mix_row"), F.col("mix_order").alias("__mix_order"))
    joined = keyed(docs, "documents", "__mix_row").join(order, "__mix_row")
    return joined.repartitionByRange("__mix_order").sortWithinPartitions("__mix_order").select(*[F.col(f"`{c}`") for c in docs.columns])
