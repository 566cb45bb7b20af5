"""Mining related chains inside (parent, family, label) groups, and matching them one to one.

Rows need sample_id (unique), parent_id, chain_family, label and sig (array of
tokens). Rows with a blank group part take no part. Candidates come from
equi-joins on a blocking key, so a group is never compared with all of itself
where the relation allows a key: one wildcarded slot (parameter), the multiset
(swap), the shorter chain (path). Substitution has the group and length as key.

Sides of joins that grow with the table are never broadcast (``grows``): dictionary
pages make a file of chains some tens of times smaller than its rows.

Matching is greedy in the order of pair ids. It runs in rounds: an edge that is
the first at both of its ends is taken, edges at taken rows go, the rest is
tried again. That gives the sequential result, and a round is two small
aggregations, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chains
from ..functions.hashing import pair_id
from ..functions.text import binary_label, clean
from ..storage import written

GROUP = ["parent_id", "chain_family", "label"]


def minable(rows: DataFrame) -> DataFrame:
    """The rows that take part, with what mining needs; written, as each relation joins them with themselves."""
    own = [clean(F.col(c).cast("string")).alias(c) for c in GROUP]
    return written(rows.select("sample_id", *own, "sig").filter(" and ".join(f"{c} is not null" for c in GROUP)), "minable")


def grows(side: DataFrame) -> DataFrame:
    """A join's side that grows with the table: sorted and merged, as the size of its files says nothing of its rows once they are unpacked, and the driver would hold them all."""
    return side.hint("merge")


def _sides(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    a = rows.select(*GROUP, *keys, F.col("sample_id").alias("a"), F.col("sig").alias("sig_a"))
    b = rows.select(*GROUP, *keys, F.col("sample_id").alias("b"), F.col("sig").alias("sig_b"))
    return a, b


def _named(pairs: DataFrame, prefix: str, *extra: str) -> DataFrame:
    return pairs.select(*GROUP, "a", "b", pair_id(prefix, F.col("a"), F.col("b")).alias("pair_id"), *extra)


def _parameter_pairs(own: DataFrame) -> DataFrame:
    """Pairs that differ in one slot, by parameters only; axis names the slot."""
    slots = own.filter("size(sig) > 0").select("*", F.posexplode("sig").alias("slot", "token"))
    before, after = F.slice("sig", F.lit(1), F.col("slot")), F.slice("sig", F.col("slot") + 2, F.size("sig"))
    wild = F.concat(before, F.array(F.concat(chains.operator_name(F.col("token")), F.lit("[*"))), after)
    keyed = slots.withColumn("key", wild)
    a = keyed.select(*GROUP, "slot", "key", F.col("sample_id").alias("a"), F.col("token").alias("ta"))
    b = keyed.select(*GROUP, "slot", "key", F.col("sample_id").alias("b"), F.col("token").alias("tb"))
    pairs = a.join(grows(b), [*GROUP, "slot", "key"]).filter("a < b and ta <> tb")
    return _named(pairs.withColumn("detail", F.concat(F.lit("parameter@"), F.col("slot").cast("string"))), "parameter", "detail")


def _substitution_pairs(own: DataFrame) -> DataFrame:
    """Pairs of equal length whose differing slots all differ in the operator; detail lists them.

    Chains are compared once for each two distinct ones of a group and length, not
    for each two rows; the rows meet only where their chains are a pair, by the
    numbers of these, as groups and chains are many times as wide.
    """
    own = own.filter("size(sig) > 0")
    chain = numbered(own, GROUP)
    placed = written(own.join(grows(chain), [*GROUP, "sig"]).select(*GROUP, "node", "sample_id"), "placed")
    a, b = (chain.select(*GROUP, F.size("sig").alias("length"), F.col("node").alias(f"node_{x}"), chains.named_slots(F.col("sig")).alias(f"slots_{x}")) for x in "ab")
    detail = F.when(F.col("node_a") < F.col("node_b"), chains.slots_detail(F.col("slots_a"), F.col("slots_b")))
    # a generator, as a filter on what a projection makes would make it twice
    pairs = a.join(grows(b), [*GROUP, "length"]).select("node_a", "node_b", F.explode(F.array_compact(F.array(detail))).alias("detail"))
    left, right = placed.select(*GROUP, F.col("node").alias("node_a"), F.col("sample_id").alias("a")), placed.select(F.col("node").alias("node_b"), F.col("sample_id").alias("b"))
    met = pairs.join(grows(left), "node_a").join(grows(right), "node_b")
    return _named(met.withColumn("low", F.least("a", "b")).withColumn("b", F.greatest("a", "b")).withColumn("a", F.col("low")), "operator", "detail")


def _swap_pairs(own: DataFrame) -> DataFrame:
    """Pairs of one multiset with two slots exchanged; gap is their distance."""
    own = own.filter("size(sig) > 1").withColumn("key", F.array_sort("sig"))
    a, b = _sides(own, ["key"])
    pairs = a.join(grows(b), [*GROUP, "key"]).filter("a < b").withColumn("gap", chains.swap_gap(F.col("sig_a"), F.col("sig_b")))
    return _named(pairs.filter("gap is not null"), "swap", "gap")


def _prefix_pairs(own: DataFrame) -> DataFrame:
    """Pairs of a chain and that chain with one more step; step is the longer length."""
    own = own.filter("size(sig) > 0")
    a = own.select(*GROUP, F.col("sig").alias("key"), F.col("sample_id").alias("a"))
    b = own.filter("size(sig) > 1").select(*GROUP, F.slice("sig", F.lit(1), F.size("sig") - 1).alias("key"), F.col("sample_id").alias("b"), F.size("sig").alias("step"))
    return _named(a.join(grows(b), [*GROUP, "key"]), "path", "step")


def parameter_pairs(rows: DataFrame) -> DataFrame:
    return _parameter_pairs(minable(rows))


def substitution_pairs(rows: DataFrame) -> DataFrame:
    return _substitution_pairs(minable(rows))


def swap_pairs(rows: DataFrame) -> DataFrame:
    return _swap_pairs(minable(rows))


def prefix_pairs(rows: DataFrame) -> DataFrame:
    return _prefix_pairs(minable(rows))


def greedy_matching(pairs: DataFrame, order: str = "pair_id", space: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (a, b) that one pass over all in ``order`` takes, no row twice; rows of other ``space`` values are other rows.

    A round is a minimum per row, a count per edge, and two anti-joins with the rows that are taken.
    """
    left, out = written(pairs, "pairs"), None
    while True:
        ends = left.select("*", F.explode(F.array("a", "b")).alias("node"))
        best = ends.groupBy(*space, "node").agg(F.min(F.struct(F.col(order).alias("__order"), *pairs.columns)).alias("edge"))
        won = written(best.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("edge.*").select(pairs.columns), "matched")
        if won.isEmpty():
            return won if out is None else out
        out = won if out is None else out.unionByName(won)
        gone = won.select(*space, F.explode(F.array("a", "b")).alias("node"))
        for end in ("a", "b"):
            left = left.join(grows(gone.withColumnRenamed("node", end)), [*space, end], "left_anti")
        left = written(left.select(pairs.columns), "pairs")


#: relation -> the set of used rows it shares, its place in the order there, and how its candidates are mined.
RELATIONS = {"parameter": ("intervention", 0, _parameter_pairs), "substitution": ("intervention", 1, _substitution_pairs), "swap": ("swap", 0, _swap_pairs), "path": ("path", 0, _prefix_pairs)}


def match_all(rows: DataFrame, relations: tuple[str, ...] = tuple(RELATIONS)) -> dict[str, DataFrame]:
    """Matches of relations, all in the same rounds. Substitution only gets rows that parameter has left."""
    own = minable(rows)
    wanted = set(relations) | ({"parameter"} if "substitution" in relations else set())
    found = None
    for name in (r for r in RELATIONS if r in wanted):
        space, place, mine = RELATIONS[name]
        pairs = mine(own)
        extra = pairs.columns[-1]
        tagged = pairs.select("a", "b", "pair_id", F.col(extra).cast("string").alias("detail"), F.lit(name).alias("relation"), F.lit(space).alias("space"), F.concat(F.lit(f"{place}:"), "pair_id").alias("place"))
        found = tagged if found is None else found.unionByName(tagged)
    matched = greedy_matching(found, "place", ("space",))
    return {name: matched.filter(F.col("relation") == name).select("a", "b", "pair_id", "detail") for name in relations}


def annotate(rows: DataFrame) -> DataFrame:
    """``rows`` with the group ids of all matches, the multiset key and the endpoint; null where a row is unmatched."""
    found = match_all(rows)
    ends = lambda name, *extra: grows(found[name].select(F.explode(F.array("a", "b")).alias("sample_id"), F.col("pair_id").alias(f"{name}_group_id"), *extra))
    out = rows.join(ends("parameter", F.col("detail").alias("parameter_axis")), "sample_id", "left")
    out = out.join(ends("substitution", F.col("detail").alias("substitution_detail")), "sample_id", "left")
    out = out.join(ends("swap", F.col("detail").cast("int").alias("swap_gap")), "sample_id", "left").join(ends("path", F.col("detail").cast("int").alias("path_step_index")), "sample_id", "left")
    return out.withColumn("operator_multiset_key", chains.multiset_key(F.col("sig"))).withColumn("path_endpoint_key", chains.endpoint_key(F.col("sig")))


def edit_edges(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, sig_a, sig_b), both directions, between distinct chains of a group one edit apart."""
    own = numbered(nodes, keys)
    edges = node_edges(own, keys)
    a, b = (own.select(F.col("node").alias(x), *([*keys] if x == "a" else []), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return edges.join(a, "a").join(b, "b").select(*keys, "sig_a", "sig_b")


def numbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct chains of each group with a number each."""
    return written(nodes.select(*keys, "sig").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")


def node_edges(own: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (a, b), both directions, between numbered chains one edit apart.

    An edit changes a parameter or an operator in one slot, swaps two adjacent
    steps, or adds or removes one. Each kind has its own blocking key: the chain
    with a slot wildcarded, the chain with two neighbours sorted, the chain
    without a slot.
    """
    slots = own.filter("size(sig) > 0").select(*keys, "node", "sig", F.explode(F.sequence(F.lit(0), F.size("sig") - 1)).alias("i"))
    without = slots.withColumn("rest", chains.without(F.col("sig"), F.col("i")))
    grown = without.select(*keys, F.col("node").alias("b"), F.col("rest").alias("sig")).distinct().join(grows(own.select(*keys, F.col("node").alias("a"), "sig")), [*keys, "sig"]).select("a", "b")
    one = _same_key(without.select(*keys, "node", F.struct("i", "rest").alias("key")), keys)
    rest = chains.without(chains.without(F.col("sig"), F.col("i") + 1), F.col("i"))
    two = F.array_sort(F.slice("sig", F.col("i") + 1, F.lit(2)))
    swapped = _same_key(slots.filter("i + 1 < size(sig)").select(*keys, "node", F.struct("i", rest.alias("rest"), two.alias("two")).alias("key")), keys)
    edges = grown.unionByName(one).unionByName(swapped)
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _same_key(keyed: DataFrame, keys: list[str]) -> DataFrame:
    a, b = keyed.withColumnRenamed("node", "a"), keyed.withColumnRenamed("node", "b")
    return a.join(grows(b), [*keys, "key"]).filter("a < b").select("a", "b")


def graph_distances(nodes: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sig, distance) of chains reachable from their group's reference, level by level over all groups at once.

    Edges go both ways, so what a level reaches lies in the level before it, in
    itself or in the next one: only the last two need be held against.
    """
    own = numbered(nodes.select(*keys, "sig").unionByName(references.select(*keys, "sig")), keys)
    edges = written(node_edges(own, keys), "edges")
    level = written(references.select(*keys, "sig").distinct().join(own, [*keys, "sig"]).select("node"), "level")
    before, out, depth = None, level.withColumn("distance", F.lit(0)), 0
    while True:
        depth += 1
        step = level.select(F.col("node").alias("a")).join(edges, "a").select(F.col("b").alias("node")).distinct().join(level, "node", "left_anti")
        step = written(step if before is None else step.join(before, "node", "left_anti"), "level")
        if step.isEmpty():
            return own.join(out, "node").select(*keys, "sig", "distance")
        before, level = level, step
        out = out.unionByName(level.withColumn("distance", F.lit(depth)))


def lineages(rows: DataFrame) -> DataFrame:
    """``rows`` with lineage (parent|family|label) of rows whose label is known."""
    label = binary_label(F.col("label"))
    key = F.concat_ws("|", F.col("parent_id").cast("string"), "chain_family", label)
    return rows.withColumn("lineage", key).filter(label != "")
