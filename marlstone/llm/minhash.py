"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars.

Words are runs of characters other than blanks and \\t to \\r, A-Z lower-cased. A
document's set is its distinct 5-word shingles (its whole word sequence if it
has fewer words; nothing without words), each a 64-bit number: xxHash64 of each
word's bytes, and a mixing step (no polynomial, so that texts of a regular build
don't collide) for each word of the shingle in turn. One number per shingle fills ``BINS`` bins with minima; an empty bin borrows from the
first non-empty bin in an order of its own (a universal hash of bin and attempt,
shared by all documents). ``BANDS`` bands of ``ROWS`` bins are the buckets: a
pair of similarity 0.85 shares none with probability 6e-11, one of 0.80, the
least that ``deduplicate`` joins, with 5e-8.

Equal sets are one class. In each bucket every class meets only the bucket's
hub, so a bucket of m classes gives m - 1 candidates. Candidates are confirmed
on full sets and confirmed links joined into components. A star can miss a link
between two members that are not alike to the hub. Those are found exactly: a
bucket whose classes are all in one component holds nothing more; of the others
only classes can have a link left whose shared shingles suffice for it, counted
over all candidate documents, and these are compared across components: in small
buckets as pairs, in others block by block, where a task counts the shingles in
common of two blocks at once and gives a link for each two components, so that
no bucket's pairs are ever emitted.

Defined results: rows without words have the empty set and link with nothing.
Rows that repeat are members of one class; a null doc_id never names a component
unless there is no other id in it (then component_id is null). kept is
doc_id = component_id, and true where both are null. Very long texts count with
all their shingles. An empty table gives no rows. Other columns are ignored, and
``deduplicate`` passes them through, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keyed, scanned, shielded, store

WORDS, BANDS, ROWS = 5, 32, 4
BINS = BANDS * ROWS
#: Members up to which a bucket's open pairs are joined; members and shingles of a block, by two of which the others are compared.
FEW, BLOCK, BLOCK_SHINGLES = 16, 384, 1_000_000
PIECE = 2_000_000
_U = np.uint64


class Words(dict):
    """xxHash64 of words, kept while a worker meets them again; emptied when ``KEPT`` are held."""

    KEPT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Hashing:
    """Shared random numbers; made once in each Python worker."""

    def __init__(self):
        random = np.random.Generator(np.random.PCG64(20240229))
        self.words = Words()
        self.borrow = np.stack([random.permutation(BINS) for _ in range(BINS)])
        self.seeds = random.integers(1, 1 << 63, 4, dtype=np.uint64)
        self.places = random.integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)


_HASHING: Hashing | None = None


def shared() -> Hashing:
    global _HASHING
    if _HASHING is None:
        _HASHING = Hashing()
    return _HASHING


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, number) of the distinct shingles of each text, sorted by both."""
    h = shared()
    # for bytes, lower() and split() know A-Z, the blank and \t to \r alone
    words = [t.lower().split() for t in texts]
    count = np.fromiter(map(len, words), np.int64, len(words))
    word = np.fromiter(map(h.words.__getitem__, itertools.chain.from_iterable(words)), np.uint64, int(count.sum()))
    word0 = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(1, count - WORDS + 1))
    doc = np.repeat(np.arange(len(texts)), shingles)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first, length = word0[doc] + nth, np.minimum(WORDS, count[doc])
    code = length.astype(np.uint64)
    for k in range(WORDS):
        has = length > k  # but for texts of fewer words all have
        code[has] = _mix((code[has] ^ word[first[has] + k]) * h.places[k])
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])
    return doc[new], code[new]


def signatures(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """n by BINS minima with borrowed values in empty bins; rows without shingles are 0."""
    h = shared()
    shift = _U(64 - (BINS - 1).bit_length())
    bin_ = (code >> shift).astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (bin_[1:] != bin_[:-1])
    out, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    out[doc[new], bin_[new]] = code[new]  # sorted, so the first is the least
    full[doc[new], bin_[new]] = True
    own, has = full.copy(), full.any(axis=1)
    source = out.copy()
    for attempt in range(BINS):
        row, column = np.nonzero(~full & has[:, None])
        if not len(row):
            break
        lender = h.borrow[column, attempt]
        good = own[row, lender]
        row, column, lender = row[good], column[good], lender[good]
        out[row, column] = source[row, lender] + _U(attempt + 1)
        full[row, column] = True
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n by BANDS 63-bit bucket numbers; the band is part of the number."""
    h = shared()
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * h.seeds[0] + h.seeds[1]
    grid = signature.reshape(len(signature), BANDS, ROWS)
    for k in range(ROWS):
        key = _mix((key ^ grid[:, :, k]) * h.seeds[2] + h.seeds[3])
    return (key >> _U(1)).astype(np.int64)


def set_keys(doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: two sums of mixed members."""
    h = shared()
    out = []
    for seed in h.seeds[:2]:
        total = np.zeros(n, np.uint64)
        np.add.at(total, doc, _mix(code ^ seed))
        out.append(total.view(np.int64))
    return out[0], out[1]


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about PIECE bytes of text."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).to_pylist()]
        first, size = 0, 0
        for k, t in enumerate(texts):
            size += len(t) + 1
            if size >= PIECE or k + 1 == len(texts):
                yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                first, size = k + 1, 0


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


SIGNED = "row struct<file:string,at:bigint>, doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row, doc_id, a hash of its text, its set's size, name and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches, 3):
            doc, code = shingle_sets(texts)
            n = np.bincount(doc, minlength=len(texts))
            k1, k2 = set_keys(doc, code, len(texts))
            bands = band_keys(signatures(doc, code, len(texts)))[n > 0]
            sizes = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), _lists(bands.ravel(), sizes)], names=["row", "doc_id", "text_hash", "n", "k1", "k2", "bands"])

    source = keyed(docs, "documents", "row").select("row", F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return source.mapInArrow(run, SIGNED)


def full_sets(docs: DataFrame) -> DataFrame:
    """(k1, k2, shingles) of each row of ``docs``; shingles are sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches, 0):
            doc, code = shingle_sets(texts)
            k1, k2 = set_keys(doc, code, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), _lists(code.view(np.int64), np.bincount(doc, minlength=len(texts)))], names=["k1", "k2", "shingles"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "k1 long, k2 long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node it is connected with.

    Alternating large and small stars (Kiveris et al. 2014): each round hangs
    nodes under smaller neighbours, until all hang under a root. A round is two
    minima and two joins; minima are combined before the shuffle and written, so
    that a hub's join can be split.
    """
    now = store(edges.filter("a is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = store(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least2 = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least2, "u")
        small = store(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least2.select("u", F.col("m").alias("v"))).distinct(), "small")
        forget(now, least, large, least2)
        now = small
        # done when every node hangs under one other, and none of those under a third
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): row, doc_id, n_shingles, component_id, root, kept.

    root numbers the component (null without words), row is the key that
    ``keyed`` gives the row (of a copy of ``docs``, if that isn't a scan).
    """
    signed = store(sign(docs.select("doc_id", "text")), "signed")
    # a class for each set, numbered after its smallest id and one of its texts
    classes = store(
        signed.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("pick"), F.first("bands").alias("bands"))
        .select("k1", "k2", "n", "first", "pick", "bands", F.monotonically_increasing_id().alias("node")), "classes",
    )
    rows = classes.select("node", "n", F.explode("bands").alias("bucket"))
    hub = F.min(F.struct("node", "n")).alias("hub")
    hubs = store(rows.groupBy("bucket").agg(hub, F.count(F.lit(1)).alias("m")).filter("m > 1").select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "hubs")
    members = store(rows.join(hubs, "bucket"), "members")  # of buckets with more than one class
    candidates = members.select("node").distinct()
    chosen = classes.join(candidates, "node", "left_semi").select("node", "n", "k1", "k2", F.col("pick.doc_id").alias("p_id"), F.col("pick.text_hash").alias("p_hash"))
    chosen = store(chosen, "chosen")
    # the texts of one row for each candidate class, and from them its full set
    wanted = chosen.select("p_id", "p_hash").distinct().hint("merge")  # they grow with the corpus: a merge at every size
    texts = docs.select("doc_id", "text").withColumn("p_hash", F.xxhash64("text"))
    texts = texts.join(wanted, (texts["p_hash"] == wanted["p_hash"]) & texts["doc_id"].cast("long").eqNullSafe(wanted["p_id"]), "left_semi")
    sets = store(full_sets(texts).dropDuplicates(["k1", "k2"]).join(chosen.select("k1", "k2", "node", "n"), ["k1", "k2"]).select("node", "n", "shingles"), "sets")
    stars = members.filter("node <> hub").filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = store(confirmed(stars, sets, percent), "links")
    root = store(components(links), "roots")
    # links that a star has missed lie between components, which then are the nodes
    joined = components(_missed(members, sets, root, percent)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = classes.select("k1", "k2", "node", "first").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(joined, "root", "left").withColumn("root", F.coalesce("top", "root"))
    firsts = store(named.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    naming = store(named.join(firsts, "root").select("k1", "k2", "component_id", "root"), "naming")
    alone = signed.filter("n = 0").select("row", "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    linked = signed.filter("n > 0").select("row", "doc_id", "n", "k1", "k2").join(naming, ["k1", "k2"]).select("row", "doc_id", "n", "component_id", "root")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).select("row", "doc_id", F.col("n").alias("n_shingles"), "component_id", "root", kept.alias("kept"))


@shielded
def deduplicate(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id, and all rows without words."""
    docs = scanned(docs, "documents")
    found = near_duplicates(docs, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    picks = found.filter("root is not null").groupBy("root").agg(F.min_by("row", order).alias("__row")).select("__row")
    kept = store(picks.unionByName(found.filter("root is null").select(F.col("row").alias("__row"))), "kept")
    # the rows kept grow with the corpus: a merge at every size, never a broadcast
    return keyed(docs, "documents", "__row").join(kept.hint("merge"), "__row", "left_semi").drop("__row")


def _missed(members: DataFrame, sets: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of components that have classes of one bucket with a confirmed link."""
    placed = store(members.select("bucket", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    open_ = store(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket"), "open")
    inside = store(placed.join(open_, "bucket"), "inside")
    # shingles that at least two of these classes have: a link needs percent / (100 + percent) of both sizes in common
    own = sets.join(inside.select("node").distinct(), "node", "left_semi").select("node", "n", "shingles")
    own = store(own, "own")
    each = own.select("node", F.explode("shingles").alias("shingle"))
    common = store(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("shingle"), "common")
    shared_ = store(each.join(common, "shingle").groupBy("node").agg(F.count(F.lit(1)).alias("shared")), "shared")
    able = inside.join(own.select("node", "n").join(shared_, "node").filter(100 * F.col("shared") >= percent * F.col("n")), "node")
    able = store(able, "able")
    # a partner has at least percent % of this size, and no fewer shingles than the bucket's smallest
    least = store(able.groupBy("bucket").agg(F.min("n").alias("least_n"), F.max("shared").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("held")).filter("low < high").drop("low", "high"), "least")
    need = percent * (F.col("n") + F.greatest("least_n", F.col("n") * percent / 100))
    hopeful = able.join(least, "bucket").filter((100 + percent) * F.least("shared", "most") >= need - 1).select("bucket", "node", "root", "n", "shared", "m", "held")
    sized = store(hopeful, "hopeful")
    few = sized.filter(F.col("m") <= FEW)
    a = few.select("bucket", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = few.select("bucket", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    fits = (F.col("ra") < F.col("rb")) & ((100 + percent) * F.least("sa", "sb") >= percent * (F.col("na") + F.col("nb"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    pairs = a.join(b, "bucket").filter(fits).select("a", "b").distinct()
    small = confirmed(pairs, sets, percent)
    for end in ("a", "b"):
        small = small.join(root.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).select("a", "b")
    return small.unionByName(_between_blocks(sized.filter(F.col("m") > FEW), sets, percent))


def tile_links(root: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray, shingle: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of components that have a link between rows ``left`` and ``right`` of a tile.

    (owner, shingle) are the sets' members, owner a row of the tile. Counts of
    common members are products of 0/1 matrices over slices of the shingles.
    """
    known, column, count = np.unique(shingle, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = min(2048, max(1, int(shared.sum())))
    for low in range(0, int(shared.sum()), width):
        first, last = np.searchsorted(column, [low, low + width])
        has = np.zeros((len(root), width), np.float32)
        has[owner[first:last], column[first:last] - low] = 1
        both += has[left] @ has[right].T
    union = n[left][:, None] + n[right][None, :] - both
    x, y = np.nonzero((100 * both >= percent * union) & (root[left][:, None] != root[right][None, :]))
    x, y = left[x], right[y]
    _, one = np.unique(np.stack([np.minimum(root[x], root[y]), np.maximum(root[x], root[y])]), axis=1, return_index=True)
    return root[x[one]], root[y[one]]


def _between_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components with a confirmed link, of the buckets of ``rows`` (bucket, node, root, n, m, held).

    A bucket has as many blocks as its members or their shingles (held) need, so a task's memory is bounded by both.
    """

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        root, n, block = (tile.column(c).to_numpy() for c in ("root", "n", "block"))
        low, high = tile.column("i")[0].as_py(), tile.column("j")[0].as_py()
        lists = tile.column("shingles").chunk(0)
        owner = np.repeat(np.arange(len(root)), np.diff(lists.offsets.to_numpy()))
        a, b = tile_links(root, n, np.flatnonzero(block == low), np.flatnonzero(block == high), owner, lists.flatten().to_numpy(), percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = own.select("bucket", "node", "root", "n", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    held = tiles.join(sets.select("node", "shingles"), "node")
    return held.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
