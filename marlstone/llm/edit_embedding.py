"""Document fingerprints by a randomised edit embedding.

A random walk reads a text of n characters into 3n symbols: at step j it emits
the character under its pointer and moves on by R[j, character], a bit that all
texts share. Walks over texts that differ by few edits soon run in step again,
so edit distance becomes Hamming distance between the emitted strings (the
embedding of Chakraborty, Goldenberg and Koucky). The fingerprint samples the
emitted string: for every octave [2^k, 2^(k+1)) of steps ``SAMPLES`` positions,
the same for all texts, four bits a symbol. Likeness is the share of equal
samples, octaves weighted by their length, that is an estimate of the share of
equal symbols over the longer of the two walks.

Near texts come from bit-sampled banding of the fingerprint's symbols and are
verified by likeness, by stars and then exactly within buckets; ``near_classes``
joins what is linked. A band holds ``SYMBOLS`` symbols, so texts of likeness 0.9
share one of 16 bands with a probability of 0.96, unlike ones (0.3) with 2e-7.

The random bits repeat after ``PERIOD`` steps, and characters are folded to 255
symbols; both only make unlike texts seem a little more alike.

Defined results: null and empty texts have the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another one 0; they are in no class
with others. Equal texts have equal fingerprints on every machine. Repeated rows
and ids stay separate rows, in the order of ids, then of a hash of the text. Very
long texts are read to their end. An empty table gives no rows; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scanned, store
from .minhash import BLOCK, components

SAMPLES, PERIOD, PAD = 32, 8191, 255
BANDS, SYMBOLS = 16, 16
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Below so many live walks a loop over single steps costs less than a numpy step over all.
FEW = 48


class Walk:
    """The shared random bits and sampled steps; made once in each Python worker."""

    def __init__(self, seed: int = 20240607):
        bits = np.random.Generator(np.random.PCG64(seed))
        self.moves = bits.integers(0, 2, (PERIOD, 256), dtype=np.int64)
        self.moves[:, PAD] = 0
        self.rows = [r.astype(np.uint8).tobytes() for r in self.moves]
        self.nibble = bits.integers(0, 16, 256).astype(np.uint8)
        self.steps: list[int] = [0, 1, 2, 3]
        for k in range(2, 40):
            low = 1 << k
            self.steps += sorted({low + int(x) for x in bits.integers(0, low, SAMPLES)})

    def sampled(self, length: int) -> int:
        """How many sampled steps lie below ``length``."""
        return int(np.searchsorted(self.steps, length))


_WALK: Walk | None = None


def shared_walk() -> Walk:
    global _WALK
    if _WALK is None:
        _WALK = Walk()
    return _WALK


def _symbols(text: str) -> np.ndarray:
    """Characters as numbers from 0 to 254."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((code ^ (code >> 8) * 31) % 255).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprints of whole texts; the walks advance together, longest last."""
    walk = shared_walk()
    symbols = [_symbols(t) for t in texts]
    length = np.array([len(s) for s in symbols], np.int64)
    order = np.argsort(length, kind="stable")
    start = np.zeros(len(texts), np.int64)
    start[1:] = np.cumsum(length[:-1] + 1)
    buffer = np.full(int((length + 1).sum()), PAD, np.uint8)
    for s, at in zip(symbols, start):
        buffer[at : at + len(s)] = s
    position, ends = start[order], 3 * length[order]
    count = [walk.sampled(e) for e in ends.tolist()]
    taken = np.zeros((len(texts), max(count, default=0)), np.uint8)
    live = int(np.searchsorted(ends, 0, side="right"))
    step, sample, moves = 0, 0, walk.moves
    while len(ends) - live >= FEW:
        until = int(ends[live])  # the shortest walk that goes on
        view = position[live:]
        while step < until:
            here = buffer[view]
            if step == walk.steps[sample]:
                taken[live:, sample] = here
                sample += 1
            view += moves[step % PERIOD][here]
            step += 1
        live = int(np.searchsorted(ends, step, side="right"))
    wanted, rows = walk.steps, walk.rows
    for k in range(live, len(ends)):
        data, p, n, j, got = buffer[start[order[k]] : start[order[k]] + length[order[k]] + 1].tobytes(), int(position[k] - start[order[k]]), int(ends[k]), step, sample
        while j < n:
            stop = min(n, wanted[got])
            while j < stop:
                last = min(stop, j - j % PERIOD + PERIOD)
                for row in rows[j % PERIOD : j % PERIOD + last - j]:
                    p += row[data[p]]
                j = last
            if j < n:
                taken[k, got] = data[p]
                got += 1
                p += rows[j % PERIOD][data[p]]
                j += 1
    text = HEX[walk.nibble[taken]]
    out = [""] * len(texts)
    for k, i in enumerate(order.tolist()):
        out[i] = text[k, : count[k]].tobytes().decode()
    return out


_WEIGHTS: np.ndarray | None = None


def _weights() -> np.ndarray:
    """The steps of an octave that a sample stands for."""
    global _WEIGHTS
    if _WEIGHTS is None:
        steps = np.array(shared_walk().steps)
        octave = np.maximum(np.floor(np.log2(np.maximum(steps, 1))), 1).astype(int)
        _WEIGHTS = 2.0**octave / np.bincount(octave)[octave]
    return _WEIGHTS


def likeness(a: str, b: str) -> float:
    """Estimated share of equal symbols over the longer walk, from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    weights = _weights()
    n, m = min(len(a), len(b)), max(len(a), len(b))
    same = np.frombuffer(a[:n].encode(), np.uint8) == np.frombuffer(b[:n].encode(), np.uint8)
    return float(weights[:n][same].sum() / weights[:m].sum())


def likeness_grid(left: list[str], right: list[str]) -> np.ndarray:
    """``likeness`` of each of ``left`` with each of ``right``."""
    weights = _weights()
    width = max(map(len, [*left, *right]), default=0)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    # unlike fillers behind the ends of both sides are equal to nothing
    codes = [np.frombuffer("".join(x.ljust(width, fill) for x in side).encode(), np.uint8).reshape(len(side), width) for side, fill in ((left, "x"), (right, "y"))]
    whole = np.concatenate([[0.0], np.cumsum(weights[:width])])
    out = np.empty((len(left), len(right)))
    for k, row in enumerate(codes[0]):
        out[k] = (codes[1] == row) @ weights[:width] / np.maximum(whole[np.maximum(sizes[1], sizes[0][k])], 1e-12)
    return out


def edited(text: str, following: str) -> str:
    """``text``, its last floor(n/2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


PRINT = "doc_id long, k1 long, k2 long, fingerprint string, bands array<long>"


def band_keys(fingerprint: str, bands: int = BANDS, symbols: int = SYMBOLS) -> list[int]:
    """Bucket numbers of a fingerprint.

    A band samples ``symbols`` symbols of the last octaves, at places that all
    fingerprints of like length have; near the end of an octave the places of the
    following one count as well, since a near text may reach into it.
    """
    n = len(fingerprint)
    code = np.frombuffer(fingerprint.encode(), np.uint8)
    keys = []
    for top in sorted({n // SAMPLES, (n + EDGE) // SAMPLES}):
        for band, at in enumerate(_places(top, bands, symbols)):
            keys.append(xxhash.xxh64_intdigest(code[at].tobytes(), top * bands + band) - (1 << 63))
    return keys


#: Samples by which the fingerprints of near texts may differ in length: a tenth of an octave's walk and a bit.
EDGE = 5
_PLACES: dict[tuple[int, int, int], np.ndarray] = {}


def _places(top: int, bands: int, symbols: int) -> np.ndarray:
    """Places of the samples of each band for fingerprints that end in octave ``top``; later ones, which stand for more steps, are likelier."""
    if (top, bands, symbols) not in _PLACES:
        high = max(1, top * SAMPLES - EDGE)
        weights = _weights()[:high]
        pick = np.random.Generator(np.random.PCG64(top))
        _PLACES[top, bands, symbols] = pick.choice(high, (bands, symbols), p=weights / weights.sum())
    return _PLACES[top, bands, symbols]


def print_documents(docs: DataFrame, bands: int = BANDS, symbols: int = SYMBOLS) -> DataFrame:
    """Per row of ``docs`` its fingerprint, 128 bits that name it, and its buckets; empty fingerprints have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                prints = fingerprints([t or "" for t in part.column(1).to_pylist()])
                names = [xxhash.xxh128_digest(p) for p in prints]
                halves = [np.array([int.from_bytes(x[k : k + 8], "little", signed=True) for x in names], np.int64) for k in (0, 8)]
                buckets = [band_keys(p, bands, symbols) if p else [] for p in prints]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, halves), pa.array(prints, pa.string()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "fingerprint", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PRINT)


def _slices(batch: pa.RecordBatch, column: int, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of a text column."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0)
    first = held = 0
    for k, n in enumerate(lengths.to_pylist()):
        held += n
        if held >= size or k + 1 == batch.num_rows:
            yield batch.slice(first, k + 1 - first)
            first, held = k + 1, 0


def near_links(prints: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (node, k1, k2, rep, rows, fingerprint) of equal fingerprints, links (x, y, likeness) between their nodes, and (node, root) of all linked nodes.

    The links join all classes of near texts which share a bucket: in a bucket
    every class first meets the smallest one. What such a star misses is found
    exactly: buckets whose classes aren't in one component by then are compared
    block by block, and a tile gives a link for each two components.
    """
    classes = prints.filter("fingerprint <> ''").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands"))
    classes = store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    named = classes.select("node", "fingerprint")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = np.array([likeness(a, b) for a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3)))], float)
            keep = pa.array(like >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(like).filter(keep)], names=["x", "y", "likeness"])

    def tile(rows: pa.Table) -> pa.Table:
        low, high = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        node, root, block = (rows.column(c).to_numpy() for c in ("node", "root", "block"))
        prints = np.array(rows.column("fingerprint").to_pylist(), object)
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        like = likeness_grid(prints[left].tolist(), prints[right].tolist())
        x, y = np.nonzero((like >= threshold) & (root[left][:, None] != root[right][None, :]))
        ra, rb = root[left[x]], root[right[y]]
        _, one = np.unique(np.stack([np.minimum(ra, rb), np.maximum(ra, rb)]), axis=1, return_index=True)
        a, b = node[left[x[one]]], node[right[y[one]]]
        return pa.table({"x": pa.array(np.minimum(a, b), pa.int64()), "y": pa.array(np.maximum(a, b), pa.int64()), "likeness": pa.array(like[x[one], y[one]], pa.float64())})

    rows = classes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    hubs = store(rows.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1"), "hubs")
    members = store(rows.join(hubs, "bucket"), "members")
    pairs = members.filter("node <> hub").select(F.col("hub").alias("x"), F.col("node").alias("y")).distinct()
    ends = lambda c: named.select(F.col("node").alias(c), F.col("fingerprint").alias(f"{c}_print"))
    met = pairs.join(ends("x"), "x").join(ends("y"), "y").select("x", "y", "x_print", "y_print")
    stars = store(met.mapInArrow(verified, "x long, y long, likeness double"), "stars")
    root = store(components(stars.select(F.col("x").alias("a"), F.col("y").alias("b"))), "roots")
    placed = store(members.join(root, "node", "left").select("bucket", "node", "m", F.coalesce("root", "node").alias("root")), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = placed.join(open_, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tiles = own.select("bucket", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # tiles are small to send and long to compute, so they are dealt over all partitions, whatever their size
    dealt = tiles.join(named, "node").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j")
    missed = dealt.groupBy("bucket", "i", "j").applyInArrow(tile, "x long, y long, likeness double")
    missed = store(missed, "missed")
    # what a star has missed lies between components, which then are the nodes
    ends_ = missed.select(F.col("x").alias("a"), F.col("y").alias("b"))
    for end in ("a", "b"):
        ends_ = ends_.join(root.select(F.col("node").alias(end), F.col("root").alias("r")), end, "left").withColumn(end, F.coalesce("r", end)).drop("r")
    top = components(ends_).select(F.col("node").alias("root"), F.col("root").alias("top"))
    own = root.unionByName(missed.select(F.explode(F.array("x", "y")).alias("node")).join(root, "node", "left_anti").distinct().select("node", F.col("node").alias("root")))
    joined = own.join(top, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return classes, stars.unionByName(missed).dropDuplicates(["x", "y"]), joined


def near_pairs(docs: DataFrame, threshold: float = 0.8, bands: int = 24, symbols: int = 6) -> DataFrame:
    """The links of ``near_links`` as (a, b, likeness), each class named by its smallest doc_id, or by null where it has no other."""
    classes, links, _ = near_links(store(print_documents(docs, bands, symbols), "prints"), threshold)
    named = links.join(classes.select(F.col("node").alias("x"), F.col("rep").alias("x_rep")), "x").join(classes.select(F.col("node").alias("y"), F.col("rep").alias("y_rep")), "y")
    swap = F.col("x_rep").isNull() | (F.col("y_rep") < F.col("x_rep"))  # the smaller id first, null last
    return named.select(F.when(swap, F.col("y_rep")).otherwise(F.col("x_rep")).alias("a"), F.when(swap, F.col("x_rep")).otherwise(F.col("y_rep")).alias("b"), "likeness")


def near_classes(docs: DataFrame, threshold: float = 0.9, bands: int = BANDS, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, k1, k2, near_class) of the rows that aren't alone: near_class is the smallest doc_id that links lead to."""
    prints = store(print_documents(docs, bands, symbols), "prints")
    classes, _, root = near_links(prints, threshold)
    light = classes.select("node", "k1", "k2", "rep", "rows").join(root, "node", "left").withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "node"))
    light = store(light.filter("linked or rows > 1"), "light")
    firsts = light.groupBy("root").agg(F.min("rep").alias("near_class"))
    return prints.select("doc_id", "k1", "k2").join(light.join(firsts, "root").select("k1", "k2", "near_class"), ["k1", "k2"]).distinct()


PLACED = "part long, ghost boolean, doc_id long, kind int, order long, body binary, k1 long, k2 long, near_class long"


def with_next(docs: DataFrame, beside: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Rows so that in each part, by (doc_id, order), every row's successor follows; their text is compressed for the way.

    doc_id is cut into ranges at ids that occur in it. The first row of each
    range also goes, as a ghost, to the end of the range before; the very first
    to the last range. A range therefore needs nothing from another one, and no
    task sees all rows. Null ids come first. ``beside`` (doc_id, k1, k2,
    near_class) goes to the same ranges, before the rows of its ids (kind 0).
    """
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts  # several to a task, so that tasks are alike
    cuts = rows.agg(F.percentile_approx("doc_id", [(k + 1) / ranges for k in range(ranges)], 20 * ranges).alias("cut"), F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    low, nulls = cuts["low"], bool(cuts["nulls"])
    bounds = sorted({c for c in cuts["cut"] or [] if c is not None and c > low} | ({low} if nulls and low is not None else set()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, press = np.array(bounds, np.int64), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            part = np.where(none, 0, np.searchsorted(edges, value, side="right")).astype(np.int64)
            text = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            first = none if nulls else ~none & (value == low)
            starts = ~none & np.isin(value, edges) & ~first
            ghost = np.flatnonzero(text & (first | starts))
            source = np.concatenate([np.arange(batch.num_rows), ghost])
            to = np.concatenate([part, np.where(first[ghost], len(edges), part[ghost] - 1)])
            flag = np.arange(len(source)) >= batch.num_rows
            body = batch.column(1).to_pylist()
            body = [None if b is None else press.compress(b.encode()) for b in body]
            taken = lambda k: batch.column(k).take(pa.array(source))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to), pa.array(flag), taken(0), pa.array(text[source].astype(np.int32)), taken(2), pa.array([body[k] for k in source.tolist()], pa.binary()), taken(3), taken(4), taken(5)],
                names=[x.split()[0] for x in PLACED.split(", ")],
            )

    empty = [F.lit(None).cast("long").alias(c) for c in ("k1", "k2", "near_class")]
    sent = rows.select("doc_id", "text", F.xxhash64("text").alias("order"), *empty)
    if beside is not None:
        sent = sent.unionByName(beside.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("order"), "k1", "k2", "near_class"))
    return sent.mapInArrow(place, PLACED).repartition(parts, "part").sortWithinPartitions("part", "ghost", "doc_id", "kind", "order")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long"


def edit_report(docs: DataFrame, batch_chars: int = 12_000_000, threshold: float = 0.9) -> DataFrame:
    """Per row: fingerprints of its text and of its text edited with the next one, how alike they are, and its class of near texts.

    near_class is the smallest doc_id of the class that ``near_classes`` gives the row; its own if it is alone.
    """
    import hashlib

    def close(rows: list[tuple], known: dict) -> pa.RecordBatch:
        """Rows (part, ghost, doc_id, text) whose successor is the next in the list; the last row is there as a successor alone."""
        texts = [r[3] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        prints = fingerprints(texts + changed)
        own, other = prints[: len(texts)], prints[len(texts) :]
        keep = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
        columns = [
            pa.array([rows[k][2] for k in keep], pa.int64()),
            pa.array([len(texts[k]) for k in keep], pa.int64()),
            pa.array([hashlib.sha256(changed[k].encode()).hexdigest() for k in keep], pa.string()),
            pa.array([own[k] for k in keep], pa.string()),
            pa.array([other[k] for k in keep], pa.string()),
            pa.array([likeness(own[k], other[k]) for k in keep], pa.float64()),
            pa.array([likeness(own[k], own[k + 1]) for k in keep], pa.float64()),
            pa.array([known.get((rows[k][2], xxhash.xxh128_digest(own[k])), rows[k][2]) for k in keep], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        known: dict = {}
        size = 0
        for batch in batches:
            for part, ghost, doc_id, kind, _, body, k1, k2, near in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    known[doc_id, k1.to_bytes(8, "little", signed=True) + k2.to_bytes(8, "little", signed=True)] = near
                    continue
                held.append((part, ghost, doc_id, unpress.decompress(body).decode()))
                size += len(held[-1][3])
                if size >= batch_chars and len(held) > 1:
                    yield close(held, known)
                    last = held[-1][2]
                    known = {k: v for k, v in known.items() if k[0] == last}
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield close(held, known)

    docs = scanned(docs, "documents")
    return with_next(docs, near_classes(docs, threshold)).mapInArrow(run, RESULT)
