"""Packing along a space-filling curve.

A document's token ids are counted in ``HASHED`` columns; a fixed random matrix
projects that vector to ``DIMS`` dimensions, whose cells are numbered along a
Hilbert curve. The
documents are range-sorted by that number, laid end to end, and the stream is
cut every ``CAPACITY`` tokens, so that a sequence holds neighbours on the curve
and only the very last one can need padding.

Only (row, key, length) is sorted. Offsets are sums within each range plus the
totals of the ranges before it, a row per range. The ids are written once and meet their offsets in one join.

Defined results: null and empty texts are documents of the end id alone; very
long ones run over many sequences; an empty table gives no pieces; columns other
than doc_id, text and the window are ignored. Rows
that repeat are packed as often as they occur; ties on the curve go by doc_id
and row. ``window`` names a column whose values are packed one after another,
each along its own curve.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import store

CAPACITY, DIMS, CELL_BITS, END_ID, HASHED = 1024, 4, 8, 0, 2048
_MATRIX: list[np.ndarray] = []


def projection() -> np.ndarray:
    """A Gaussian row for each hashed column, the same on every machine."""
    if not _MATRIX:
        _MATRIX.append(np.random.Generator(np.random.PCG64(20240511)).standard_normal((HASHED, DIMS)))
    return _MATRIX[0]


def hilbert(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows by dimensions), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given by their ids.

    The count vector is scaled to length 1, so that each coordinate of its
    projection is a standard normal; cells cut the range of -4 to 4 evenly.
    """
    points = np.zeros((len(ids), DIMS))
    for first in range(0, len(ids), 64):
        part = ids[first : first + 64]
        column = (np.concatenate(part).astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(21)
        row = np.repeat(np.arange(len(part), dtype=np.uint32) * HASHED, [len(i) for i in part])
        counts = np.bincount(row + column, minlength=len(part) * HASHED).reshape(len(part), HASHED)
        norm = np.sqrt((counts.astype(float) ** 2).sum(axis=1))
        points[first : first + 64] = (counts @ projection()) / np.maximum(norm, 1)[:, None]
    cells = np.clip((points + 4) * (1 << CELL_BITS) / 8, 0, (1 << CELL_BITS) - 1)
    return hilbert(cells.astype(np.int64))


def encode_documents(docs: DataFrame, window: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Per row of ``docs``: row, doc_id, window, key, n and its packed ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [bpe.packed(t or "") for t in part.column(3).to_pylist()]
                keys = curve_keys([np.frombuffer(p, bpe.wide) for p in packed])
                end = np.array([END_ID], bpe.wide).tobytes()
                ids = [p + end for p in packed]
                wide = np.dtype(bpe.wide).itemsize
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(keys, pa.int64()), pa.array([len(i) // wide for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "doc_id", "window", "key", "n", "ids"])

    place = F.col(window).cast("string") if window else F.lit("")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(place, F.lit("")).alias("window"), F.col("text").cast("string"))
    return source.mapInArrow(run, "row long, doc_id long, window string, key long, n long, ids binary")


def offsets(encoded: DataFrame) -> DataFrame:
    """(row, at): where each document starts in the stream of all tokens in curve order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part), pa.int64()), pa.array(ends - n), batch.column(1)], names=["row", "part", "local", "n"])
            total = int(ends[-1]) if len(n) else total

    order = ["window", "key", "doc_id", "row"]
    light = encoded.select(*order, "n")
    placed = store(light.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(run, "row long, part long, local long, n long"), "places")
    totals = placed.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per range
    return placed.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("local")).alias("at"))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(encoded: DataFrame, at: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pieces of documents, each within one sequence of ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(tokens.load(tokenizer).wide)
        names = [x.split()[0] for x in PIECE.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.frombuffer(ids, wide).astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, capacity)
                    length = min(capacity - offset, n - start)
                    rows.append((doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, sequence, offset))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    # offsets grow with the rows, so the join is a merge at every size, never a broadcast
    joined = encoded.select("row", "doc_id", "n", "ids").join(at.hint("merge"), "row").select("doc_id", "at", "n", "ids")
    return joined.mapInArrow(run, PIECE)


def pack(docs: DataFrame, window: str | None = None, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    encoded = store(encode_documents(docs, window, tokenizer), "tokens")
    return cut(encoded, offsets(encoded), capacity, tokenizer)
