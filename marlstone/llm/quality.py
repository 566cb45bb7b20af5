"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns whole texts into ``FEATURES`` numbers. Trees are grown on
the driver from a bounded sample of labelled rows: about ``SAMPLE`` of them (all,
where there are fewer; the share is exact, the number varies by its root), each
chosen by a hash of the row alone. So the sample doesn't grow with the corpus,
and it is the same however the rows are dealt out. Each tree is a complete binary tree in one array (children
of node i at 2i+1 and 2i+2), and scoring walks all trees for a batch of rows
with one numpy gather per level.

Defined results: null text counts as empty and is scored like any other. With
no label to learn from every score is 0.5; with one class alone it is near that
class's share. Rows with null quality are not learned from; a doc_id with
several labels gives a row for each, and rows that are alike in id, label and
statistics are learned from once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, store

SAMPLE = 20_000
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "lower", "upper", "digit", "space", "stop", "symbol", "other", "entropy",
    "distinct_words", "top_word", "hapax", "lines_per_char", "distinct_lines", "longest_line", "line_end_stop", "word_symbol", "upper_words",
    "digit_words", "pair_repeat", "compression", "long_words", "pipes", "capital_starts",
)
LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER = range(7)
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASS
    if _CLASS is None:
        out = np.full(0x110000, OTHER, np.uint8)
        for k in range(0x3000):
            c = chr(k)
            out[k] = UPPER if c.isupper() else LOWER if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".,;:!?'\"()-" else SYMBOL if c.isprintable() else OTHER
        _CLASS = out
    return _CLASS


def statistics(text: str) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    share = np.bincount(kind, minlength=7) / n
    p = np.bincount(np.minimum(code, 1023))
    p = p[p > 0] / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    pairs = len(set(zip(words, words[1:])))
    data = text.encode("utf-8", "surrogatepass")
    return [
        math.log1p(n), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()), *share.tolist(), float(-(p * np.log2(p)).sum()),
        len(seen) / w, max(seen.values(), default=0) / w, sum(v == 1 for v in seen.values()) / w, len(lines) / n, len(set(lines)) / len(lines), max(map(len, lines)) / n,
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines), sum(not x[-1].isalnum() and x[-1] not in ".,;:!?" for x in words) / w, sum(x.isupper() for x in words) / w,
        sum(any(map(str.isdigit, x)) for x in seen) / w, 1 - pairs / max(1, len(words) - 1), len(zlib.compress(data, 1)) / len(data), sum(lengths > 12) / w, seen.get("|", 0) / w, sum(x[:1].isupper() for x in words) / w,
    ]


@dataclass
class Trees:
    """Split feature, threshold and leaf value of each node, trees by nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for first in range(0, len(x), 4096):
            part = x[first : first + 4096]
            row = np.arange(len(part))[:, None]
            tree = np.arange(len(self.feature))[None, :]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            out[first : first + 4096] += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosting on logistic loss; each level of a tree is one histogram over (node, feature, bin)."""
    nodes = 2 ** (depth + 1) - 1
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    out = Trees(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf, np.float32), np.zeros((trees, nodes)), math.log(share / (1 - share)), depth)
    if not len(y) or y.min() == y.max():
        return Trees(out.feature[:0], out.threshold[:0], out.value[:0], out.base, depth)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")).astype(np.float32) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
    width = x.shape[1]
    flat = binned + np.arange(width) * bins
    margin = np.full(len(y), out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            low, many = 2**level - 1, 2**level
            key = ((node - low)[:, None] * (width * bins) + flat).ravel()
            sums = [np.bincount(key, weights=np.repeat(v, width), minlength=many * width * bins).reshape(many, width, bins).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least) | (all_h - left_h < least)] = 0
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-6:
                    out.feature[t, low + k], out.threshold[t, low + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[t, node]] > out.threshold[t, node])
        low, many = 2**depth - 1, 2**depth
        total = [np.bincount(node - low, weights=v, minlength=many) for v in (g, h)]
        out.value[t, low:] = -rate * total[0] / (total[1] + ridge)
        margin += out.value[t, node]
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of ``docs``; repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                stats = pa.array([statistics(t or "") for t in part.column(1).to_pylist()], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), stats], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<float>")


def _sampled(rows: DataFrame, n: int, bound: int, salt: int) -> DataFrame:
    """A share bound / n of distinct rows, by a hash of all their columns."""
    if n <= bound:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), *rows.columns), F.lit(1 << 31)) < int((1 << 31) * bound / n))


def train(stats: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Trees:
    """Trees from at most about ``bound`` labelled, not held-out rows of ``stats`` (doc_id, stats)."""
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("quality")).distinct()
    known = _sampled(known, known.count(), bound, 1)
    # about ``bound`` rows, unless ids repeat in stats
    rows = store(stats.join(known, "doc_id").select("doc_id", "stats", "quality").distinct(), "labelled")
    rows = _sampled(rows, rows.count(), bound, 2).toPandas()
    rows["order"] = rows["stats"].map(tuple)
    rows = rows.sort_values(["doc_id", "quality", "order"], kind="stable")
    x = np.array(rows["stats"].tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return grow(x, (rows["quality"].to_numpy(float) > 0).astype(float))


def score(stats: DataFrame, trees: Trees, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``stats``."""
    held = stats.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(values))], names=["doc_id", "score"])

    scored = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
