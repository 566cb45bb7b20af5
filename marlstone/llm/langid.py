"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run over Arrow batches in numpy. A text is lower-cased,
runs of characters that are not letters become one word boundary, and the 1- to
3-grams inside words (boundaries included at their ends) are hashed to
``BUCKETS`` columns. Counts of all learnable documents are summed by Spark; the
log-probability matrix of languages by buckets is broadcast, in blocks of at
most ``BLOCK`` languages (64 MB of float32). Documents pass the blocks one after
another and carry the best language so far along with the sum that the score
needs, so any number of languages will do; after every ``CHAIN`` blocks the rows
are written. The driver holds one block, and name and total of each language.

Defined results: null text, or text without a letter, is ``und`` with score 0.
So is everything if there is nothing to learn from. Null lang rows, and in the
query those without doc_id, are not learned from. Very long texts count with all
their grams. Rows that repeat are learned from as often as they occur, and each
is scored. An empty table gives no rows. Ties go to the language whose name sorts first. Input columns
that bear an output's name are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, store

ORDERS, BITS = (1, 2, 3), 16
BUCKETS, BLOCK, CHAIN = 1 << BITS, 256, 4
#: Grams that count as evidence at most: a long text is not surer than so many independent grams.
EVIDENCE = 24.0
PIECE = 1_500_000

_LETTER: np.ndarray | None = None
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _LETTER


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Slices of about ``PIECE`` characters, so that working memory doesn't follow the batch."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield first, [x or "" for x in texts[first : k + 1]]
            first, size = k + 1, 0
    if first < len(texts):
        yield first, [x or "" for x in texts[first:]]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every gram, and whether each document has a letter."""
    low = [t.lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(low), np.int64)
    starts[1:] = np.cumsum([len(t) + 1 for t in low[:-1]])
    letter = _letters()[code]
    owner = np.zeros(len(code), np.int32)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    keep[-1] = True
    symbol = np.where(letter, code, 0)[keep].astype(np.uint64)
    owner = owner[keep]
    has = np.zeros(len(texts), bool)
    has[owner[symbol > 0]] = True
    docs, buckets = [], []
    for n in ORDERS:
        if len(symbol) < n:
            continue
        count = len(symbol) - n + 1
        h = np.full(count, n, np.uint64)
        ok = np.ones(count, bool) if n > 1 else symbol > 0
        for k in range(n):
            part = symbol[k : k + count]
            h = (h ^ part) * _FACTORS[k]
            if 0 < k < n - 1:
                ok &= part > 0
        if n == 2:
            ok = (symbol[:count] > 0) | (symbol[1 : 1 + count] > 0)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        docs.append(owner[:count][ok])
        buckets.append((h[ok] >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(docs), np.concatenate(buckets), has


@dataclass
class Block:
    """Languages, sorted, with their log-probabilities."""

    langs: list[str]
    log_prob: np.ndarray  # languages by buckets, float32
    log_prior: np.ndarray

    def advance(self, texts: list[str | None], state: list[tuple]) -> list[tuple]:
        """``state`` of each text after this block: language, its total and shown value, and of all shown values the top and the sum of exp(value - top)."""
        out = []
        for first, part in pieces(texts):
            doc, bucket, has = grams(part)
            size = np.maximum(np.bincount(doc, minlength=len(part)), 1)
            total = np.stack([np.bincount(doc, weights=row[bucket], minlength=len(part)) for row in self.log_prob], axis=1)
            shown = total / size[:, None] * np.minimum(size, EVIDENCE)[:, None] + self.log_prior
            total += self.log_prior
            best = total.argmax(axis=1)
            top = shown.max(axis=1)
            sums = np.exp(shown - top[:, None]).sum(axis=1)
            for k, (b, h) in enumerate(zip(best.tolist(), has.tolist())):
                before = state[first + k]
                if not h:
                    out.append(before)
                    continue
                now = self.langs[b], float(total[k, b]), float(shown[k, b]), float(top[k]), float(sums[k])
                if before[0] is not None:
                    ahead = max(now[3], before[3])
                    joint = now[4] * np.exp(now[3] - ahead) + before[4] * np.exp(before[3] - ahead)
                    now = (*(now if now[1] > before[1] else before)[:3], ahead, float(joint))
                out.append(now)
        return out


@dataclass
class Model:
    """Counts by language on disk, and of each language its name, grams and documents."""

    totals: list[tuple[str, int, int]]
    counts: DataFrame
    alpha: float

    def blocks(self) -> Iterator[Block]:
        seen = sum(n for _, _, n in self.totals)
        for first in range(0, len(self.totals), BLOCK):
            part = self.totals[first : first + BLOCK]
            rows = self.counts.filter(F.col("lang").between(part[0][0], part[-1][0])).toPandas()  # at most BLOCK x BUCKETS rows
            number = {x: k for k, (x, _, _) in enumerate(part)}
            whole = np.array([g for _, g, _ in part]) + self.alpha * BUCKETS
            log_prob = np.broadcast_to(np.log(self.alpha / whole)[:, None], (len(part), BUCKETS)).astype(np.float32)
            at = rows["lang"].map(number).to_numpy(int)
            log_prob[at, rows["bucket"].to_numpy(int)] = np.log((rows["n"].to_numpy(float) + self.alpha) / whole[at])
            yield Block([x for x, _, _ in part], log_prob, np.log(np.array([n for _, _, n in part]) / seen))


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) summed over all rows of ``labelled`` (lang, text); bucket -1 counts documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = (c.to_pylist() for c in batch.columns)
            for first, part in pieces(texts):
                doc, bucket, _ = grams(part)
                own = langs[first : first + len(part)]
                names = {x: k for k, x in enumerate(sorted(set(own)))}
                number = np.array([names[x] for x in own], np.int64)
                code, n = np.unique(number[doc] * BUCKETS + bucket, return_counts=True)
                ends = np.searchsorted(code, np.arange(len(names) + 1) * BUCKETS)
                seen = np.bincount(number, minlength=len(names))
                for name, k in names.items():
                    held = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    held[code[ends[k] : ends[k + 1]] - k * BUCKETS] += n[ends[k] : ends[k + 1]]
                    held[-1] += seen[k]
                if len(sums) > 64:  # a worker holds half a megabyte for each language
                    yield from flushed(sums)
        yield from flushed(sums)

    def flushed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at), pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "bucket", "n"])
        sums.clear()

    return labelled.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learnable: Column, alpha: float = 0.5) -> Model:
    """Learns from all rows with lang and text for which ``learnable`` holds."""
    counts = store(gram_counts(docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")), "grams")
    of = lambda kept: F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0))
    totals = counts.groupBy("lang").agg(of(F.col("bucket") >= 0).alias("grams"), of(F.col("bucket") < 0).alias("docs")).collect()  # a row per language
    # in the order of Spark's strings, by which a block's rows are found again
    return Model(sorted(((r["lang"], r["grams"], r["docs"]) for r in totals), key=lambda x: x[0].encode()), counts.filter("bucket >= 0"), alpha)


STATE = "__lang string, __total double, __shown double, __top double, __sum double"


def identify(docs: DataFrame, model: Model, carry: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``carry`` of ``docs`` with the predicted language and its score, called ``names``."""
    own = [c for c in carry if c not in names]
    state = [x.split() for x in STATE.split(", ")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c {k}") for k, c in enumerate(own)], F.col("text").cast("string").alias("__text"), *[F.lit(None).cast(kind).alias(x) for x, kind in state])
    schema = rows.schema
    context = docs.sparkSession.sparkContext
    for number, block in enumerate(model.blocks()):
        if number and number % CHAIN == 0:
            rows = store(rows, "scored")
        rows = rows.mapInArrow(_advance(context.broadcast(block)), schema)
    score = F.when(F.col("__lang").isNotNull(), F.exp(F.col("__shown") - F.col("__top")) / F.col("__sum")).otherwise(0.0)
    return rows.select(*[F.col(f"c {k}").alias(c) for k, c in enumerate(own)], F.coalesce("__lang", F.lit("und")).alias(names[0]), score.alias(names[1]))


def _advance(held):
    """A step over Arrow batches whose last columns are the text and its state."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.float64()] * 4]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                state = held.value.advance(part.column(part.num_columns - 6).to_pylist(), list(zip(*(c.to_pylist() for c in part.columns[-5:]))))
                columns = [pa.array(c, k) for c, k in zip(zip(*state), kinds)] if state else part.columns[-5:]
                yield pa.RecordBatch.from_arrays([*part.columns[:-5], *columns], names=part.schema.names)

    return step


@shielded
def keep_identified(docs: DataFrame, learnable: Column, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language can't be told: ``und``, or a score below ``least``."""
    model = train(docs, learnable)
    scored = identify(docs, model, docs.columns, ("__lang", "__score"))
    return scored.filter((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
