"""Content preservation: error rates of transcripts, similarity of vectors, loudness of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, text
from . import projections, ranks
from .jobs import load


def transcript_metrics(rows: DataFrame, language: str = "language") -> DataFrame:
    """``rows`` (reference, parent, child) with WER and CER of both and their drift; null where undefined."""
    lang = F.col(language)
    out = rows
    for side in ("parent", "child"):
        out = out.withColumn(f"{side}_wer", text.word_error_rate(F.col("reference"), F.col(side), lang)).withColumn(f"{side}_cer", text.char_error_rate(F.col("reference"), F.col(side), lang))
    return out.withColumn("wer_drift", F.col("child_wer") - F.col("parent_wer")).withColumn("cer_drift", F.col("child_cer") - F.col("parent_cer"))


def speaker_similarity(rows: DataFrame) -> DataFrame:
    return rows.withColumn("similarity", arrays.cosine(F.col("parent_vector"), F.col("child_vector")))


#: Rows of a block: two of them, and all their pairs, are what a task holds at once.
BLOCK = 1024


def pairs_within(rows: DataFrame, group: str, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of all two rows of a group with keys a < b, the cosine as ``arrays.cosine`` gives it.

    A group's rows are cut into blocks in the order of their keys, and each two
    blocks meet in a cell of their own: one matrix product there, whatever the
    size of the group. A row is sent once to each block of its group. Keys are numbers.
    """
    import numpy as np
    import pyarrow as pa

    own = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).filter("g is not null and k is not null")
    placed = ranks.ranked(own, ["g"], ["k"], "r", "n")
    at, last = F.floor((F.col("r") - 1) / block), F.floor((F.col("n") - 1) / block)
    met = placed.select("g", "k", "v", at.alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    cells = met.select("g", F.least("at", "other").alias("low"), F.greatest("at", "other").alias("high"), "at", "k", "v")
    kind = own.schema["k"].dataType
    schema = T.StructType().add("a", kind).add("b", kind).add("similarity", "double")

    def cell(table: pa.Table) -> pa.Table:
        at, keys, vectors = table["at"].to_numpy(), table["k"].combine_chunks(), table["v"].combine_chunks()
        place = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        left, right = np.flatnonzero(at == table["low"][0].as_py()), np.flatnonzero(at == table["high"][0].as_py())
        starts = vectors.offsets.to_numpy()
        sizes, values = np.diff(starts), vectors.values
        holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        sizes[~vectors.is_valid().to_numpy(zero_copy_only=False) | (holes[starts[1:]] > holes[starts[:-1]])] = 0
        flat = values.to_numpy(zero_copy_only=False).astype(float)
        similarity, known = np.zeros((len(left), len(right))), np.zeros((len(left), len(right)), bool)
        with np.errstate(all="ignore"):
            for size in np.intersect1d(sizes[left], sizes[right]):
                if size:
                    i, j = np.flatnonzero(sizes[left] == size), np.flatnonzero(sizes[right] == size)
                    x, y = (flat[starts[side][:, None] + np.arange(size)] for side in (left[i], right[j]))
                    norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
                    similarity[np.ix_(i, j)], known[np.ix_(i, j)] = x @ y.T / norm, ~(norm <= 0)
        i, j = np.nonzero(place[left][:, None] < place[right])
        shown = pa.array(similarity[i, j], mask=~known[i, j], from_pandas=False)
        return pa.table({"a": keys.take(pa.array(left[i])), "b": keys.take(pa.array(right[j])), "similarity": shown})

    return cells.groupBy("g", "low", "high").applyInArrow(cell, schema)


class Backend:
    """A model loaded once for each batch stream; ``transcribe`` gets a list of rows and returns as many texts.

    Subclass it, or give a module:factory name to ``load``.
    """

    def transcribe(self, rows: list[dict]) -> list[str]:
        raise NotImplementedError


class Identity(Backend):
    """Echoes the reference: what the model-free default does."""

    def transcribe(self, rows: list[dict]) -> list[str]:
        return [r.get("reference") or "" for r in rows]


def transcribe(rows: DataFrame, make: type[Backend] | str = Identity, out: str = "hypothesis", **options) -> DataFrame:
    """``rows`` with a transcript from the backend, and a status.

    Rows whose status isn't ok already are passed over. A batch that fails is
    tried row by row; then the error is the row's status.
    """
    import pandas as pd

    schema = T.StructType([f for f in rows.schema.fields if f.name not in (out, "status")]).add(out, "string").add("status", "string")
    given = rows if "status" in rows.columns else rows.withColumn("status", F.lit("ok"))

    def run(frames):
        backend = load(make, **options) if isinstance(make, str) else make(**options)
        for frame in frames:
            state, said = frame["status"].tolist(), [None] * len(frame)
            due = [k for k, s in enumerate(state) if s == "ok"]
            records = frame.to_dict("records")
            try:
                for k, t in zip(due, backend.transcribe([records[k] for k in due])):
                    said[k] = t
            except Exception:  # noqa: BLE001  then one by one
                for k in due:
                    try:
                        said[k] = backend.transcribe([records[k]])[0]
                    except Exception as error:  # noqa: BLE001
                        state[k] = f"failed: {type(error).__name__}"
            frame[out] = pd.Series(said, index=frame.index, dtype=object)
            frame["status"] = pd.Series(state, index=frame.index, dtype=object)
            yield frame[schema.names]

    return given.mapInPandas(run, schema)


def analyse(rows: DataFrame, make: type[Backend] | str = Identity, language: str = "language", **options) -> DataFrame:
    """All stages on rows (reference, parent_path, child_path, child_duration): the status ladder, transcripts of parent and child, error rates. A row that fails a stage skips the later ones and has null figures."""
    judged = projections.status_ladder(rows)
    heard = transcribe(transcribe(judged, make, "parent", **options), make, "child", **options)
    figures = transcript_metrics(heard, language)
    ok = F.col("status") == "ok"
    return figures.select(*[F.when(ok, F.col(c)).alias(c) if c.endswith(("_wer", "_cer", "wer_drift", "cer_drift")) else F.col(c) for c in figures.columns])
