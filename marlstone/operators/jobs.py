"""Jobs that need a program of the user's: a worker is loaded once in each Python process and runs many jobs.

A job that fails doesn't fail the others: its row says so. Jobs that are done
already are skipped, so a table of results can be completed by running again.
"""

from __future__ import annotations

import importlib
import inspect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "status string, output string, error string"


class Worker:
    """Subclass it: ``setup`` loads what all jobs need, ``run`` gets a job's row and returns its output as text."""

    def setup(self) -> None:
        """Called once in each process, before the first job."""

    def run(self, job: dict) -> str:
        raise NotImplementedError


def load(spec: str, **options):
    """What the factory ``module:name`` makes; options that it doesn't take are left out."""
    module, _, name = spec.partition(":")
    factory = getattr(importlib.import_module(module), name)
    taken = inspect.signature(factory).parameters
    every = any(p.kind is p.VAR_KEYWORD for p in taken.values())
    return factory(**{k: v for k, v in options.items() if every or k in taken})


def run_jobs(jobs: DataFrame, make: type[Worker] | str, key: str = "job_id", finished: DataFrame | None = None, **options) -> DataFrame:
    """Per job: key, status (ok, skipped_existing or failed), output and error. ``finished`` (key, output) names jobs that aren't run again."""
    if finished is not None:
        done = finished.groupBy(key).agg(F.min("output").alias("output"))
        kept = jobs.select(key).join(done, key).select(key, F.lit("skipped_existing").alias("status"), "output", F.lit(None).cast("string").alias("error"))
        return _run(jobs.join(done.select(key), key, "left_anti"), make, key, options).unionByName(kept)
    return _run(jobs, make, key, options)


def _run(jobs: DataFrame, make, key: str, options: dict) -> DataFrame:
    import pandas as pd

    kind = jobs.schema[key].dataType.simpleString()

    def run(frames):
        worker = load(make, **options) if isinstance(make, str) else make(**options)
        worker.setup()
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                try:
                    out.append((job[key], "ok", worker.run(job), None))
                except Exception as error:  # noqa: BLE001  the others go on
                    out.append((job[key], "failed", None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[key, "status", "output", "error"])

    return jobs.mapInPandas(run, f"`{key}` {kind}, {RESULT}")


def failure_text(lines: DataFrame, keys: list[str], ord: str = "ord", line: str = "line", most: int = 40) -> DataFrame:
    """Of each log the last traceback, at most ``most`` lines of it; without one the last ``most`` lines."""
    from . import ranks

    placed = ranks.ranked(lines, keys, [ord], "__r", "__n")
    start = F.col(line).startswith("Traceback (most recent call last):")
    last = placed.filter(start).groupBy(*keys).agg(F.max("__r").alias("__start"))
    met = placed.join(last, keys, "left")
    kept = F.when(F.col("__start").isNotNull(), (F.col("__r") >= F.col("__start")) & (F.col("__r") < F.col("__start") + most)).otherwise(F.col("__r") > F.col("__n") - most)
    return met.filter(kept).select(*lines.columns)
