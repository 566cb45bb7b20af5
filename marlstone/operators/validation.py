"""Checks of probed files: the first failure as text, null if there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.buckets import fixed


def ladder(*steps: tuple[Column, Column | str]) -> Column:
    """The message of the first condition that holds; null without conditions."""
    out = None
    for test, message in steps:
        value = F.lit(message) if isinstance(message, str) else message
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast("string") if out is None else out


def _differs(name: str, want) -> tuple[Column, Column]:
    got = F.col(name)
    return ~got.eqNullSafe(F.lit(want)), F.concat(F.lit(f"unexpected {name}: "), F.coalesce(got.cast("string"), F.lit("")))


def probe_reason(limits: dict, order: tuple[str, ...] = ("sample_rate", "channels", "codec_name", "sample_fmt", "min_duration", "max_duration", "min_size")) -> Column:
    """The first of the named limits that a row breaks. sample_fmt is a prefix; ``order`` is the stage's own."""
    duration, size = F.coalesce(F.col("duration_sec"), F.lit(0.0)), F.coalesce(F.col("size_bytes"), F.lit(0))
    steps = []
    for name in order:
        if name not in limits:
            continue
        want = limits[name]
        if name == "sample_fmt":
            steps.append((~F.coalesce(F.col(name), F.lit("")).startswith(want), F.concat(F.lit("unexpected sample_fmt: "), F.coalesce(F.col(name), F.lit("")))))
        elif name == "min_duration":
            steps.append((duration < want, "too short"))
        elif name == "max_duration":
            steps.append((duration > want, "too long"))
        elif name == "min_size":
            steps.append((size < want, "file too small"))
        else:
            steps.append(_differs(name, want))
    return ladder(*steps)


def spoof_reason(limits: dict) -> Column:
    """Size, duration, and duration over the source's (floored at 1e-6)."""
    ratio = F.col("duration_sec") / F.greatest(F.col("source_duration_sec"), F.lit(1e-6))
    return ladder(
        (F.coalesce(F.col("size_bytes"), F.lit(0)) < limits["min_size"], "file too small"), (F.coalesce(F.col("duration_sec"), F.lit(0.0)) < limits["min_duration"], "too short"),
        (F.col("duration_sec") > limits["max_duration"], "too long"), (ratio < limits["min_ratio"], "ratio too small"), (ratio > limits["max_ratio"], "ratio too large"),
    )


def row_status(limits: dict) -> Column:
    """Status of a delivered row from its probe, sample statistics and its parent's duration; ``ok`` if all is well."""
    ratio = F.col("duration_sec") / F.greatest(F.col("parent_duration_sec"), F.lit(1e-6))
    return F.coalesce(ladder(
        (F.col("duration_sec").isNull(), "probe_failed"), (probe_reason(limits).isNotNull(), "invalid_format"), (F.col("has_nan"), "nan_samples"), (F.col("has_inf"), "inf_samples"),
        (F.col("peak") < limits["min_peak"], "silent"), (F.col("clipped") > limits["max_clipped"], "clipped"), (F.col("parent_duration_sec").isNull(), "missing_parent"),
        (ratio < limits["min_ratio"], "ratio_too_small"), (ratio > limits["max_ratio"], "ratio_too_large"),
    ), F.lit("ok"))


def speech_reason(limits: dict) -> Column:
    """Why a candidate is refused: mean volume, then peak, then share of speech (1 - silence / duration, not below 0)."""
    speech = F.greatest(F.lit(0.0), 1 - F.col("silence_sec") / F.col("duration_sec"))
    return ladder((F.col("mean_db") < limits["min_mean_db"], "mean_volume"), (F.col("max_db") > limits["max_db"], "peak"), (speech < limits["min_speech"], "speech_ratio"))


def output_reason(limits: dict) -> Column:
    """Why an output isn't taken: duration, then rate, channels and codec, then an empty file. Delivered and rendered samples are held to the same."""
    duration = F.coalesce(F.col("duration_sec"), F.lit(0.0))
    seconds = lambda what: F.concat(F.lit(f"duration too {what}: "), fixed(duration, 3), F.lit("s"))
    unexpected = lambda name: (~F.col(name).eqNullSafe(F.lit(limits[name])), F.concat(F.lit(f"unexpected {name.replace('_', ' ')}: "), F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return ladder(
        (duration < limits["min_duration"], seconds("short")), (duration > limits["max_duration"], seconds("long")), unexpected("sample_rate"), unexpected("channels"), unexpected("codec_name"),
        (F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, "empty output file"),
    )


def is_final(final: dict) -> Column:
    """Whether a probed file has the final format already, so that it can be copied."""
    same = [F.col(c).eqNullSafe(F.lit(final[c])) for c in ("sample_rate", "channels", "codec_name")]
    return same[0] & same[1] & same[2] & (F.coalesce(F.col("size_bytes"), F.lit(0)) > 0)


def active(generators: dict[str, dict], only: list[str] | None = None) -> dict[str, dict]:
    """The enabled generators, of ``only`` where that is given; an error if none is left."""
    kept = {k: g for k, g in generators.items() if g.get("enabled", False) and (not only or k in only)}
    if not kept:
        raise ValueError("no generator is active")
    return kept
