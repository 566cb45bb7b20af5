"""Arithmetic on arrays: vectors and sampled signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for other sizes, empty vectors or a zero norm."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def peak(signal: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(signal, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def peak_normalize(signal: Column, limit: float = 0.98) -> Column:
    """Scaled so that the peak is ``limit``, if it is above."""
    return F.transform(F.array(peak(signal)), lambda p: F.transform(signal, lambda x: F.when(p > limit, x.cast("double") * limit / p).otherwise(x.cast("double"))))[0]


def soft_clip(signal: Column, limit: float = 0.98, drive: float = 2.0) -> Column:
    """tanh limiter, applied if the peak is above ``limit``."""
    soft = lambda x: F.tanh(x.cast("double") * drive) / F.tanh(F.lit(drive)) * limit
    return F.transform(F.array(peak(signal)), lambda p: F.transform(signal, lambda x: F.when(p > limit, soft(x)).otherwise(x.cast("double"))))[0]


def inspect(signal: Column, clip: float) -> Column:
    """frames, peak, clipped share of finite samples, whether NaN or Inf occur; no finite sample: infinity and 1."""
    good = F.filter(signal, finite)
    n = F.size(good)
    clipped = F.size(F.filter(good, lambda x: F.abs(x) >= clip))
    return F.struct(
        F.size(signal).cast("long").alias("frames"), F.when(n > 0, peak(good)).otherwise(float("inf")).alias("peak"), F.when(n > 0, clipped / n).otherwise(1.0).alias("clipped"),
        F.exists(signal, lambda x: F.isnan(x)).alias("has_nan"), F.exists(signal, lambda x: ~F.isnan(x) & ~(F.abs(x) < F.lit(float("inf")))).alias("has_inf"),
    )


def loudness(signal: Column, rate: int) -> Column:
    """duration, RMS in dBFS and peak of the finite samples (mean square floored at 1e-12, so silence has -120); null without one."""
    good = F.filter(signal, finite)
    n = F.size(good)
    power = dot(good, good) / F.greatest(n, F.lit(1))
    made = F.struct((n / float(rate)).alias("duration"), (10 * F.log10(F.greatest(power, F.lit(1e-12)))).alias("rms_dbfs"), peak(good).alias("peak"))
    return F.when(n > 0, made)


def channel_mean(channels: Column) -> Column:
    """One signal from an array of channels of one length; the mean at each sample."""
    n = F.size(channels)
    total = F.aggregate(F.slice(channels, 2, F.greatest(n - 1, F.lit(0))), F.transform(F.get(channels, F.lit(0)), lambda x: x.cast("double")), lambda a, c: F.zip_with(a, c, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


def tile(signal: Column, length: int) -> Column:
    """Cut, or repeated and cut, to ``length`` samples; an empty signal stays empty."""
    times = F.ceil(F.lit(length) / F.greatest(F.size(signal), F.lit(1))).cast("int")
    return F.when(F.size(signal) >= length, F.slice(signal, 1, length)).otherwise(F.slice(F.flatten(F.array_repeat(signal, times)), 1, length))
