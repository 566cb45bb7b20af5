"""Value buckets and numbers as text. Input that isn't a number gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, strip

#: Fixed values: (upper bound, name) in order, the name beyond the last, and whether the bound itself is inside.
BITRATE = ([(16, "very_low"), (24, "low"), (32, "medium")], "high", True)
PACKET_LOSS = ([(2, "light"), (5, "moderate")], "severe", True)
RT60 = ([(0.35, "short"), (0.65, "medium")], "long", False)
DISTANCE = ([(1.0, "near"), (2.5, "mid")], "far", False)
SNR = ([(12, "low"), (24, "medium")], "high", True)
SAMPLE_RATE = ([(8000, "8k"), (16000, "16k"), (24000, "24k")], "32k_plus", True)


def _is_number(value: Column) -> Column:
    """Whether the column is of a number type; known when a query is planned, so that only one branch of a choice stays."""
    return F.typeof(value).rlike("^(tinyint|smallint|int|bigint|float|double|decimal.*)$")


def number(value: Column) -> Column:
    """A number as double; text as double too, null where it isn't a number (trailing d or f, which a cast takes, is none)."""
    parsed = bound(strip(value.cast("string")), lambda text: F.when(text.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"), text.try_cast("double")))
    return F.when(_is_number(value), value.try_cast("double")).otherwise(parsed)


def bucket(value: Column, scale: tuple) -> Column:
    return bound(number(value), lambda x: _named(x, scale))


def _named(x: Column, scale: tuple) -> Column:
    bounds, beyond, inside = scale
    out = None
    for bound, name in bounds:
        test = x <= F.lit(float(bound)) if inside else x < F.lit(float(bound))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(x.isNotNull(), out.otherwise(beyond))


def bitrate_bucket(value: Column) -> Column:
    without_k = number(F.regexp_replace(strip(value.cast("string")), "[kK]$", ""))
    return bound(F.when(_is_number(value), value.try_cast("double")).otherwise(without_k), lambda x: _named(x, BITRATE))


def fixed(value: Column, digits: int) -> Column:
    """A double with ``digits`` decimals, rounded by its exact binary value, ties to even, as C's printf does.

    Java's formats round the shortest decimal that reads back as the value, and halves of that up. The fraction is
    scaled as a sum of two doubles, so nothing is lost; from 2^63 on, where no fraction is left, the format stays Java's.
    """
    scale = 10**digits
    x = value.cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    # Veltkamp's and Dekker's splits: part * scale is scaled + rest exactly
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    scaled = part * F.lit(float(scale))
    head, tail = high(part), part - high(part)
    rest = (head * F.lit(float(scale)) - scaled) + tail * F.lit(float(scale))
    n = F.floor(scaled)
    left = scaled - n
    up = (left > 0.5) | ((left == 0.5) & ((rest > 0) | ((rest == 0) & ((whole if digits == 0 else n) % 2 == 1))))
    m = n + up.cast("long")
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    tail_text = [F.lit("."), F.lpad((m % scale).cast("string"), digits, "0")] if digits else []
    shown = F.concat(sign, (whole + F.floor(m / scale)).cast("string"), *tail_text)
    odd = F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf")))
    return odd.when(size < float(1 << 63), shown).otherwise(F.format_string(f"%.{digits}f", x))


def compact_number(value: Column) -> Column:
    """At most three decimals without trailing zeros; other text as it is, blank null."""
    x = number(value)
    text = strip(value.cast("string"))
    shown = F.regexp_replace(fixed(x, 3), r"\.?0+$", "")
    return F.when(x.isNotNull(), F.when(shown.isin("-0", ""), "0").otherwise(shown)).otherwise(F.when(text != "", text))


def rounded_text(value: Column, digits: int = 6) -> Column:
    """A number rounded, as text; what isn't one is blank."""
    return F.coalesce(F.round(number(value), digits).cast("string"), F.lit(""))


def at_most(available: Column, limit: Column) -> Column:
    """``available``, or ``limit`` where that is less and above 0."""
    return F.when(limit <= 0, available).otherwise(F.least(available, limit))


def share(value: Column) -> Column:
    """A number from 0 to 1; beyond, the nearer end."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def gibibytes(value: Column) -> Column:
    return F.round(value / float(1 << 30), 3)
