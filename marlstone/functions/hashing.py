"""Hashes that decide: samples, shards, pair names, seeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = "\0"


def salted(salt: Column | str, token: Column) -> Column:
    """sha1 of salt, a zero byte and the token."""
    return F.sha1(F.concat(F.lit(salt) if isinstance(salt, str) else salt, F.lit(ZERO), token))


def pair_id(prefix: str, left: Column, right: Column) -> Column:
    """sha1 of the prefix and both names, the smaller first, parted by zero bytes."""
    return F.sha1(F.concat_ws(ZERO, F.lit(prefix), F.least(left, right), F.greatest(left, right)))


def md5_shard(token: Column, shards: int) -> Column:
    """The 128-bit md5 number modulo ``shards``, digit by digit, as no integer type holds it."""
    digits = F.split(F.md5(token), "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("long"), F.lit(shards).cast("long")))


def render_seed(seed: int, token: Column) -> Column:
    return F.lit(seed) + F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("long") % 100000
