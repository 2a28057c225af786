"""Stable pseudo-random numbers from hashes: the same for a key on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(key: Column) -> Column:
    """Hex digest that stands for a random order of keys."""
    return F.sha1(key)


def byte_fraction(key: Column) -> Column:
    """First digest byte as a fraction of 255, in [0, 1]."""
    return F.conv(F.substring(F.sha1(key), 1, 2), 16, 10).cast("double") / 255.0


def word_fraction(key: Column) -> Column:
    """First 32 digest bits as a fraction of the greatest such number, in [0, 1]."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / 4294967295.0


def bucket_of(key: Column, shares: list[tuple[str, float]], rest: str) -> Column:
    """The bucket in whose cumulative share the key's 32-bit fraction falls."""
    u, upto, out = word_fraction(key), 0.0, None
    for name, share in shares:
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return F.lit(rest) if out is None else out.otherwise(rest)


def digest_mod(key: Column, n: Column) -> Column:
    """The whole 160-bit digest modulo ``n``: digits are folded, as no integer type holds it. ``n`` below 2**58."""
    digits = F.transform(F.split(F.sha1(key), ""), lambda c: F.conv(c, 16, 10).cast("bigint"))
    kept = F.filter(digits, lambda d: d.isNotNull())
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, d: (a * 16 + d) % n)


def job_seed(key: Column) -> Column:
    """32 digest bits modulo 2**31."""
    return F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("bigint") % F.lit(2147483648)


def frame_seed(frames: Column, key: Column, pool: Column) -> Column:
    """``(7 * frames + sum of character codes) mod 10000``, then modulo the size of the pool."""
    codes = F.aggregate(F.transform(F.split(key, ""), F.ascii), F.lit(0), lambda a, c: a + c)
    return ((frames * 7 + codes) % 10000) % pool


def rolling_digest(parts: Column) -> Column:
    """Digest over ordered parts, as if they had been fed one after the other."""
    return F.sha2(F.array_join(parts, ""), 256)
