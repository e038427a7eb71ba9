"""Reproducible draws: MD5 of stable keys, so row order and partitioning never matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(*parts: Column | str | int) -> Column:
    """First 32 bits of MD5 over the parts joined by ':'; strings are literals, columns are columns."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def hash60(*parts: Column | str | int) -> Column:
    """First 60 bits of the same digest, for positions in groups of any size."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Draw in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def uniform_open(*parts: Column | str | int) -> Column:
    """Draw in (0, 1), safe for logarithms and normal quantiles."""
    return (hash32(*parts) + F.lit(0.5)) / F.lit(4294967296.0)


def index_below(n: Column, *parts: Column | str | int) -> Column:
    """Draw an integer in [0, n); every position of a group below 2^40 is within 1e-6 of equally likely."""
    return F.pmod(hash60(*parts), n)


def replicate_index(n: Column, seed: int, rep: Column, *parts: Column) -> Column:
    """Draw in [0, n) of a replicate: a digest serves two replicates, its first and its second half."""
    cols = [c.cast("string") for c in (F.lit(seed), F.floor(rep / 2), *parts)]
    digest = F.md5(F.concat_ws(":", *cols))
    half = F.substring(digest, F.when(rep % 2 == 0, 1).otherwise(17), F.lit(15))
    return F.pmod(F.conv(half, 16, 10).cast("long"), n)


def md5_is_even(*parts: Column | str | int) -> Column:
    """Parity of the whole 128-bit digest: the last hex digit decides."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.substring(digest, 32, 1).isin(*"02468ace")


def standard_normal(*parts: Column | str | int) -> Column:
    """Box-Muller draw from two independent hashes."""
    u1, u2 = uniform_open("r", *parts), uniform("t", *parts)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)
