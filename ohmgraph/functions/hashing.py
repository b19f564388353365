"""Random numbers as column expressions: pure functions of keys and seed, so reruns and retries agree.

Flavour xx hashes with xxhash64 inside generated code; md5 takes the first 32 bits of an MD5, which other SQL engines
can compute too. A role in the hashed tuple keeps the streams of sketch, coins and probes independent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = float(1 << 32)


def bits32(role: str, *keys: Column, seed: int = 0, flavour: str = "xx") -> Column:
    """32 random bits as a long."""
    if flavour == "md5":
        text = F.concat_ws(",", F.lit(role), *[k.cast("string") for k in keys], F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.xxhash64(F.lit(role), *keys, F.lit(seed)).bitwiseAND(F.lit(0xFFFFFFFF))


def sign(role: str, *keys: Column, **kw) -> Column:
    """-1.0 or 1.0, by the highest of the bits."""
    return F.when(bits32(role, *keys, **kw) >= 1 << 31, F.lit(1.0)).otherwise(F.lit(-1.0))


def uniform(role: str, *keys: Column, **kw) -> Column:
    """In (-1, 1), symmetric around 0."""
    return (bits32(role, *keys, **kw) + 0.5) * F.lit(2 / _TWO32) - 1.0


def coin(role: str, *keys: Column, **kw) -> Column:
    """In (0, 1)."""
    return (bits32(role, *keys, **kw) + 0.5) / F.lit(_TWO32)


def gaussian(role: str, *keys: Column, **kw) -> Column:
    """Standard normal, by Box and Muller."""
    r = F.sqrt(F.lit(-2.0) * F.log(coin(role + "r", *keys, **kw)))
    return r * F.cos(F.lit(2 * math.pi) * coin(role + "a", *keys, **kw))
