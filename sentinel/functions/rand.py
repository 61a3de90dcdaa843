"""Keyed random numbers as column expressions.

Every draw is a function of (seed, salt, key columns), so it does not depend on partitioning and a
recomputed task sees the same numbers. A fixed seed makes results repeatable and is meant for
sampling and tests. For privacy noise pass ``seed=None``: the seed then comes from the operating
system's entropy and stays secret, while lost tasks still recompute to the same noise.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(1 << 52)


def secret_seed(seed: int | str | None) -> str:
    return secrets.token_hex(32) if seed is None else str(seed)


def uniform(seed: int | str, salt: str, *keys: Column | str) -> Column:
    """Uniform on [0, 1) with 52 bits, from md5 of ``seed:salt:key1:key2...``."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits.cast("double") / F.lit(_TWO_52)


def exponential(seed: int | str, salt: str, *keys: Column | str) -> Column:
    """Standard exponential, -ln(1-u)."""
    return -F.ln(F.lit(1.0) - uniform(seed, salt, *keys))


def fast_uniform(seed: int | str, *keys: Column) -> Column:
    """Uniform on [0, 1) from xxhash64; cheaper than md5 where no other engine must agree."""
    h = F.xxhash64(F.lit(str(seed)), *keys)
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(_TWO_52)
