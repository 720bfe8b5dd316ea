"""Seeded draws that do not depend on partitioning: a hash of the key as a uniform number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """Uniform in [0, 1) from the first 8 hex digits of ``md5(seed|key|...)``."""
    s = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normal(seed: int, *key: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms of the same key."""
    u1 = F.greatest(uniform(seed, *key, F.lit("a")), F.lit(1e-12))
    u2 = uniform(seed, *key, F.lit("b"))
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)


def uniform_sql(seed: int, *key: str) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {parts})), 1, 8)) AS BIGINT)"
            f" / 4294967296.0)")
