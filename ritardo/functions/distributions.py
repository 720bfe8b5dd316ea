"""Quantiles of Student's t and of F, which the JVM side lacks: small numpy helpers for columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by the continued fraction on its fast side."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x)
                     + b * math.log1p(-x)) / a
    # value of the fraction 1 + d1 / (1 + d2 / (1 + ...)), from the far end
    terms = 200
    value = 1.0
    for i in range(terms, 0, -1):
        m = i // 2
        if i % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + d / value
    return front / value


def _bisect(share, p: float) -> float:
    lo, hi = 0.0, 1.0
    while share(hi) < p:
        lo, hi = hi, 2 * hi
        if hi > 1e300:
            return math.inf
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if share(mid) < p else (lo, mid)
    return (lo + hi) / 2


def f_quantile(p: float, d1: float, d2: float) -> float:
    return _bisect(lambda f: beta_share(d1 * f / (d1 * f + d2), d1 / 2, d2 / 2), p)


def t_quantile(p: float, df: float) -> float:
    """For p of one half or more."""
    return _bisect(lambda t: 1 - beta_share(df / (df + t * t), df / 2, 0.5) / 2, p)


def _column(fn, *args: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for key in zip(a, b, c, strict=True):
            if any(v is None or not np.isfinite(v) or v <= 0 for v in key):
                out.append(None)
                continue
            if key not in known:
                known[key] = fn(*key)
            out.append(known[key])
        return pd.Series(out, dtype="float64")

    return run(*[x.cast("double") for x in args])


def f_quantile_col(p: Column, d1: Column, d2: Column) -> Column:
    """Quantile of F; null where a degree of freedom is missing or not positive."""
    return _column(f_quantile, p, d1, d2)


def t_quantile_col(p: Column, df: Column) -> Column:
    return _column(lambda p, df, _: t_quantile(p, df), p, df, F.lit(1.0))
