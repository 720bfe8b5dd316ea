"""How far a performer's deviation from the consensus follows from the others' main components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.operators.curves import gram_matrices
from ritardo.session import cut_lineage

TOGETHER = 4096  # curves of a group that one task scores


def held_out_moments(m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred cross products of a group without the curve ``x``, from the group's own
    count, sums and cross products: one performer is taken away, nothing is summed again."""
    d = len(x)
    n = m[0] - 1
    mean = (m[1:d + 1] - x) / n
    return mean, m[d + 1:].reshape(d, d) - np.outer(x, x) - n * np.outer(mean, mean)


def predicted(m: np.ndarray, x: np.ndarray, k: int) -> tuple[float, float]:
    """Squared error of the second halves of both channels, over their own size: from the mean
    deviation of the first halves, and from ``k`` components of the others (all, where they span
    fewer) fitted to these."""
    d = len(x)
    p = d // 2
    mean, cross = held_out_moments(m, x)
    size = np.diag(cross)
    scale = np.repeat([np.sqrt(size[:p].mean() / (m[0] - 1)), np.sqrt(size[p:].mean() / (m[0] - 1))], p)
    if not (scale > 0).all():
        return np.nan, np.nan
    y = (x - mean) / scale
    known = np.tile(np.arange(p) < p // 2, 2)
    total = float((y[~known] ** 2).sum())
    if total == 0:
        return np.nan, np.nan
    level = np.concatenate([np.full(p, y[:p][known[:p]].mean()), np.full(p, y[p:][known[p:]].mean())])
    e, w = np.linalg.eigh(cross / np.outer(scale, scale))
    w = w[:, ::-1][:, :min(k, int((e > 1e-10 * e[-1]).sum()))]  # no more than the others span
    z = np.linalg.lstsq(w[known], y[known], rcond=None)[0]
    return (float(((y - level)[~known] ** 2).sum()) / total,
            float(((y - w @ z)[~known] ** 2).sum()) / total)


def conditional_prediction(df: DataFrame, group: str, item: str, curve: str, dim: int, k: int
                           ) -> DataFrame:
    """group, item, ``err_mean``, ``err_basis``: each performer predicted from all others of the group.

    ``curve``: two channels of ``dim / 2`` values one after the other; the first channel is taken less
    its own mean. The moments of a group are summed once and one curve is taken out of them for each
    prediction. A group of any size is scored in parts. Groups of fewer than three give null, as do
    channels in which the others do not differ.
    """
    half = dim // 2
    c = F.col(curve)
    mean = F.aggregate(F.slice(c, 1, half), F.lit(0.0), lambda a, v: a + v) / half
    x = df.select(group, item, F.transform(c.cast("array<double>"), lambda v, i: F.when(
        i < half, v - mean).otherwise(v)).alias("x"))
    x = cut_lineage(x)
    g = cut_lineage(gram_matrices(x, group, "x", dim).select(group, "m"))
    parts = g.select(group, "m", F.greatest(F.lit(1), F.ceil(F.get("m", F.lit(0)) / TOGETHER)).cast(
        "int").alias("parts"))
    here = x.join(parts.select(group, F.col("parts").alias("__n")), group).withColumn(
        "part", F.pmod(F.xxhash64(item), F.col("__n")).cast("int"))
    there = parts.select(F.col(group).alias("__g"), "m", F.explode(F.sequence(
        F.lit(0), F.col("parts") - 1)).alias("__part"))
    kinds = dict(x.dtypes)

    def score(curves: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        out = curves[[group, item]].copy()
        if not len(curves):
            return out.assign(err_mean=[], err_basis=[])
        m = np.asarray(grams["m"].iloc[0])
        both = [predicted(m, np.asarray(v), k) if m[0] >= 3 else (np.nan, np.nan)
                for v in curves["x"]]
        return out.assign(err_mean=[b[0] for b in both], err_basis=[b[1] for b in both])

    e = here.groupBy(group, "part").cogroup(there.groupBy("__g", "__part")).applyInPandas(
        score, f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, err_mean double, err_basis double")
    return e.select(group, item, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in (
        "err_mean", "err_basis")])


def expected_r2(points: DataFrame, group: str, at: str, value: str, experts: Sequence[int]
                ) -> DataFrame:
    """group, experts, ``r2``: expected share of a mean curve that the mean of some new experts has.

    From the spread between performers at each point: expected squared difference of two means
    over the squared size of the centred mean curve. Points of one performer take no part.
    """
    p = points.where(F.col(value).isNotNull()).groupBy(group, at).agg(
        F.avg(value).alias("m"), F.var_samp(value).alias("s2"), F.count(value).alias("n")).where("n >= 2")
    k = F.explode(F.array(*[F.lit(x) for x in experts])).alias("experts")
    a = p.groupBy(group).agg(
        F.count("*").alias("c"), F.var_pop("m").alias("v"), F.sum("s2").alias("s"),
        F.sum(F.col("s2") / F.col("n")).alias("noise"))
    a = a.select("*", k).withColumn("ss", F.col("v") * F.col("c"))
    return a.select(group, "experts", F.when(F.col("ss") > 0, 1 - (F.col("s") / F.col(
        "experts") + F.col("noise")) / F.col("ss")).alias("r2"))
