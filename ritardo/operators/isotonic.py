"""Non-decreasing fits of long runs: pools of adjacent violators, merged in blocks, and time maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.quantiles import exact_quantiles
from ritardo.operators.sequences import running_index
from ritardo.session import cut_lineage

BLOCK = 4096  # pools that a task merges at a time


def pooled(mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, mean, weight) of the pools that adjacent violators fall into."""
    first: list[int] = []
    m: list[float] = []
    w: list[float] = []
    for i, (y, v) in enumerate(zip(mean.tolist(), weight.tolist(), strict=True)):
        at = i
        while m and m[-1] > y:
            y = (m[-1] * w[-1] + y * v) / (w[-1] + v)
            v += w.pop()
            m.pop()
            at = first.pop()
        first.append(at)
        m.append(y)
        w.append(v)
    return np.array(first, dtype=np.int64), np.array(m), np.array(w)


def isotonic(points: DataFrame, keys: Sequence[str], order: str, value: str, weight: str,
             width: int) -> DataFrame:
    """``points`` with ``fit``: the weighted least-squares fit that never falls along ``order``.

    Pools merge in any order to the same fit, so blocks of points are pooled apart, then blocks of
    the pools that are left with their borders moved by half a block, until no two neighbours are
    in the wrong order. Values and weights must not be null, weights above 0, ``order`` distinct.
    """
    keys = list(keys)
    pools = points.select(*keys, F.col(order).alias("lo"), F.col(value).cast("double").alias("m"),
                          F.col(weight).cast("double").alias("w"))
    kinds = dict(pools.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [pooled(np.asarray(m), np.asarray(w)) for m, w in zip(
                pdf["m"], pdf["w"], strict=True)]
            out = pdf[keys].loc[pdf.index.repeat([len(p[0]) for p in parts])]
            yield out.assign(
                lo=np.concatenate([np.asarray(lo)[p[0]] for lo, p in zip(
                    pdf["lo"], parts, strict=True)] or [[]]),
                m=np.concatenate([p[1] for p in parts] or [[]]),
                w=np.concatenate([p[2] for p in parts] or [[]]))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "lo", "m", "w"))
    shift = 0
    while True:
        i = running_index(pools, keys, ["lo"], chunk_of(F.col("lo"), width))
        g = i.groupBy(*keys, F.expr(f"(idx + {shift}) div {BLOCK}").alias("b")).agg(
            F.array_sort(F.collect_list(F.struct("lo", "m", "w"))).alias("a"))
        pools = cut_lineage(g.select(*keys, F.col("a.lo").alias("lo"), F.col("a.m").alias("m"),
                                     F.col("a.w").alias("w")).mapInPandas(run, schema))
        nxt = scan(pools, keys, ["lo"], chunk_of(F.col("lo"), width), __m=("lead", "m"))
        if nxt.where("m > __m").isEmpty():
            break
        shift = BLOCK // 2 - shift
    flat = points.withColumn("__lo", F.col(order))
    box = pools.select(*keys, F.col("lo").alias(order), F.col("m").alias("__m"))
    s = scan(flat.join(box, [*keys, order], "left"), keys, [order], chunk_of(F.col(order), width),
             fit=("last", "__m"))
    return s.drop("__m", "__lo")


def note_time_map(notes: DataFrame, keys: Sequence[str], beat: str, time: str, width: int, *,
                  outlier: float = 0.25, edge: int = 6, max_drop: float = 0.1
                  ) -> tuple[DataFrame, DataFrame]:
    """Monotone map from beats to seconds: (knots, ends).

    Knots are median times of beats, fitted by their number of notes. While the largest residual of
    a performance passes ``outlier`` and four robust deviations, its knot is left out and the rest
    fitted again, for a tenth of the knots at most (one at least). ``knots``: keys, beat, fit;
    ``ends``: keys, dropped, and seconds per beat before the first and after the last knot: the
    median over ``edge`` steps there, a half where there is none above 0.
    """
    keys = list(keys)
    k = [*keys, beat]
    ok = notes.where(F.col(beat).isNotNull() & F.col(time).isNotNull() & ~F.isnan(
        F.col(time).cast("double")))
    knots = ok.groupBy(*k).agg(F.count("*").cast("double").alias("n")).join(
        exact_quantiles(ok, k, time, {"t": 0.5}), k)
    left = cut_lineage(knots)
    most = cut_lineage(left.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(
        max_drop * F.count("*"))).cast("bigint").alias("most")))
    done: DataFrame | None = None
    gone = most.select(*keys, F.lit(0).cast("bigint").alias("dropped"))
    while True:
        fit = cut_lineage(isotonic(left, keys, beat, "t", "n", width).withColumn(
            "__r", F.abs(F.col("t") - F.col("fit"))))
        mad = exact_quantiles(fit, keys, "__r", {"__m": 0.5}, count="__n")
        worst = fit.groupBy(*keys).agg(F.min(F.struct((-F.col("__r")).alias("r"), F.col(beat).alias(
            "b"))).alias("w")).join(mad, keys).join(most, keys).join(gone, keys)
        over = (-F.col("w.r") > F.greatest(F.lit(outlier), 4 * 1.4826 * F.col("__m"))) & (
            F.col("__n") > 2) & (F.col("dropped") < F.col("most"))
        drop = cut_lineage(worst.where(over).select(*keys, F.col("w.b").alias(beat)))
        own = drop.select(*keys)
        still = fit.join(own, keys, "left_anti")
        done = still if done is None else done.unionByName(still)
        if drop.isEmpty():
            break
        gone = cut_lineage(gone.join(own.withColumn("__d", F.lit(1)), keys, "left").select(
            *keys, (F.col("dropped") + F.coalesce("__d", F.lit(0))).alias("dropped")))
        left = cut_lineage(fit.join(own, keys, "left_semi").join(drop, k, "left_anti").select(
            *k, "n", "t"))
    out = cut_lineage(done.select(*k, "fit"))
    step = scan(out, keys, [beat], chunk_of(F.col(beat), width), __b=("lead", beat),
                __t=("lead", "fit")).where(F.col("__b") - F.col(beat) > 1e-9).withColumn(
        "__s", (F.col("__t") - F.col("fit")) / (F.col("__b") - F.col(beat)))
    ends = gone
    for name, order in (("before", F.asc(beat)), ("after", F.desc(beat))):
        w = W.partitionBy(*keys).orderBy(order)  # the limit is applied before the shuffle
        near = step.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= edge)
        s = near.groupBy(*keys).agg(F.median("__s").alias("__s"))
        ends = ends.join(s, keys, "left").withColumn(name, F.when(
            F.col("__s") > 0, F.col("__s")).otherwise(0.5)).drop("__s")
    return out, ends
