"""Group folds, splits, bootstraps, links and samples with hash draws.

Rows are first aggregated to one row of sufficient statistics per cluster; replicates then weight
those rows. Facts are never replicated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.functions.distributions import t_quantile_col
from ritardo.functions.draws import uniform
from ritardo.operators.ordered import scan
from ritardo.operators.quantiles import exact_quantiles
from ritardo.session import cut_lineage

HASH_CHUNKS = 1024


def hash_order(df: DataFrame, keys: Sequence[str], seed: int, item: str, name: str = "rank"
               ) -> DataFrame:
    """Rank from 1 of the items of a group in seeded random order (hash, then item).

    Hash values are uniform, so equal slices of [0, 1) are chunks of equal size.
    """
    d = df.withColumns({"__u": uniform(seed, F.col(item)), "__one": F.lit(1).cast("bigint")})
    keep = list(keys) or ["__all"]
    d = d if keys else d.withColumn("__all", F.lit(0))
    chunk = F.floor(F.col("__u") * HASH_CHUNKS).cast("bigint")
    out = scan(d, keep, ["__u", item], chunk, **{name: ("sum", "__one")})
    return out.drop("__u", "__one", "__all")


def group_fold_ids(rows: DataFrame, group: str, n_splits: int, seed: int = 0) -> DataFrame:
    """Fold of each group: largest group first to the lightest fold, equal sizes in hash order.

    Only the histogram (size, number of groups) is walked in order: inside one size the fold
    loads form arithmetic sequences, so the fold of the r-th group follows from the loads at the
    start of that size, for any number of groups.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).toPandas()
    load = np.zeros(n_splits, dtype=np.int64)
    starts = []
    for n, m in hist.itertuples(index=False):
        starts.append((int(n), load.tolist()))
        load = load + int(n) * _picks(load, int(n), int(m))
    spark = rows.sparkSession
    plan = spark.createDataFrame(starts or [(0, load.tolist())], "n bigint, load array<bigint>")
    ranked = hash_order(sizes, ["n"], seed, group, "r")

    @F.pandas_udf("bigint")
    def fold(r: pd.Series, n: pd.Series, load: pd.Series) -> pd.Series:
        out = np.zeros(len(r), dtype=np.int64)
        for size, ix in pd.Series(range(len(r))).groupby(n.to_numpy()):
            out[ix] = _nth_pick(np.asarray(load.iloc[ix.iloc[0]]), int(size),
                                r.to_numpy()[ix] - 1)
        return pd.Series(out)

    return ranked.join(plan, "n").select(group, F.col("n").alias("n_rows"), fold(
        "r", "n", "load").alias("fold"))


def _levels(load: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Folds in pick order within a level, and the first level each takes part in."""
    q, rest = load // size, load % size
    order = np.lexsort((np.arange(len(load)), rest))
    return order, q


def _count_below(q: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Picks made before ``level`` is reached."""
    return np.maximum(level[:, None] - q[None, :], 0).sum(axis=1)


def _nth_pick(load: np.ndarray, size: int, r: np.ndarray) -> np.ndarray:
    order, q = _levels(load, size)
    lo = np.full(len(r), q.min())
    hi = np.full(len(r), q.max() + int(r.max(initial=0)) + 1)
    while (hi - lo > 1).any():  # last level whose earlier picks are at most r
        mid = (lo + hi) // 2
        ok = _count_below(q, mid) <= r
        lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
    left = r - _count_below(q, lo)
    active = q[order][None, :] <= lo[:, None]
    at = (np.cumsum(active, axis=1) <= left[:, None]).sum(axis=1)
    return order[at]


def _picks(load: np.ndarray, size: int, m: int) -> np.ndarray:
    """Groups each fold gets out of ``m`` groups of one size."""
    order, q = _levels(load, size)
    lo, hi = int(q.min()), int(q.max()) + m + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if _count_below(q, np.array([mid]))[0] <= m else (lo, mid)
    got = np.maximum(lo - q, 0)
    rest = m - int(got.sum())
    turn = [f for f in order if q[f] <= lo][:rest]
    got[turn] += 1
    return got


def disjoint(assigned: DataFrame, group: str, fold: str) -> DataFrame:
    """Groups that appear in more than one fold (none when the split is clean)."""
    return assigned.groupBy(group).agg(F.countDistinct(fold).alias("n_folds")).where(
        "n_folds > 1")


def assign_split(
    works: DataFrame, work: str, forced: DataFrame, val_share: float, seed: int,
    pool: DataFrame | None = None,
) -> DataFrame:
    """Train / val / test by work: forced works, a seeded share of the free pool, rest train."""
    w = works.select(work).distinct()
    free = w.join(forced, work, "left_anti")
    if pool is not None:
        free = free.join(pool.select(work), work, "left_semi")
    r = hash_order(free, [], seed, work, "__r")
    n = free.agg(F.count("*").alias("__n"))
    val = r.crossJoin(F.broadcast(n)).where(
        F.col("__r") <= F.round(F.lit(val_share) * F.col("__n"))).select(
        work, F.lit("val").alias("__v"))
    return w.join(forced.select(work, F.col("side").alias("__f")), work, "left").join(
        val, work, "left").select(work, F.coalesce("__f", "__v", F.lit("train")).alias("split"))


DRAWS = 8  # replicates that a row asks draws of


def cluster_index(stats: DataFrame, cluster: str, seed: int = 0) -> DataFrame:
    """Number the clusters 0 .. K-1 (hash order) and attach K."""
    d = hash_order(stats, [], seed, cluster, "__r").withColumn("idx", F.col("__r") - 1)
    k = stats.agg(F.count("*").alias("k"))
    return d.drop("__r").crossJoin(F.broadcast(k))


def bootstrap_weights(indexed: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """How often each replicate draws each cluster: ``b``, ``idx``, ``w``.

    Every cluster contributes one draw to every replicate: draw ``(b, i)`` picks cluster
    ``floor(u * K)``. Clusters are dealt over tasks with a few replicates each before draws are
    made, and draws are counted after their shuffle: hardly two of one task are the same, so a task
    that counted its own would hold them all.
    """
    few = indexed.select("k", "idx", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(
        DRAWS))).alias("__b")).repartition("idx", "__b")
    slots = few.select("k", "idx", F.explode(F.sequence("__b", F.least(
        F.col("__b") + (DRAWS - 1), F.lit(n_boot - 1)))).alias("b"))
    pick = F.floor(uniform(seed, F.col("b"), F.col("idx")) * F.col("k")).cast("bigint")
    return slots.select("b", pick.alias("idx")).repartition("b", "idx").groupBy("b", "idx").agg(
        F.count("*").alias("w"))


def bootstrap_ci(
    stats: DataFrame, cluster: str, sums: Sequence[str], metrics: Mapping[str, Column], *,
    n_boot: int = 2000, seed: int = 0, alpha: float = 0.05,
) -> DataFrame:
    """Estimate and percentile interval of metrics under a cluster bootstrap.

    ``stats``: one row per cluster with the columns ``sums``; each metric is a column expression
    over the totals of those columns. One result row per metric; failed draws are counted.
    """
    ix = cluster_index(stats, cluster)
    w = bootstrap_weights(ix, n_boot, seed)
    reps = w.join(ix.select("idx", *sums), "idx").groupBy("b").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])
    full = stats.agg(*[F.sum(c).alias(c) for c in sums])

    def long(df: DataFrame, *keep: str) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("metric"), m.cast("double").alias("v"))
                 for n, m in metrics.items()]
        return df.select(*keep, F.inline(F.array(*cells)))

    r = long(reps)
    q = exact_quantiles(r, ["metric"], "v", {"low": alpha / 2, "high": 1 - alpha / 2})
    bad = r.groupBy("metric").agg(F.count(F.when(F.col("v").isNull(), 1)).alias("n_failed"))
    est = long(full).withColumnRenamed("v", "estimate")
    return est.join(q, "metric", "left").join(bad, "metric", "left")


def t_interval(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mean of each key's values with Student's interval; null below two values."""
    m = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                              F.stddev_samp(value).alias("__s"))
    half = t_quantile_col(F.lit(1 - alpha / 2), F.col("n") - 1) * F.col("__s") / F.sqrt("n")
    return m.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half}).drop("__s")


def two_way_bootstrap(
    cells: DataFrame, first: str, second: str, num: str, den: str, *, n_boot: int, seed: int,
    alpha: float = 0.05,
) -> DataFrame:
    """Pigeonhole bootstrap of a ratio: a cell weighs the product of its two draw counts."""

    def draws(key: str, s: int, name: str) -> DataFrame:
        ix = cluster_index(cells.select(key).distinct(), key)
        return bootstrap_weights(ix, n_boot, s).join(ix.select("idx", key), "idx").select(
            "b", key, F.col("w").alias(name))

    a, b = draws(first, seed, "__wa"), draws(second, seed + 1, "__wb")
    # pre-aggregate the cells, then one replicate joins both draw tables
    c = cells.groupBy(first, second).agg(F.sum(num).alias("__n"), F.sum(den).alias("__d"))
    j = c.join(a, first).join(b, ["b", second])
    w = F.col("__wa") * F.col("__wb")
    reps = j.groupBy("b").agg((F.sum(w * F.col("__n")) / F.nullif(
        F.sum(w * F.col("__d")), F.lit(0.0))).alias("v"))
    q = exact_quantiles(reps, [], "v", {"low": alpha / 2, "high": 1 - alpha / 2})
    est = c.agg((F.sum("__n") / F.sum("__d")).alias("estimate"))
    return est.crossJoin(q)


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Rows (u, v) with ``m``, the least of u and all its neighbours (minima combine map side)."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node id of each node's component.

    Star contraction: all larger neighbours of a node are linked to its least neighbour, then all
    smaller ones, until every component is one star. Labels are no join keys, so a component of
    most nodes is no hot key; a hub is split by the adaptive join. Each round is checkpointed, so
    the plan stays flat and a lost executor costs one round.
    """
    e = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = e.select(F.col("x").alias("node")).union(e.select("y")).distinct()
    e = cut_lineage(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where(
        "u > v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias(
            "v")).distinct()
        star = _least_neighbour(large)
        small = star.select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u > v").distinct()
        e = cut_lineage(small)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    root = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias(
        "component"))


def split_half(
    ratings: DataFrame, segment: str, rater: str, value: str, n_draws: int, seed: int
) -> DataFrame:
    """Spearman-Brown corrected split-half reliability of segment means over raters.

    Each draw halves the raters of every segment by hash order; the correlation of the two half
    means over segments is averaged over draws.
    """
    per = ratings.groupBy(segment, rater).agg(F.avg(value).alias("v"))
    d = per.select(segment, rater, "v", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias(
        "draw"))
    d = d.withColumns({"__u": uniform(seed, F.col("draw"), F.col(segment), F.col(rater)),
                       "__one": F.lit(1).cast("bigint")})
    r = scan(d, ["draw", segment], ["__u", rater], F.floor(F.col("__u") * 16).cast("bigint"),
             r=("sum", "__one"))
    n = d.groupBy("draw", segment).agg(F.count("*").alias("n"))
    h = r.join(n, ["draw", segment]).groupBy("draw", segment).agg(
        F.avg(F.when(F.col("r") <= F.col("n") / 2, F.col("v"))).alias("a"),
        F.avg(F.when(F.col("r") > F.col("n") / 2, F.col("v"))).alias("b"))
    c = h.where("a is not null and b is not null").groupBy("draw").agg(F.corr("a", "b").alias("r"))
    m = F.avg("r")
    return c.agg(m.alias("mean_r"), (2 * m / (1 + m)).alias("reliability"))


def sample_per_group(df: DataFrame, keys: Sequence[str], item: str, n: int, seed: int) -> DataFrame:
    """Seeded draw of up to ``n`` items per group."""
    return hash_order(df, keys, seed, item, "draw").where(F.col("draw") <= n)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key: the first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return g.select(*keys, "__r.*")




def shared_levels(df: DataFrame, piece: str, level: str, at_least: int) -> DataFrame:
    """Rows of pieces that are played at enough different levels."""
    ok = df.groupBy(piece).agg(F.countDistinct(level).alias("__n")).where(F.col("__n") >= at_least)
    return df.join(ok.select(piece), piece, "left_semi")
