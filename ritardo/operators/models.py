"""Small estimators whose data passes are Spark aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.session import cut_lineage


def fixed_effects(df: DataFrame, group: str, y: str, x1: str, x2: str) -> DataFrame:
    """Least squares with group fixed effects: demean within groups, then normal equations."""
    m = df.groupBy(group).agg(*[F.avg(c).alias(f"__m_{c}") for c in (y, x1, x2)])
    d = df.join(m, group).select(*[(F.col(c) - F.col(f"__m_{c}")).alias(n)
                                   for c, n in ((y, "y"), (x1, "a"), (x2, "b"))])
    s = d.agg(*[F.sum(F.col(p) * F.col(q)).alias(p + q)
                for p, q in (("a", "a"), ("a", "b"), ("b", "b"), ("a", "y"), ("b", "y"))],
              F.count("*").alias("n"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return s.select(
        "n", ((F.col("bb") * F.col("ay") - F.col("ab") * F.col("by")) / det).alias("beta_1"),
        ((F.col("aa") * F.col("by") - F.col("ab") * F.col("ay")) / det).alias("beta_2"))


def bradley_terry(
    comparisons: DataFrame, winner: str, loser: str, *, l2: float = 1e-4, tol: float = 1e-8,
    check_every: int = 5,
) -> DataFrame:
    """Penalised pairwise strengths, centred to mean zero.

    Comparisons are counted per ordered pair once; every step then joins strengths to the pair
    counts and moves each item by its gradient over a bound of its curvature, which cannot
    overshoot. Steps go on until no strength moves by more than ``tol``.
    """
    pairs = comparisons.where(F.col(winner) != F.col(loser)).groupBy(
        F.col(winner).alias("i"), F.col(loser).alias("j")).agg(F.count("*").alias("w"))
    wins = pairs.select("i", "j", "w", F.lit(0).cast("bigint").alias("l"))
    losses = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"),
                          F.lit(0).cast("bigint").alias("w"), F.col("w").alias("l"))
    n = cut_lineage(wins.unionByName(losses).groupBy("i", "j").agg(
        F.sum("w").alias("w"), F.sum("l").alias("l")))
    s = n.select("i").distinct().withColumn("s", F.lit(0.0))
    step = 0
    while True:
        sj = s.select(F.col("i").alias("j"), F.col("s").alias("sj"))
        p = 1.0 / (1.0 + F.exp(F.col("sj") - F.col("s")))
        t = F.col("w") + F.col("l")
        g = n.join(s, "i").join(sj, "j").groupBy("i").agg(
            F.first("s").alias("s"), F.sum(F.col("w") - t * p).alias("g"), F.sum(t).alias("t"))
        move = (F.col("g") - l2 * F.col("s")) / (F.col("t") / 2.0 + l2)
        s = g.select("i", (F.col("s") + move).alias("s"), F.abs(move).alias("d"))
        step += 1
        if step % check_every == 0:
            s = cut_lineage(s)
            if s.where(F.col("d") > tol).isEmpty():
                break
        s = s.select("i", "s", "d")
    mean = s.agg(F.avg("s").alias("m"))
    return s.crossJoin(F.broadcast(mean)).select(
        F.col("i").alias("item"), (F.col("s") - F.col("m")).alias("strength"))


def logistic_fit(
    df: DataFrame, xs: list[str], y: str, cluster: str, *, ridge: float = 1e-6, tol: float = 1e-9,
    max_iter: int = 50,
) -> DataFrame:
    """Binomial logit by iteratively reweighted least squares with cluster-robust errors (CR1).

    Every iteration is one aggregation of the score and information sums (a p x p matrix);
    only those sums reach the driver. The meat of the covariance sums scores per cluster first.
    A fit that has not converged raises.
    """
    cols = ["1D", *[f"`{x}`" for x in xs]]
    p = len(cols)
    beta = np.zeros(p)

    def eta() -> str:
        return " + ".join(f"({float(b)!r}D) * {c}" for b, c in zip(beta, cols, strict=True))

    for _ in range(max_iter):
        mu = f"(1D / (1D + exp(-({eta()}))))"
        d = df.selectExpr(*[f"{c} as x{i}" for i, c in enumerate(cols)], f"`{y}` - {mu} as r",
                          f"{mu} * (1D - {mu}) as w")
        row = d.agg(
            *[F.expr(f"sum(r * x{i}) as g{i}") for i in range(p)],
            *[F.expr(f"sum(w * x{i} * x{j}) as h{i}_{j}") for i in range(p) for j in range(i, p)],
        ).first()
        g = np.array([row[f"g{i}"] for i in range(p)]) - ridge * beta
        h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step = np.linalg.solve(h + ridge * np.eye(p), g)
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    else:
        raise RuntimeError(f"no convergence in {max_iter} steps; last step {np.abs(step).max():g}")
    mu = f"(1D / (1D + exp(-({eta()}))))"
    sc = df.groupBy(cluster).agg(*[F.expr(f"sum((`{y}` - {mu}) * {c}) as s{i}")
                                   for i, c in enumerate(cols)])
    m = sc.agg(F.count("*").alias("k"), *[
        F.expr(f"sum(s{i} * s{j}) as m{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    inv = np.linalg.inv(h + ridge * np.eye(p))
    cov = inv @ meat @ inv * m["k"] / max(m["k"] - 1, 1)
    rows = [(n, float(b), float(s)) for n, b, s in zip(
        ["intercept", *xs], beta, np.sqrt(np.diag(cov)), strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double")


def coherence(
    df: DataFrame, keys: list[str], block: str, xs: list[str], y: str, *, n_folds: int = 5,
    alphas: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0), min_blocks: int = 3, min_rows: int = 12,
) -> DataFrame:
    """Out-of-fold R2 of a ridge of ``y`` on ``xs`` per key, blocks dealt to folds in turn.

    Cross products are summed per (key, fold) by Spark; every fit, the inner choice of the penalty
    and the held-out error then follow from a few small matrices per key. Undefined (with a
    reason) below ``min_blocks`` blocks or ``min_rows`` rows.
    """
    from ritardo.operators.ordered import chunk_of
    from ritardo.operators.sequences import running_index

    p = len(xs) + 1
    blocks = running_index(df.select(*keys, block).distinct(), keys, [block], chunk_of(block, 4096),
                           "__b")
    d = df.join(blocks, [*keys, block]).selectExpr(
        *[f"`{k}`" for k in keys], f"__b % {n_folds} as __f", f"`{block}` as __blk", "1D as v0",
        *[f"cast(`{x}` as double) as v{i + 1}" for i, x in enumerate(xs)],
        f"cast(`{y}` as double) as v{p}")
    cells = ", ".join(f"sum(v{i} * v{j})" for i in range(p + 1) for j in range(p + 1))
    g = d.groupBy(*keys, "__f").agg(F.expr(f"array({cells}) as m"),
                                    F.countDistinct("__blk").alias("nb"))
    per = g.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__f", "m"))).alias("folds"),
                               F.sum("nb").alias("n_blocks"))

    def fit(m: np.ndarray, alpha: float) -> np.ndarray | None:
        """Ridge on standardised columns with a free intercept, in original units."""
        n = m[0, 0]
        if n < p + 1:
            return None
        mu = m[0, 1:p] / n
        cov = m[1:p, 1:p] / n - np.outer(mu, mu)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        cy = (m[1:p, p] / n - mu * m[0, p] / n) / sd
        b = np.linalg.solve(cov / np.outer(sd, sd) + alpha / n * np.eye(p - 1), cy) / sd
        return np.concatenate([[m[0, p] / n - mu @ b], b])

    def sse(m: np.ndarray, b: np.ndarray) -> float:
        return float(m[p, p] - 2 * b @ m[:p, p] + b @ m[:p, :p] @ b)

    @F.pandas_udf("r2 double, n bigint")
    def solve(folds: pd.Series) -> pd.DataFrame:
        rows = []
        for fs in folds:
            ms = [np.asarray(f["m"], float).reshape(p + 1, p + 1) for f in fs]
            tot = sum(ms)
            n, err, ok = tot[0, 0], 0.0, len(ms) >= 2
            for i in range(len(ms)):
                rest = [m for j, m in enumerate(ms) if j != i]
                train, best = sum(rest), None
                for a in alphas:
                    inner = 0.0
                    for h in rest:
                        b = fit(train - h, a)
                        inner += sse(h, b) if b is not None else np.inf
                    if best is None or inner < best[0]:
                        best = (inner, a)
                b = fit(train, best[1]) if ok else None
                ok = b is not None
                if not ok:
                    break
                err += sse(ms[i], b)
            sst = tot[p, p] - tot[0, p] ** 2 / n
            rows.append((1 - err / sst if ok and sst > 0 else None, int(n)))
        return pd.DataFrame(rows, columns=["r2", "n"])

    out = per.select(*keys, "n_blocks", solve("folds").alias("s")).select(
        *keys, "n_blocks", "s.n", "s.r2")
    few_b, few_n = F.col("n_blocks") < min_blocks, F.col("n") < min_rows
    reason = F.when(few_b, "too_few_blocks").when(few_n, "too_few_rows").when(
        F.col("r2").isNull(), "no_fit")
    return out.select(*keys, "n_blocks", "n", F.when(~few_b & ~few_n, F.col("r2")).alias("r2"),
                      reason.alias("reason"))
