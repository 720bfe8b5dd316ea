"""Issue spans, ranking and practice windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.functions.stats import tier_name, tier_rank
from ritardo.operators.ordered import chunk_of, islands


def issue_spans(
    bars: DataFrame, keys: Sequence[str], bar: str, tier: str, magnitude: str, width: int = 4096
) -> DataFrame:
    """Consecutive tiered bars as spans with the highest tier and magnitude."""
    t = bars.where(F.col(tier) != "none").select(
        *keys, F.col(bar).alias("__bar"), tier_rank(F.col(tier)).alias("tier_rank"),
        F.col(magnitude).alias("__mag"))
    t = islands(t, keys, ["__bar"], chunk_of("__bar", width),
                lambda p, c: c("__bar") != p("__bar") + 1, ["__bar"], "__span")
    return t.groupBy(*keys, "__span").agg(
        F.min("__bar").alias("first_bar"), F.max("__bar").alias("last_bar"),
        F.max("tier_rank").alias("tier_rank"), F.max("__mag").alias("magnitude"),
    ).withColumn("tier", tier_name(F.col("tier_rank"))).drop("__span")


def rank_issues(spans: DataFrame, keys: Sequence[str], *before: Column) -> DataFrame:
    """Rank spans of one performance: tier, any given terms, magnitude, first bar.

    One performance has at most one span per bar and channel, so the rank window is per report.
    """
    w = W.partitionBy(*keys).orderBy(
        F.desc("tier_rank"), *before, F.desc(F.coalesce("magnitude", F.lit(0.0))), "first_bar")
    return spans.withColumn("rank", F.row_number().over(w).cast("bigint"))


def rank_in_group(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Rank by (value, tie) from 1; values are cut into buckets so no group sits in one task."""
    from ritardo.operators.ordered import scan
    from ritardo.operators.quantiles import value_bucket

    d = df.withColumn("__one", F.lit(1).cast("bigint"))
    return scan(d, keys, [value, tie], value_bucket(value), rank=("sum", "__one")).drop(
        "__one")


def recurring_errors(
    errors: DataFrame, place: Sequence[str], key: str, take: str, *, min_takes: int = 2,
    experts: DataFrame | None = None, min_experts: int = 2,
) -> DataFrame:
    """Error keys seen in at least ``min_takes`` takes, minus keys that experts show as well."""
    k = [*place, key]
    n = errors.groupBy(*k).agg(F.countDistinct(take).alias("n_takes")).where(
        F.col("n_takes") >= min_takes)
    if experts is None:
        return n
    e = experts.groupBy(*k).agg(F.countDistinct(take).alias("__n")).where(
        F.col("__n") >= min_experts)
    return n.join(e.select(*k), k, "left_anti")


def check_status(
    before: Column, after: Column, n_experts: Column, not_heard: Column, min_refs: int = 5
) -> Column:
    """Outcome of the expert check of a bar."""
    b, a = tier_rank(before), tier_rank(after)
    return (
        F.when(not_heard, "not_heard").when(b == 0, "none")
        .when(n_experts < min_refs, "unchecked").when(a == b, "confirmed")
        .when(a == 0, "suppressed").otherwise("down_tiered"))


def recall_by_bin(
    df: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float], hit: str
) -> DataFrame:
    """Recall per bin of a gap, with the drop to the reference bin (null gap or past the last
    edge)."""
    keys = list(keys)
    b = F.when(F.col(value).isNull() | (F.col(value) >= edges[-1]), len(edges))
    for i, e in enumerate(edges):
        b = b.when(F.col(value) < e, i)
    g = df.groupBy(*keys, b.cast("bigint").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(hit).cast("int")).alias("recall"))
    ref = g.where(F.col("bin") == len(edges)).select(*keys, F.col("recall").alias("__ref"))
    return g.join(ref, keys, "left").withColumn(
        "drop", F.col("__ref") - F.col("recall")).drop("__ref")


def take_rows(bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Graded notes, accuracy and bars with errors of each take, from its bar counts."""
    n, w, m = (F.sum(c) for c in ("n_score_notes", "n_wrong_pitch", "n_missed"))
    err = F.col("n_wrong_pitch") + F.col("n_missed") + F.col("n_extra") > 0
    return bars.groupBy(*keys).agg(
        n.alias("n_score_notes"), F.when(n > 0, (n - w - m) / n).alias("accuracy"),
        F.count(F.when(err, 1)).alias("n_bars_with_errors"))
