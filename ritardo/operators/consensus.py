"""Consensus and leave-one-out comparison of performances of one piece.

Group sums are aggregated with map-side combine and joined back; nothing is paired inside a piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.functions.distributions import f_quantile_col
from ritardo.functions.stats import pearson, tier, tier_rank, tier_name
from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.quantiles import exact_quantiles, join_on, loo_quantiles, robust_sd
from ritardo.operators.sequences import running_index
from ritardo.session import cut_lineage

# fixed values: limits of a bar's errors on clean expert playing
WRONG_Q95, WRONG_Q99 = 1.0, 2.0
MISSED_EXTRA_Q95, MISSED_EXTRA_Q99 = 0.25, 0.50
MISSED_ONLY_Q95, MISSED_ONLY_Q99 = 0.161, 0.286


def center(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value minus its mean over ``keys`` (nulls stay null)."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    return df.join(m, list(keys), "left").withColumn(name, F.col(value) - F.col("__mean")).drop(
        "__mean")


def loo_mean(
    df: DataFrame, keys: Sequence[str], value: str, min_others: int = 1, name: str = "loo_mean"
) -> DataFrame:
    """Mean of the other rows of the group (sum - own) / (count - 1); null with too few others."""
    g = df.groupBy(*keys).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    own = F.col(value).isNotNull()
    n = F.col("__n") - own.cast("int")
    s = F.col("__s") - F.coalesce(F.col(value), F.lit(0.0))
    return (
        df.join(g, list(keys), "left")
        .withColumn(name, F.when(n >= min_others, s / n))
        .withColumn("n_others", n.cast("bigint"))
        .drop("__s", "__n")
    )


def per_bar(df: DataFrame, bars: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """rms / mean / sum / count / robust SD per bar over all bars; sum and count default to 0."""
    keys = list(keys)
    v = F.col(value)
    a = df.groupBy(*keys).agg(
        F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean"), F.sum(v).alias("sum"),
        F.count(v).alias("n"),
    )
    rsd = robust_sd(df, keys, value).select(*keys, "robust_sd")
    return (
        bars.select(*keys).join(a, keys, "left").join(rsd, keys, "left")
        .withColumn("sum", F.coalesce("sum", F.lit(0.0)))
        .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    )


def bar_quantiles(
    refs: DataFrame, keys: Sequence[str], performance: str, value: str, *, min_n: int = 10,
    how: str = "mean",
) -> DataFrame:
    """Per reference and bar the mean (or rms), then quantiles .1 / .5 / .9 per bar."""
    v = F.col(value)
    inner = F.avg(v) if how == "mean" else F.sqrt(F.avg(v * v))
    per = refs.groupBy(*keys, performance).agg(inner.alias("v"))
    q = exact_quantiles(per, keys, "v", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, count="n_refs")
    ok = F.col("n_refs") >= min_n
    return q.select(*keys, *[F.when(ok, F.col(c)).alias(c) for c in ("lo", "mid", "hi")], "n_refs")


def reference_limits(
    refs: DataFrame, keys: Sequence[str], value: str, min_n: int = 10
) -> DataFrame:
    """Expert limits q95 / q99 of a quantity; null below ``min_n`` references."""
    q = exact_quantiles(refs, keys, value, {"q95": 0.95, "q99": 0.99}, count="n_refs")
    ok = F.col("n_refs") >= min_n
    return q.select(*keys, F.when(ok, F.col("q95")).alias("q95"),
                    F.when(ok, F.col("q99")).alias("q99"), "n_refs")


def expert_bar_limits(
    bars: DataFrame, keys: Sequence[str], *, min_refs: int = 5, extras: bool = True,
    q: tuple[float, float] = (0.80, 0.99),
) -> DataFrame:
    """Leave-one-out expert limits of every bar row: the same bar in the other performances.

    ``bars``: ``keys`` (piece and bar label), ``n_score_notes``, ``n_wrong_pitch``, ``n_missed``,
    ``n_extra``. Rows without graded notes count for nobody.
    """
    me = F.col("n_missed") + (F.col("n_extra") if extras else F.lit(0))
    graded = F.col("n_score_notes") > 0
    b = bars.withColumns({
        "__w": F.when(graded, F.col("n_wrong_pitch").cast("double")),
        "me_rate": F.when(graded, me / F.col("n_score_notes")),
    })
    b = loo_quantiles(b, keys, "__w", {"wrong_notable": q[0], "wrong_strong": q[1]}, count="n_experts")
    b = loo_quantiles(b, keys, "me_rate", {"me_notable": q[0], "me_strong": q[1]}, count="__n2")
    ok = F.col("n_experts") >= min_refs
    lim = ("wrong_notable", "wrong_strong", "me_notable", "me_strong")
    return b.withColumns({c: F.when(ok, F.col(c)) for c in lim}).drop("__w", "__n2")


def expert_limits_order_statistic(
    bars: DataFrame, keys: Sequence[str], *, min_refs: int = 5, q95: float = 0.80,
    q99: float = 0.99, strong_margin: int = 0,
) -> DataFrame:
    """Per bar over all experts: notable limit by quantile, strong limit by finite-sample rank.

    The strong limit is the value of rank ``ceil(q99 (n + 1))``; when no rank qualifies it is the
    maximum, plus ``strong_margin`` notes for the wrong-pitch count.
    """
    b = bars.where("n_score_notes > 0").withColumn(
        "__me", (F.col("n_missed") + F.col("n_extra")) / F.col("n_score_notes"))

    def need(n: Column) -> Column:
        return F.ceil(F.lit(q99) * (n + 1) - 1e-9)

    rank = f"least(ceil({q99!r}D * (__n + 1) - 1e-9D), __n) - 1"
    w = exact_quantiles(b, keys, "n_wrong_pitch", {"wrong_notable": q95, "wrong_strong": rank},
                        count="n_experts")
    m = exact_quantiles(b, keys, "__me", {"me_notable": q95, "me_strong": rank})
    out = w.join(m, list(keys))
    ok = F.col("n_experts") >= min_refs
    over = need(F.col("n_experts")) > F.col("n_experts")
    margin = F.when(ok & over, float(strong_margin)).otherwise(0.0)
    return out.select(
        *keys, "n_experts",
        F.when(ok, F.col("wrong_notable")).alias("wrong_notable"),
        F.when(ok, F.col("wrong_strong") + margin).alias("wrong_strong"),
        F.when(ok, F.col("me_notable")).alias("me_notable"),
        F.when(ok, F.col("me_strong")).alias("me_strong"),
        margin.alias("me_strong_margin_notes"),
    )


def correctness_tier(
    wrong: Column, missed_extra: Column, n_notes: Column, limits: dict[str, Column] | None = None
) -> tuple[Column, Column]:
    """Tier of a bar's errors and its magnitude as a multiple of the notable limit."""
    lim = limits or {
        "wrong_notable": F.lit(WRONG_Q95), "wrong_strong": F.lit(WRONG_Q99),
        "me_notable": F.lit(MISSED_EXTRA_Q95), "me_strong": F.lit(MISSED_EXTRA_Q99),
    }
    rate = F.when(n_notes > 0, missed_extra / n_notes)
    t = F.greatest(
        tier_rank(tier(wrong.cast("double"), lim["wrong_notable"], lim["wrong_strong"])),
        tier_rank(tier(rate, lim["me_notable"], lim["me_strong"])),
    )
    mag = F.greatest(
        wrong / lim["wrong_notable"],
        F.when(rate.isNotNull() & (lim["me_notable"] > 0), rate / lim["me_notable"]).otherwise(0.0),
    )
    return tier_name(t), mag


def checked_limits(extras: bool = True) -> dict[str, Column]:
    """Per-bar limits: the larger of the global limit and the bar's expert limit."""
    me95, me99 = (
        (MISSED_EXTRA_Q95, MISSED_EXTRA_Q99) if extras else (MISSED_ONLY_Q95, MISSED_ONLY_Q99)
    )
    glob = {"wrong_notable": WRONG_Q95, "wrong_strong": WRONG_Q99, "me_notable": me95, "me_strong": me99}
    return {k: F.greatest(F.lit(v), F.col(k)) for k, v in glob.items()}


def timing_consensus(
    refs: DataFrame, keys: Sequence[str], value: str, min_references: int = 3
) -> DataFrame:
    """Mean reference residual per position with count and sample SD; null below the minimum."""
    c = refs.groupBy(*keys).agg(
        F.avg(value).alias("__m"), F.count(value).alias("n_refs"),
        F.stddev_samp(value).alias("sd_refs"),
    )
    return c.select(*keys, F.when(F.col("n_refs") >= min_references, F.col("__m")).alias(
        "consensus"), "n_refs", "sd_refs")


def timing_noise_summary(
    noise: DataFrame, keys: Sequence[str], value: str, dof_factor: float = 1.0
) -> DataFrame:
    """Noise rms, coverage, consensus R2 and the fallback rule (coverage < .5)."""
    has = F.col("noise").isNotNull() & F.col(value).isNotNull()
    nz = F.avg(F.when(has, F.col("noise") * F.col("noise")))
    dv = F.avg(F.when(has, F.col(value) * F.col(value)))
    cov = F.count(F.when(has, 1)) / F.greatest(F.count(value), F.lit(1))
    med = exact_quantiles(noise.where(has), keys, "n_others", {"n_refs_median": 0.5})
    s = noise.groupBy(*keys).agg(
        (F.sqrt(nz) * dof_factor).alias("noise_rms"), cov.alias("coverage"),
        F.when(dv > 0, 1 - nz / dv).alias("consensus_r2"),
    )
    return s.join(med, list(keys), "left").withColumn(
        "source", F.when(F.col("coverage") >= 0.5, "consensus").otherwise("nometric"))


def timing_noise_bars(
    targets: DataFrame, refs: DataFrame, piece: str, performance: str, pos: str, bar: str,
    value: str, *, min_refs: int = 3, min_tier: int = 10,
) -> DataFrame:
    """Per-bar noise of targets against the reference mean, with the references' own q95 / q99."""
    cons = timing_consensus(refs, [piece, pos], value, min_refs)
    t = targets.join(cons, [piece, pos], "left").withColumn(
        "__e", F.col(value) - F.col("consensus"))
    tb = t.groupBy(piece, performance, bar).agg(
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("noise_rms"),
        F.count("__e").alias("n_positions"))
    r = loo_mean(refs, [piece, pos], value, min_refs).withColumn(
        "__e", F.col(value) - F.col("loo_mean"))
    rb = r.groupBy(piece, performance, bar).agg(
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("ref_rms"))
    lim = reference_limits(rb, [piece, bar], "ref_rms", min_tier)
    return tb.join(lim, [piece, bar], "left").withColumn(
        "tier", tier(F.col("noise_rms"), F.col("q95"), F.col("q99")))


def curve_agreement(
    df: DataFrame, piece: str, performance: str, pos: str, value: str, *, min_refs: int = 2,
    min_points: int = 8,
) -> DataFrame:
    """r and centred rms of each curve against the mean of the others of its piece.

    Also the percentile of that rms among the performances of the piece.
    """
    d = loo_mean(df, [piece, pos], value, min_refs).where(
        F.col(value).isNotNull() & F.col("loo_mean").isNotNull())
    diff = F.col(value) - F.col("loo_mean")
    s = d.groupBy(piece, performance).agg(
        F.count("*").alias("n_points"),
        pearson(F.col(value), F.col("loo_mean")).alias("r"),
        F.sqrt(F.var_pop(diff)).alias("rms"),
    )
    ok = F.col("n_points") >= min_points
    return s.select(piece, performance, "n_points", F.when(ok, F.col("r")).alias("r"),
                    F.when(ok, F.col("rms")).alias("rms"))


def share_at_or_below(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "pct"
) -> DataFrame:
    """Share of the other rows of the group whose value is at or below the own value."""
    from ritardo.operators.quantiles import average_rank

    r = average_rank(df, keys, value, "__r")
    same = df.groupBy(*keys, F.col(value).alias(value)).agg(F.count(value).alias("__m"))
    n = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    r = r.join(same, [*keys, value], "left").join(n, list(keys), "left")
    upto = F.col("__r") + (F.col("__m") - 1) / 2.0
    return r.withColumn(
        name, F.when(F.col("__n") > 1, (upto - 1) / (F.col("__n") - 1))
    ).drop("__r", "__m", "__n")


def icc_interval(components: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds ``icc_low`` and ``icc_high``, the F interval of the single-take consistency; null
    without error variance."""
    n, k = F.col("n"), F.col("k")
    d1, d2 = n - 1, (n - 1) * (k - 1)
    f = F.when(F.col("ms_error") > 0, F.col("ms_rows") / F.col("ms_error"))
    p = F.lit(1 - alpha / 2)
    low, high = f / f_quantile_col(p, d1, d2), f * f_quantile_col(p, d2, d1)
    return components.withColumns({"icc_low": (low - 1) / (low + k - 1),
                                   "icc_high": (high - 1) / (high + k - 1)})


def variance_components(df: DataFrame, keys: Sequence[str], obs: str, take: str, value: str
                        ) -> DataFrame:
    """Two-way consistency variance components from grouped sums; see ``icc_interval``.

    ``df`` holds a full ``obs x take`` table per key. Null results for n < 3 or k < 2.
    """
    keys = list(keys)
    rows = df.groupBy(*keys, obs).agg(F.avg(value).alias("__rm"))
    cols = df.groupBy(*keys, take).agg(F.avg(value).alias("__cm"))
    ra = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop("__rm").alias("__vr"))
    ca = cols.groupBy(*keys).agg(F.count("*").alias("k"), F.var_pop("__cm").alias("__vc"))
    ta = df.groupBy(*keys).agg(F.var_pop(value).alias("__vt"))
    j = join_on(join_on(ra, ca, keys, "inner"), ta, keys, "inner")
    n, k = F.col("n"), F.col("k")
    ssr = k * n * F.col("__vr")
    ssc = n * k * F.col("__vc")
    sse = n * k * F.col("__vt") - ssr - ssc
    ok = (n >= 3) & (k >= 2)
    msr = F.when(ok, ssr / (n - 1))
    mse = F.when(ok, F.greatest(sse, F.lit(0.0)) / ((n - 1) * (k - 1)))
    return j.select(
        *keys, "n", "k", msr.alias("ms_rows"), mse.alias("ms_error"),
        ((msr - mse) / k).alias("var_consistent"), mse.alias("var_specific"),
        ((msr - mse) / F.nullif(msr + (k - 1) * mse, F.lit(0.0))).alias("icc_single"),
        ((msr - mse) / F.nullif(msr, F.lit(0.0))).alias("icc_mean"),
    )


def curve_qc(
    df: DataFrame, piece: str, performance: str, pos: str, value: str, *, miss_pos: float = 0.1,
    miss_perf: float = 0.1,
) -> DataFrame:
    """Keep positions observed in enough performances, then performances observed at enough of
    those; centre what is left per performance."""
    seen = df.groupBy(piece, pos).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("__s"))
    cols = seen.where(F.col("__s") >= 1 - miss_pos).select(piece, pos)
    d = df.join(cols, [piece, pos], "left_semi")
    rows = d.groupBy(piece, performance).agg(
        F.avg(F.col(value).isNotNull().cast("double")).alias("__s"), F.avg(value).alias("__m"))
    rows = rows.where(F.col("__s") >= 1 - miss_perf).select(piece, performance, "__m")
    return d.join(rows, [piece, performance]).withColumn(
        "centred", F.col(value) - F.col("__m")).drop("__m")


def mean_curve_share(df: DataFrame, piece: str, pos: str, value: str) -> DataFrame:
    """Share of the total sum of squares carried by the mean curve (rows centred before)."""
    per = df.groupBy(piece, pos).agg(
        F.count(value).alias("__n"), F.sum(F.col(value) * F.col(value)).alias("__ss"),
        F.avg(value).alias("__m"))
    tot = F.sum("__ss")
    within = F.sum(F.col("__ss") - F.col("__n") * F.col("__m") * F.col("__m"))
    return per.groupBy(piece).agg(F.when(tot > 0, 1 - within / tot).alias("mean_curve_share"))


def shape_distance(df: DataFrame, piece: str, performance: str, pos: str, value: str) -> DataFrame:
    """Distance of each curve to the column median, in units of the median column MAD."""
    c = center(df, [piece, performance], value, "__c")
    sd = cut_lineage(robust_sd(c, [piece, pos], "__c", "__mad"))
    scale = exact_quantiles(sd, [piece], "__mad", {"__scale": 0.5})
    j = c.join(sd.select(piece, pos, "__mad", "__mad_median"), [piece, pos]).join(scale, piece)
    s = F.when(F.col("__scale") > 1e-12, F.col("__scale")).otherwise(1.0)
    z = (F.col("__c") - F.col("__mad_median")) / s
    return j.groupBy(piece, performance).agg(F.sqrt(F.avg(z * z)).alias("distance"))


def filled_curves(df: DataFrame, piece: str, performance: str, pos: str, value: str, width: int
                  ) -> DataFrame:
    """Curves with their missing values filled and each then centred: linear between the observed
    neighbours, by place in the curve and not by ``pos``, and the nearest beyond them. Curves
    without any observed value are left out."""
    keys = [piece, performance]
    i = running_index(df, keys, [pos], chunk_of(pos, width)).withColumn("__s", F.when(
        F.col(value).isNotNull(), F.struct(F.col("idx").alias("i"), F.col(value).alias("v"))))
    s = scan(i, keys, [pos], chunk_of(pos, width), __a=("last", "__s"), __z=("next", "__s"))
    far = F.col("__z.i") - F.col("__a.i")
    line = F.when(far > 0, F.col("__a.v") + (F.col("__z.v") - F.col("__a.v")) * (
        F.col("idx") - F.col("__a.i")) / far)
    s = s.withColumn("filled", F.coalesce(line, "__a.v", "__z.v")).where("filled is not null")
    mean = s.groupBy(*keys).agg(F.avg("filled").alias("__m"))
    return s.join(mean, keys).select(*df.columns, "filled", (F.col("filled") - F.col("__m")).alias(
        "filled_centred"))
