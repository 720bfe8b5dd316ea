"""Agreement metrics over whole tables: ranks, pair orderings, raters, classifiers.

Pair statistics (Kendall's tau, pairwise accuracy) are counted without building pairs: ranks are
split bit by bit, and on every bit level the rows with a 1 look up how many rows with a 0 under
the same higher bits come earlier on the other axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.functions.stats import pearson
from ritardo.operators.consensus import loo_mean
from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.quantiles import average_rank, join_on, value_bucket
from ritardo.session import cut_lineage

RANK_CHUNK = 65536


def spearman(df: DataFrame, keys: Sequence[str], t: str, p: str) -> DataFrame:
    """Spearman correlation per group with mid-ranks, and the number of pairs used."""
    d = df.where(F.col(t).isNotNull() & F.col(p).isNotNull())
    r = average_rank(average_rank(d, keys, t, "__rt"), keys, p, "__rp")
    return r.groupBy(*keys).agg(
        F.count("*").alias("n"), pearson(F.col("__rt"), F.col("__rp")).alias("spearman"))


def dense_rank_by_value(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """0-based dense rank inside the group, from the distinct values cut into value buckets."""
    keys = list(keys)
    v = F.col(value).cast("double")
    d = df.select(*keys, v.alias("__v")).distinct().withColumn("__b", value_bucket("__v"))
    n = d.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    n = n.withColumn("__base", F.sum("__c").over(W.partitionBy(*keys).orderBy("__b")) - F.col(
        "__c"))
    r = d.join(n.select(*keys, "__b", "__base"), [*keys, "__b"]).withColumn(
        name,
        F.col("__base") + F.row_number().over(W.partitionBy(*keys, "__b").orderBy("__v")) - 1,
    )
    return df.withColumn("__v", v).join(r.select(*keys, "__v", name), [*keys, "__v"]).drop("__v")


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def pair_counts(df: DataFrame, keys: Sequence[str], t: str, p: str) -> DataFrame:
    """Concordant, discordant and tied pair counts per group, without building pairs."""
    keys = list(keys)
    d = df.where(F.col(t).isNotNull() & F.col(p).isNotNull()).select(*keys, t, p)
    d = dense_rank_by_value(dense_rank_by_value(d, keys, t, "__rt"), keys, p, "__rp")
    cells = cut_lineage(d.groupBy(*keys, "__rt", "__rp").agg(F.count("*").alias("__c")))
    tot = cells.groupBy(*keys).agg(
        F.sum("__c").alias("n"), F.sum(_choose2(F.col("__c"))).alias("__tb"),
        F.max("__rp").alias("__top"))

    def ties(axis: str, name: str) -> DataFrame:
        g = cells.groupBy(*keys, axis).agg(F.sum("__c").alias("__c"))
        return g.groupBy(*keys).agg(F.sum(_choose2(F.col("__c"))).alias(name))

    # levels 0 .. highest bit of the largest rank of the group
    lv = join_on(cells, tot.select(*keys, "__top"), keys, "inner").withColumn(
        "__l",
        F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("__top") + 1.0)).cast("int"))),
    )
    side = lv.select(
        *keys, "__l", F.expr("shiftright(__rp, __l + 1)").alias("__hi"), "__rt",
        F.when(F.expr("(shiftright(__rp, __l) & 1) = 0"), F.col("__c")).otherwise(0).alias("__z"),
        F.when(F.expr("(shiftright(__rp, __l) & 1) = 1"), F.col("__c")).otherwise(0).alias("__o"),
    ).groupBy(*keys, "__l", "__hi", "__rt").agg(F.sum("__z").alias("__z"), F.sum("__o").alias(
        "__o"))
    run = scan(side, [*keys, "__l", "__hi"], ["__rt"], chunk_of("__rt", RANK_CHUNK),
               __zz=("sum", "__z"))
    conc = run.groupBy(*keys).agg(
        F.sum(F.col("__o") * (F.col("__zz") - F.col("__z"))).alias("concordant"))
    j = join_on(join_on(join_on(tot, ties("__rt", "__tt"), keys, "inner"),
                        ties("__rp", "__tp"), keys, "inner"), conc, keys, "left")
    pairs = _choose2(F.col("n"))
    conc_ = F.coalesce(F.col("concordant"), F.lit(0))
    return j.select(
        *keys, "n", conc_.cast("bigint").alias("concordant"),
        (pairs - F.col("__tt") - F.col("__tp") + F.col("__tb") - conc_).cast("bigint").alias(
            "discordant"),
        (F.col("__tt") - F.col("__tb")).cast("bigint").alias("tied_truth_only"),
        (F.col("__tp") - F.col("__tb")).cast("bigint").alias("tied_pred_only"),
        F.col("__tb").cast("bigint").alias("tied_both"),
    )


def kendall_tau_b(counts: DataFrame) -> Column:
    c, d = F.col("concordant"), F.col("discordant")
    den = F.sqrt((c + d + F.col("tied_truth_only")) * (c + d + F.col("tied_pred_only")))
    return F.when(den > 0, (c - d) / den)


def pairwise_accuracy(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of pairs ordered as the truth; ties in the prediction count one half."""
    c, d, tp = F.sum("concordant"), F.sum("discordant"), F.sum("tied_pred_only")
    n = c + d + tp
    agg = [n.cast("bigint").alias("n_pairs"),
           F.when(n > 0, (c + 0.5 * tp) / n).alias("accuracy")]
    return counts.groupBy(*keys).agg(*agg)


def auc(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """ROC AUC by mid-ranks."""
    r = average_rank(df, keys, score, "__r")
    y = F.col(label).cast("boolean")
    n1, n0 = F.count(F.when(y, 1)), F.count(F.when(~y, 1))
    s = F.sum(F.when(y, F.col("__r")))
    return r.groupBy(*keys).agg(
        n1.alias("n_pos"), n0.alias("n_neg"),
        F.when((n1 > 0) & (n0 > 0), (s - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def rater_parity(
    ratings: DataFrame, keys: Sequence[str], rater: str, segment: str, value: str,
    model: str | None = None, min_segments: int = 10,
) -> DataFrame:
    """Per rater: r of the panel of the others with the rater, and with the model."""
    keys = list(keys)
    d = loo_mean(ratings, [*keys, segment], value).where(
        F.col(value).isNotNull() & F.col("loo_mean").isNotNull())
    aggs = [F.count("*").alias("n_segments"),
            pearson(F.col("loo_mean"), F.col(value)).alias("r_rater")]
    if model:
        d = d.where(F.col(model).isNotNull())
        aggs.append(pearson(F.col("loo_mean"), F.col(model)).alias("r_model"))
    out = d.groupBy(*keys, rater).agg(*aggs)
    ok = F.col("n_segments") >= max(min_segments, 3)
    for c in ("r_rater", "r_model")[: 2 if model else 1]:
        out = out.withColumn(c, F.when(ok, F.col(c)))
    return out


def leakage(used: DataFrame, known: DataFrame, held_ids: DataFrame, held_works: DataFrame
            ) -> DataFrame:
    """Unknown ids, held-out ids and held-out works among the rows used for training."""
    a = used.join(known, "id", "left_anti").agg(F.count("*").alias("n_unknown"))
    b = used.join(held_ids, "id", "left_semi").agg(F.count("*").alias("n_held_out_ids"))
    c = used.join(held_works, "work", "left_semi").agg(
        F.countDistinct("work").alias("n_held_out_works"))
    return a.crossJoin(b).crossJoin(c)


def scale_reliability(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Cronbach's alpha and the mean absolute inter-item correlation."""
    k = len(items)
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    var = sum((F.var_samp(c) for c in items[1:]), F.var_samp(items[0]))
    rs = [F.abs(F.corr(a, b)) for i, a in enumerate(items) for b in items[i + 1:]]
    mean_r = sum(rs[1:], rs[0]) / len(rs)
    return df.agg(F.count("*").alias("n"),
                  (F.lit(k / (k - 1)) * (1 - var / F.var_samp(total))).alias("alpha"),
                  mean_r.alias("mean_abs_r"))


def velocity_agreement(df: DataFrame, keys: Sequence[str], ref: str, est: str) -> DataFrame:
    """Least-squares slope of the estimate on the reference and robust SD of the residual."""
    from ritardo.operators.quantiles import robust_sd

    fit = df.groupBy(*keys).agg(F.regr_slope(est, ref).alias("slope"),
                                F.regr_intercept(est, ref).alias("__a"))
    r = df.join(fit, list(keys)).withColumn(
        "__r", F.col(est) - F.col("__a") - F.col("slope") * F.col(ref))
    sd = robust_sd(r, keys, "__r", "resid_rsd").select(*keys, "resid_rsd")
    return fit.drop("__a").join(sd, list(keys))


def rollup_summary(df: DataFrame, key: str, value: str, num: str, other: str) -> DataFrame:
    """Per group and overall (``ALL``): count, mean, exact median, pooled 2a / (a + b)."""
    from ritardo.operators.quantiles import exact_quantiles

    cols = [F.col(value).alias("__v"), F.col(num).alias("__a"), F.col(other).alias("__b")]
    both = df.select(key, *cols).unionByName(df.select(F.lit("ALL").alias(key), *cols))
    value, num, other = "__v", "__a", "__b"
    med = exact_quantiles(both, [key], value, {"median_f1": 0.5})
    s = both.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean_f1"),
        (2 * F.sum(num) / (F.sum(num) + F.sum(other))).alias("pooled"))
    return s.join(med, key)
