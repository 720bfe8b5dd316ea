"""Consensus, tier and interpretation-band queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.operators import consensus as C
from ritardo.operators.quantiles import exact_quantiles, loo_quantiles, robust_sd
from ritardo.functions.stats import tier
from ritardo.plans.registry import query
from ritardo.plans.standins import curves, notes, sql, takes


def rnd(df, digits, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def _gappy(spark, sf):
    """Curves with every ninth cell, by number, unobserved; values keep their whole range."""
    seen = (F.col("performance_id") * 31 + F.col("beat") * 7) % 9 != 0
    return curves(spark, sf).withColumn("y", F.when(seen, F.col("x"))).withColumn(
        "bar", F.expr("beat div 8"))


GAPPY = """, g AS (SELECT *, CASE WHEN (performance_id * 31 + beat * 7) % 9 <> 0 THEN x END AS y, beat // 8 AS bar FROM curves)"""


@query("per_bar_stats", sql("curves", GAPPY + """
, b AS (SELECT DISTINCT piece_id, performance_id, bar FROM g),
m AS (SELECT piece_id, performance_id, bar, median(y) AS med FROM g GROUP BY 1, 2, 3),
r AS (SELECT g.piece_id, g.performance_id, g.bar, 1.4826 * median(abs(y - med)) AS rsd
  FROM g JOIN m USING (piece_id, performance_id, bar) GROUP BY 1, 2, 3)
SELECT piece_id, performance_id, bar, round(sqrt(avg(y * y)), 6) AS rms, round(avg(y), 6) AS mean,
  round(coalesce(sum(y), 0), 6) AS sum, count(y) AS n, round(any_value(rsd), 6) AS robust_sd
FROM g JOIN r USING (piece_id, performance_id, bar) GROUP BY 1, 2, 3"""))
def per_bar_stats(spark, sf):
    g = _gappy(spark, sf)
    k = ["piece_id", "performance_id", "bar"]
    return rnd(C.per_bar(g, g.select(*k).distinct(), k, "y"), 6, "rms", "mean", "sum", "robust_sd")


@query("robust_sd", sql("curves", """
, m AS (SELECT piece_id, median(x) AS med FROM curves GROUP BY 1)
SELECT piece_id, round(1.4826 * median(abs(x - med)), 9) AS robust_sd,
  round(any_value(med), 9) AS robust_sd_median, count(*) AS robust_sd_n
FROM curves JOIN m USING (piece_id) GROUP BY 1"""))
def robust_sd_by_piece(spark, sf):
    return rnd(robust_sd(curves(spark, sf), ["piece_id"], "x"), 9, "robust_sd",
               "robust_sd_median")


@query("bar_mean_quantiles", sql("curves", GAPPY + """
, b AS (SELECT piece_id, bar, performance_id, avg(y) AS v FROM g GROUP BY 1, 2, 3)
SELECT piece_id, bar, round(quantile_cont(v, 0.1), 9) AS lo, round(quantile_cont(v, 0.5), 9) AS mid,
  round(quantile_cont(v, 0.9), 9) AS hi, count(v) AS n_refs FROM b GROUP BY 1, 2"""))
def bar_mean_quantiles(spark, sf):
    q = C.bar_quantiles(_gappy(spark, sf), ["piece_id", "bar"], "performance_id", "y")
    return rnd(q, 9, "lo", "mid", "hi")


@query("bar_rms_quantiles", sql("curves", GAPPY + """
, b AS (SELECT piece_id, bar, performance_id, sqrt(avg(y * y)) AS v FROM g GROUP BY 1, 2, 3)
SELECT piece_id, bar, round(quantile_cont(v, 0.1), 9) AS lo, round(quantile_cont(v, 0.5), 9) AS mid,
  round(quantile_cont(v, 0.9), 9) AS hi, count(v) AS n_refs FROM b GROUP BY 1, 2"""))
def bar_rms_quantiles(spark, sf):
    q = C.bar_quantiles(_gappy(spark, sf), ["piece_id", "bar"], "performance_id", "y", how="rms")
    return rnd(q, 9, "lo", "mid", "hi")


@query("reference_tiers", sql("curves", """
, b AS (SELECT piece_id, performance_id, provenance, beat // 8 AS bar, sqrt(avg(x * x)) AS v
  FROM curves GROUP BY 1, 2, 3, 4),
l AS (SELECT piece_id, bar, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99,
  count(*) AS n_refs FROM b WHERE provenance = 'sensor' GROUP BY 1, 2)
SELECT b.piece_id, b.performance_id, b.bar, round(b.v, 9) AS v,
  CASE WHEN n_refs < 10 OR n_refs IS NULL THEN 'none' WHEN v > q99 THEN 'strong'
       WHEN v > q95 THEN 'notable' ELSE 'none' END AS tier
FROM b LEFT JOIN l USING (piece_id, bar) WHERE provenance = 'transcribed'"""))
def reference_tiers(spark, sf):
    b = curves(spark, sf).groupBy(
        "piece_id", "performance_id", "provenance", F.expr("beat div 8").alias("bar")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("v"))
    lim = C.reference_limits(b.where("provenance = 'sensor'"), ["piece_id", "bar"], "v")
    t = b.where("provenance = 'transcribed'").join(lim, ["piece_id", "bar"], "left")
    return t.select("piece_id", "performance_id", "bar", F.round("v", 9).alias("v"),
                    tier(F.col("v"), F.col("q95"), F.col("q99")).alias("tier"))


# ------------------------------------------------------------------ correctness bars and tiers

def note_bars(spark, sf):
    """Per-bar error counts: event type = piece, user = performance, k decides the label."""
    n = notes(spark, sf)
    lab = (F.when(F.col("k") < 70, "correct").when(F.col("k") < 80, "wrong_pitch")
           .when(F.col("k") < 92, "missed").otherwise("extra"))
    n = n.select(F.col("event_type").alias("piece_id"), "performance_id",
                 F.expr("onset_us div 5000000").alias("measure_idx"), lab.alias("lab"))

    def cnt(*labs):
        return F.count(F.when(F.col("lab").isin(*labs), 1))

    return n.groupBy("piece_id", "performance_id", "measure_idx").agg(
        cnt("correct", "wrong_pitch", "missed").alias("n_score_notes"),
        cnt("wrong_pitch").alias("n_wrong_pitch"), cnt("missed").alias("n_missed"),
        cnt("extra").alias("n_extra"))


NOTE_BARS = """, nb AS (SELECT event_type AS piece_id, performance_id, onset_us // 5000000 AS measure_idx,
  count(*) FILTER (k < 92) AS n_score_notes, count(*) FILTER (k >= 70 AND k < 80) AS n_wrong_pitch,
  count(*) FILTER (k >= 80 AND k < 92) AS n_missed, count(*) FILTER (k >= 92) AS n_extra
  FROM notes GROUP BY 1, 2, 3)"""

LOO_LIMITS = NOTE_BARS + """
, lim AS (SELECT a.piece_id, a.performance_id, a.measure_idx, count(b.performance_id) AS n_experts,
  quantile_cont(CAST(b.n_wrong_pitch AS DOUBLE), 0.8) AS w95,
  quantile_cont(CAST(b.n_wrong_pitch AS DOUBLE), 0.99) AS w99,
  quantile_cont((b.n_missed + b.n_extra) / b.n_score_notes, 0.8) AS m95,
  quantile_cont((b.n_missed + b.n_extra) / b.n_score_notes, 0.99) AS m99
  FROM nb a LEFT JOIN nb b ON a.piece_id = b.piece_id AND a.measure_idx = b.measure_idx
    AND a.performance_id <> b.performance_id AND b.n_score_notes > 0 GROUP BY 1, 2, 3),
lm AS (SELECT nb.*, lim.n_experts,
  CASE WHEN n_experts >= 5 THEN w95 END AS wrong_notable, CASE WHEN n_experts >= 5 THEN w99 END AS wrong_strong,
  CASE WHEN n_experts >= 5 THEN m95 END AS me_notable, CASE WHEN n_experts >= 5 THEN m99 END AS me_strong
  FROM nb JOIN lim USING (piece_id, performance_id, measure_idx)),
tr AS (SELECT *, CASE WHEN n_score_notes > 0 THEN (n_missed + n_extra) / n_score_notes END AS rate,
  greatest(1.0, coalesce(wrong_notable, 1.0)) AS lw95, greatest(2.0, coalesce(wrong_strong, 2.0)) AS lw99,
  greatest(0.25, coalesce(me_notable, 0.25)) AS lm95, greatest(0.5, coalesce(me_strong, 0.5)) AS lm99 FROM lm),
ti AS (SELECT *, greatest(CASE WHEN n_wrong_pitch > lw99 THEN 2 WHEN n_wrong_pitch > lw95 THEN 1 ELSE 0 END,
  CASE WHEN rate IS NULL THEN 0 WHEN rate > lm99 THEN 2 WHEN rate > lm95 THEN 1 ELSE 0 END) AS tr,
  greatest(n_wrong_pitch / lw95, coalesce(rate / lm95, 0)) AS magnitude FROM tr)"""


@query("bar_counts_by_label", sql("notes", NOTE_BARS + """
SELECT piece_id, performance_id, measure_idx, n_score_notes, n_wrong_pitch, n_missed, n_extra,
  n_score_notes - n_wrong_pitch - n_missed AS n_correct,
  n_wrong_pitch + n_missed + n_extra AS n_errors,
  round((n_score_notes - n_wrong_pitch - n_missed) / nullif(n_score_notes, 0), 9) AS accuracy
FROM nb"""))
def bar_counts_by_label(spark, sf):
    b = note_bars(spark, sf)
    ok = F.col("n_score_notes") - F.col("n_wrong_pitch") - F.col("n_missed")
    return b.withColumns({
        "n_correct": ok,
        "n_errors": F.col("n_wrong_pitch") + F.col("n_missed") + F.col("n_extra"),
        "accuracy": F.round(F.when(F.col("n_score_notes") > 0, ok / F.col("n_score_notes")), 9),
    })


@query("expert_bar_limits", sql("notes", LOO_LIMITS + """
SELECT piece_id, performance_id, measure_idx, n_experts, round(wrong_notable, 9) AS wrong_notable,
  round(wrong_strong, 9) AS wrong_strong, round(me_notable, 9) AS me_notable, round(me_strong, 9) AS me_strong FROM lm"""))
def expert_bar_limits(spark, sf):
    b = C.expert_bar_limits(note_bars(spark, sf), ["piece_id", "measure_idx"])
    b = rnd(b, 9, "wrong_notable", "wrong_strong", "me_notable", "me_strong")
    return b.select("piece_id", "performance_id", "measure_idx", "n_experts", "wrong_notable",
                    "wrong_strong", "me_notable", "me_strong")


@query("expert_limits_order_statistic", sql("notes", NOTE_BARS + """
, g AS (SELECT piece_id, measure_idx, n_wrong_pitch AS w, (n_missed + n_extra) / n_score_notes AS m
  FROM nb WHERE n_score_notes > 0),
a AS (SELECT piece_id, measure_idx, count(*) AS n_experts, quantile_cont(CAST(w AS DOUBLE), 0.8) AS w95,
  quantile_cont(m, 0.8) AS m95, list_sort(list(w)) AS ws, list_sort(list(m)) AS ms,
  CAST(ceil(0.99 * (count(*) + 1) - 1e-9) AS BIGINT) AS r FROM g GROUP BY 1, 2)
SELECT piece_id, measure_idx, n_experts,
  CASE WHEN n_experts >= 5 THEN round(w95, 9) END AS wrong_notable,
  CASE WHEN n_experts >= 5 THEN CAST(ws[least(r, n_experts)] AS DOUBLE)
    + CASE WHEN r > n_experts THEN 1.0 ELSE 0.0 END END AS wrong_strong,
  CASE WHEN n_experts >= 5 THEN round(m95, 9) END AS me_notable,
  CASE WHEN n_experts >= 5 THEN round(ms[least(r, n_experts)], 9) END AS me_strong,
  CASE WHEN n_experts >= 5 AND r > n_experts THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS me_strong_margin_notes
FROM a"""))
def expert_limits_order_statistic(spark, sf):
    b = C.expert_limits_order_statistic(note_bars(spark, sf), ["piece_id", "measure_idx"],
                                        strong_margin=1)
    return rnd(b, 9, "wrong_notable", "me_notable", "me_strong")


def checked_bars(spark, sf):
    b = C.expert_bar_limits(note_bars(spark, sf), ["piece_id", "measure_idx"])
    t, m = C.correctness_tier(F.col("n_wrong_pitch"), F.col("n_missed") + F.col("n_extra"),
                              F.col("n_score_notes"), C.checked_limits())
    return b.withColumns({"tier": t, "magnitude": m})


@query("bar_expert_tiers", sql("notes", LOO_LIMITS + """
SELECT piece_id, performance_id, measure_idx, n_score_notes, n_wrong_pitch, n_missed, n_extra,
  n_experts, CASE tr WHEN 2 THEN 'strong' WHEN 1 THEN 'notable' ELSE 'none' END AS tier,
  round(magnitude, 9) AS magnitude FROM ti"""))
def bar_expert_tiers(spark, sf):
    return checked_bars(spark, sf).select(
        "piece_id", "performance_id", "measure_idx", "n_score_notes", "n_wrong_pitch", "n_missed",
        "n_extra", "n_experts", "tier", F.round("magnitude", 9).alias("magnitude"))


@query("global_correctness_tiers", sql("notes", NOTE_BARS + """
, r AS (SELECT *, CASE WHEN n_score_notes > 0 THEN (n_missed + n_extra) / n_score_notes END AS rate FROM nb)
SELECT piece_id, performance_id, measure_idx,
  CASE greatest(CASE WHEN n_wrong_pitch > 2 THEN 2 WHEN n_wrong_pitch > 1 THEN 1 ELSE 0 END,
    CASE WHEN rate IS NULL THEN 0 WHEN rate > 0.5 THEN 2 WHEN rate > 0.25 THEN 1 ELSE 0 END)
    WHEN 2 THEN 'strong' WHEN 1 THEN 'notable' ELSE 'none' END AS tier,
  round(greatest(n_wrong_pitch / 1.0, coalesce(rate / 0.25, 0)), 9) AS magnitude FROM r"""))
def global_correctness_tiers(spark, sf):
    t, m = C.correctness_tier(F.col("n_wrong_pitch"), F.col("n_missed") + F.col("n_extra"),
                              F.col("n_score_notes"))
    return note_bars(spark, sf).select("piece_id", "performance_id", "measure_idx",
                                       t.alias("tier"), F.round(m, 9).alias("magnitude"))


@query("ranked_issues", sql("notes", LOO_LIMITS + """
, g AS (SELECT *, measure_idx - row_number() OVER (PARTITION BY piece_id, performance_id
    ORDER BY measure_idx) AS isl FROM ti WHERE tr > 0),
sp AS (SELECT piece_id, performance_id, min(measure_idx) AS first_bar, max(measure_idx) AS last_bar,
  max(tr) AS tr, round(max(magnitude), 9) AS magnitude FROM g GROUP BY piece_id, performance_id, isl)
SELECT piece_id, performance_id, first_bar, last_bar,
  CASE tr WHEN 2 THEN 'strong' ELSE 'notable' END AS tier, magnitude,
  row_number() OVER (PARTITION BY piece_id, performance_id
    ORDER BY tr DESC, magnitude DESC, first_bar) AS rank
FROM sp"""))
def ranked_issues(spark, sf):
    from ritardo.operators.report import issue_spans, rank_issues

    b = checked_bars(spark, sf)
    sp = issue_spans(b, ["piece_id", "performance_id"], "measure_idx", "tier", "magnitude")
    sp = sp.withColumn("magnitude", F.round("magnitude", 9))
    return rank_issues(sp, ["piece_id", "performance_id"]).drop("tier_rank")


# ------------------------------------------------------------------ timing consensus

@query("timing_consensus", sql("curves", GAPPY + """
SELECT piece_id, beat, count(y) AS n_refs,
  CASE WHEN count(y) >= 3 THEN round(avg(y), 9) END AS consensus,
  round(stddev_samp(y), 9) AS sd_refs FROM g GROUP BY 1, 2"""))
def timing_consensus(spark, sf):
    c = C.timing_consensus(_gappy(spark, sf), ["piece_id", "beat"], "y")
    return rnd(c, 9, "consensus", "sd_refs")


@query("timing_noise_summary", sql("curves", GAPPY + """
, s AS (SELECT piece_id, beat, sum(y) AS s, count(y) AS n FROM g GROUP BY 1, 2),
l AS (SELECT g.*, n - (y IS NOT NULL)::INT AS no,
  CASE WHEN n - (y IS NOT NULL)::INT >= 3 THEN (s - coalesce(y, 0)) / (n - (y IS NOT NULL)::INT) END AS loo
  FROM g JOIN s USING (piece_id, beat)),
e AS (SELECT *, y - loo AS noise FROM l),
a AS (SELECT piece_id, performance_id, sqrt(avg(noise * noise)) AS noise_rms,
  count(noise) / greatest(count(y), 1) AS coverage,
  1 - avg(noise * noise) / avg(y * y) FILTER (noise IS NOT NULL) AS consensus_r2,
  median(no) FILTER (noise IS NOT NULL) AS n_refs_median FROM e GROUP BY 1, 2)
SELECT piece_id, performance_id, round(noise_rms, 9) AS noise_rms, round(coverage, 9) AS coverage,
  round(consensus_r2, 6) AS consensus_r2, round(n_refs_median, 3) AS n_refs_median,
  CASE WHEN coverage >= 0.5 THEN 'consensus' ELSE 'nometric' END AS source FROM a"""))
def timing_noise_summary(spark, sf):
    g = C.loo_mean(_gappy(spark, sf), ["piece_id", "beat"], "y", 3)
    g = g.withColumn("noise", F.col("y") - F.col("loo_mean"))
    s = C.timing_noise_summary(g, ["piece_id", "performance_id"], "y")
    s = rnd(rnd(s, 9, "noise_rms", "coverage"), 6, "consensus_r2")
    return rnd(s, 3, "n_refs_median")


@query("timing_noise_bars", sql("curves", GAPPY + """
, r AS (SELECT * FROM g WHERE provenance = 'sensor'),
s AS (SELECT piece_id, beat, sum(y) AS s, count(y) AS n FROM r GROUP BY 1, 2),
t AS (SELECT g.piece_id, g.performance_id, g.bar, g.y - CASE WHEN n >= 3 THEN s / n END AS e
  FROM g LEFT JOIN s USING (piece_id, beat) WHERE provenance = 'transcribed'),
tb AS (SELECT piece_id, performance_id, bar, sqrt(avg(e * e)) AS noise_rms, count(e) AS n_positions
  FROM t GROUP BY 1, 2, 3),
re AS (SELECT r.piece_id, r.performance_id, r.bar,
  CASE WHEN n - 1 >= 3 THEN r.y - (s - r.y) / (n - 1) END AS e FROM r JOIN s USING (piece_id, beat)
  WHERE r.y IS NOT NULL),
rb AS (SELECT piece_id, performance_id, bar, sqrt(avg(e * e)) AS v FROM re GROUP BY 1, 2, 3),
l AS (SELECT piece_id, bar, count(v) AS n_refs, quantile_cont(v, 0.95) AS q95,
  quantile_cont(v, 0.99) AS q99 FROM rb GROUP BY 1, 2)
SELECT piece_id, performance_id, bar, round(noise_rms, 9) AS noise_rms, n_positions, n_refs,
  CASE WHEN n_refs >= 10 THEN round(q95, 9) END AS q95, CASE WHEN n_refs >= 10 THEN round(q99, 9) END AS q99,
  CASE WHEN noise_rms IS NULL OR n_refs < 10 THEN 'none' WHEN noise_rms > q99 THEN 'strong'
       WHEN noise_rms > q95 THEN 'notable' ELSE 'none' END AS tier
FROM tb LEFT JOIN l USING (piece_id, bar)"""))
def timing_noise_bars(spark, sf):
    g = _gappy(spark, sf)
    out = C.timing_noise_bars(g.where("provenance = 'transcribed'"),
                              g.where("provenance = 'sensor'"), "piece_id", "performance_id",
                              "beat", "bar", "y")
    return rnd(out, 9, "noise_rms", "q95", "q99")


@query("curve_agreement", sql("curves", GAPPY + """
, s AS (SELECT piece_id, beat, sum(y) AS s, count(y) AS n FROM g GROUP BY 1, 2),
l AS (SELECT g.*, (s - y) / (n - 1) AS loo FROM g JOIN s USING (piece_id, beat)
  WHERE y IS NOT NULL AND n - 1 >= 2),
a AS (SELECT piece_id, performance_id, count(*) AS n_points, corr(y, loo) AS r,
  stddev_pop(y - loo) AS rms FROM l GROUP BY 1, 2)
SELECT a.piece_id, a.performance_id, a.n_points, round(a.r, 9) AS r, round(a.rms, 9) AS rms,
  round((SELECT count(*) FROM a b WHERE b.piece_id = a.piece_id AND b.performance_id <> a.performance_id
    AND round(b.rms, 12) <= round(a.rms, 12)) / (count(*) OVER (PARTITION BY a.piece_id) - 1), 9) AS pct
FROM a"""))
def curve_agreement(spark, sf):
    a = C.curve_agreement(_gappy(spark, sf), "piece_id", "performance_id", "beat", "y")
    a = a.withColumn("rms", F.round("rms", 12))
    return rnd(C.share_at_or_below(a, ["piece_id"], "rms"), 9, "r", "rms", "pct")


@query("reference_relative_features", sql("takes", """
SELECT a.performance_id, a.tier, a.year, count(b.price) AS n_others,
  round(a.price - quantile_cont(b.price, 0.5), 6) AS rel_price
FROM takes a LEFT JOIN takes b ON a.tier = b.tier AND a.year = b.year
  AND a.performance_id <> b.performance_id
GROUP BY 1, 2, 3, a.price"""))
def reference_relative_features(spark, sf):
    t = loo_quantiles(takes(spark, sf), ["tier", "year"], "price", {"m": 0.5})
    return t.select("performance_id", "tier", "year", "n_others",
                    F.round(F.col("price") - F.col("m"), 6).alias("rel_price"))


# ------------------------------------------------------------------ takes

TAKE = """, d AS (SELECT piece_id, performance_id AS take, beat, x,
  x - avg(x) OVER (PARTITION BY piece_id, performance_id) AS c FROM curves)"""


@query("variance_components", sql("curves", TAKE + """
, r AS (SELECT *, avg(c) OVER (PARTITION BY piece_id, beat) AS rm,
  avg(c) OVER (PARTITION BY piece_id, take) AS cm, avg(c) OVER (PARTITION BY piece_id) AS gm FROM d),
a AS (SELECT piece_id, count(DISTINCT beat) AS n, count(DISTINCT take) AS k,
  sum((rm - gm) * (rm - gm)) AS ssr, sum((c - rm - cm + gm) * (c - rm - cm + gm)) AS sse
  FROM r GROUP BY 1),
m AS (SELECT piece_id, n, k, ssr / (n - 1) AS msr, sse / ((n - 1) * (k - 1)) AS mse FROM a)
SELECT piece_id, n, k, round(msr, 9) AS ms_rows, round(mse, 9) AS ms_error,
  round((msr - mse) / k, 9) AS var_consistent, round(mse, 9) AS var_specific,
  round((msr - mse) / (msr + (k - 1) * mse), 9) AS icc_single, round((msr - mse) / msr, 9) AS icc_mean
FROM m"""))
def variance_components(spark, sf):
    d = C.center(curves(spark, sf), ["piece_id", "performance_id"], "x", "c")
    v = C.variance_components(d, ["piece_id"], "beat", "performance_id", "c")
    return rnd(v, 9, "ms_rows", "ms_error", "var_consistent", "var_specific", "icc_single",
               "icc_mean")


@query("decompose_takes_bars", sql("curves", TAKE + """
, r AS (SELECT *, beat // 8 AS bar, avg(c) OVER (PARTITION BY piece_id, beat) AS cons FROM d),
k AS (SELECT piece_id, count(DISTINCT take) AS k FROM d GROUP BY 1)
SELECT piece_id, bar, count(DISTINCT beat) AS n, round(avg(cons), 9) AS consistent_mean,
  round(stddev_pop(cons), 9) AS consistent_sd,
  round(sqrt(sum((c - cons) * (c - cons)) / (count(DISTINCT beat) * (any_value(k) - 1))), 9)
    AS specific_rms
FROM r JOIN k USING (piece_id) GROUP BY 1, 2"""))
def decompose_takes_bars(spark, sf):
    from ritardo.operators.takes import decompose, bar_table

    d = decompose(curves(spark, sf), "piece_id", "performance_id", "beat", "x")
    b = bar_table(d.withColumn("bar", F.expr("beat div 8")), ["piece_id", "bar"], "beat")
    return rnd(b, 9, "consistent_mean", "consistent_sd", "specific_rms")


# ------------------------------------------------------------------ curve matrices

@query("curve_qc", sql("curves", GAPPY + """
, c1 AS (SELECT piece_id, beat FROM g GROUP BY 1, 2 HAVING avg((y IS NOT NULL)::INT) >= 0.88),
d AS (SELECT g.* FROM g JOIN c1 USING (piece_id, beat)),
r1 AS (SELECT piece_id, performance_id, avg(y) AS m FROM d GROUP BY 1, 2
  HAVING avg((y IS NOT NULL)::INT) >= 0.88)
SELECT piece_id, performance_id, beat, round(y - m, 9) AS centred
FROM d JOIN r1 USING (piece_id, performance_id)"""))
def curve_qc(spark, sf):
    out = C.curve_qc(_gappy(spark, sf), "piece_id", "performance_id", "beat", "y", miss_pos=0.12,
                     miss_perf=0.12)
    return out.select("piece_id", "performance_id", "beat", F.round("centred", 9).alias("centred"))


@query("mean_curve_share", sql("curves", """
, c AS (SELECT *, x - avg(x) OVER (PARTITION BY piece_id, performance_id) AS v FROM curves),
m AS (SELECT *, avg(v) OVER (PARTITION BY piece_id, beat) AS cm FROM c)
SELECT piece_id, round(1 - sum((v - cm) * (v - cm)) / sum(v * v), 9) AS mean_curve_share
FROM m GROUP BY 1"""))
def mean_curve_share(spark, sf):
    c = C.center(curves(spark, sf), ["piece_id", "performance_id"], "x", "v")
    return rnd(C.mean_curve_share(c, "piece_id", "beat", "v"), 9, "mean_curve_share")


@query("expert_band_per_beat", sql("curves", """
, c AS (SELECT *, x - avg(x) OVER (PARTITION BY piece_id, performance_id) AS v FROM curves)
SELECT piece_id, beat, count(*) AS n_refs, round(quantile_cont(v, 0.1), 9) AS band_lo,
  round(quantile_cont(v, 0.5), 9) AS band_mid, round(quantile_cont(v, 0.9), 9) AS band_hi
FROM c WHERE provenance = 'sensor' GROUP BY 1, 2 HAVING count(*) >= 10"""))
def expert_band_per_beat(spark, sf):
    c = C.center(curves(spark, sf), ["piece_id", "performance_id"], "x", "v")
    from ritardo.operators.tables import expert_band

    q = expert_band(c.where("provenance = 'sensor'"), ["piece_id", "beat"], "v", (0.1, 0.5, 0.9), 10)
    return rnd(q, 9, "band_lo", "band_mid", "band_hi")


@query("window_quality", sql("curves", GAPPY + """
, r AS (SELECT * FROM g WHERE provenance = 'sensor'),
c1 AS (SELECT piece_id, beat, beat // 16 AS win FROM r GROUP BY 1, 2, 3
  HAVING avg((y IS NOT NULL)::INT) >= 0.85),
r1 AS (SELECT r.piece_id, c1.win, r.performance_id FROM r JOIN c1 USING (piece_id, beat)
  GROUP BY 1, 2, 3 HAVING avg((r.y IS NOT NULL)::INT) >= 0.85),
w AS (SELECT DISTINCT piece_id, beat // 16 AS win FROM r),
nb AS (SELECT piece_id, win, count(*) AS n_beats FROM c1 GROUP BY 1, 2),
nr AS (SELECT piece_id, win, count(*) AS n_refs FROM r1 GROUP BY 1, 2)
SELECT w.piece_id, w.win, coalesce(n_beats, 0) AS n_beats, coalesce(n_refs, 0) AS n_refs,
  CASE WHEN coalesce(n_beats, 0) < 8 THEN 'too_few_beats' WHEN coalesce(n_refs, 0) < 10
    THEN 'too_few_references' ELSE 'ok' END AS status
FROM w LEFT JOIN nb USING (piece_id, win) LEFT JOIN nr USING (piece_id, win)"""))
def window_quality(spark, sf):
    from ritardo.operators.interpretation import window_quality as wq

    g = _gappy(spark, sf).where("provenance = 'sensor'").withColumn(
        "win", F.expr("beat div 16"))
    return wq(g, ["piece_id", "win"], "performance_id", "beat", "y", miss_pos=0.15,
              miss_ref=0.15)


@query("window_magnitude", sql("curves", """
, m AS (SELECT piece_id, beat // 16 AS win, performance_id, provenance, stddev_pop(x) AS mag
  FROM curves GROUP BY 1, 2, 3, 4),
q AS (SELECT piece_id, win, quantile_cont(mag, 0.05) AS lo, quantile_cont(mag, 0.5) AS mid,
  quantile_cont(mag, 0.95) AS hi, count(*) AS n FROM m WHERE provenance = 'sensor' GROUP BY 1, 2)
SELECT t.piece_id, t.win, t.performance_id, round(t.mag, 9) AS magnitude,
  round(q.mid, 9) AS magnitude_ref_median,
  round((SELECT count(*) FROM m r WHERE r.provenance = 'sensor' AND r.piece_id = t.piece_id
    AND r.win = t.win AND r.mag <= t.mag) / q.n, 9) AS magnitude_pct,
  t.mag < q.lo AS too_flat, t.mag > q.hi AS too_extreme
FROM m t JOIN q USING (piece_id, win) WHERE t.provenance = 'transcribed'"""))
def window_magnitude(spark, sf):
    from ritardo.operators.interpretation import magnitude_flags

    c = curves(spark, sf).withColumn("win", F.expr("beat div 16"))
    out = magnitude_flags(c.where("provenance = 'transcribed'"), c.where("provenance = 'sensor'"),
                          ["piece_id", "win"], "performance_id", "x")
    return rnd(out, 9, "magnitude", "magnitude_ref_median", "magnitude_pct")


@query("interpretation_bar_tiers", sql("curves", """
, c AS (SELECT *, x - avg(x) OVER (PARTITION BY piece_id, performance_id) AS v FROM curves),
s AS (SELECT piece_id, beat, sum(v) AS s, count(*) AS n FROM c WHERE provenance = 'sensor' GROUP BY 1, 2),
e AS (SELECT c.piece_id, c.performance_id, c.provenance, c.beat // 8 AS bar,
  v - CASE WHEN provenance = 'sensor' THEN (s - v) / (n - 1) ELSE s / n END AS d
  FROM c JOIN s USING (piece_id, beat)),
b AS (SELECT piece_id, performance_id, provenance, bar, sqrt(avg(d * d)) AS v FROM e GROUP BY 1, 2, 3, 4),
l AS (SELECT piece_id, bar, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.99) AS q99 FROM b
  WHERE provenance = 'sensor' GROUP BY 1, 2)
SELECT piece_id, performance_id, bar, round(v, 9) AS dev_rms, v > q95 AS out_of_band,
  CASE WHEN v > q99 THEN 'strong' WHEN v > q95 THEN 'notable' ELSE 'none' END AS tier,
  round(v / q95, 9) AS magnitude
FROM b JOIN l USING (piece_id, bar) WHERE provenance = 'transcribed'"""))
def interpretation_bar_tiers(spark, sf):
    from ritardo.operators.interpretation import bar_deviation_tiers

    c = C.center(curves(spark, sf), ["piece_id", "performance_id"], "x", "v")
    c = c.withColumn("bar", F.expr("beat div 8"))
    out = bar_deviation_tiers(c.where("provenance = 'transcribed'"),
                              c.where("provenance = 'sensor'"), "piece_id", "performance_id",
                              "beat", "bar", "v")
    return rnd(out, 9, "dev_rms", "magnitude")


@query("rank_experts", sql("curves", """
, c AS (SELECT *, x - avg(x) OVER (PARTITION BY piece_id, performance_id) AS v FROM curves),
m AS (SELECT piece_id, beat, median(v) AS med FROM c GROUP BY 1, 2),
a AS (SELECT piece_id, beat, 1.4826 * median(abs(v - med)) AS mad FROM c JOIN m USING (piece_id, beat)
  GROUP BY 1, 2),
s AS (SELECT piece_id, median(mad) AS scale FROM a GROUP BY 1),
d AS (SELECT piece_id, performance_id, sqrt(avg(((v - med) / scale) * ((v - med) / scale))) AS distance
  FROM c JOIN m USING (piece_id, beat) JOIN s USING (piece_id) GROUP BY 1, 2)
SELECT piece_id, performance_id, round(distance, 9) AS distance,
  row_number() OVER (PARTITION BY piece_id ORDER BY distance, performance_id) AS rank FROM d"""))
def rank_experts(spark, sf):
    from ritardo.operators.report import rank_in_group

    d = C.shape_distance(curves(spark, sf), "piece_id", "performance_id", "beat", "x")
    return rnd(rank_in_group(d, ["piece_id"], "distance", "performance_id"), 9, "distance")


@query("choose_velocity_references", sql("curves", """
, p AS (SELECT DISTINCT piece_id, performance_id, provenance FROM curves),
n AS (SELECT piece_id, count(*) FILTER (provenance = 'sensor') AS ns FROM p GROUP BY 1)
SELECT p.piece_id, p.performance_id, CASE WHEN ns >= 25 THEN 'sensor' ELSE 'all' END AS source
FROM p JOIN n USING (piece_id) WHERE ns < 25 OR provenance = 'sensor'"""))
def choose_velocity_references(spark, sf):
    from ritardo.operators.interpretation import velocity_references

    p = curves(spark, sf).select("piece_id", "performance_id", "provenance").distinct()
    return velocity_references(p, "piece_id", min_sensor=25).select(
        "piece_id", "performance_id", "source")


@query("overall_tempo_band", sql("curves", """
, t AS (SELECT piece_id, performance_id, provenance, exp(avg(x)) AS tempo FROM curves GROUP BY 1, 2, 3),
q AS (SELECT piece_id, quantile_cont(tempo, 0.1) AS q10, quantile_cont(tempo, 0.5) AS q50,
  quantile_cont(tempo, 0.9) AS q90, count(*) AS n FROM t WHERE provenance = 'sensor' GROUP BY 1)
SELECT t.piece_id, t.performance_id, round(tempo, 9) AS tempo, round(q10, 9) AS q10,
  round(q50, 9) AS median, round(q90, 9) AS q90,
  round((SELECT count(*) FROM t r WHERE r.provenance = 'sensor' AND r.piece_id = t.piece_id
    AND r.tempo < t.tempo) / n, 9) AS share_slower
FROM t JOIN q USING (piece_id) WHERE provenance = 'transcribed'"""))
def overall_tempo_band(spark, sf):
    from ritardo.operators.interpretation import tempo_band

    t = curves(spark, sf).groupBy("piece_id", "performance_id", "provenance").agg(
        F.exp(F.avg("x")).alias("tempo"))
    out = tempo_band(t.where("provenance = 'transcribed'"), t.where("provenance = 'sensor'"),
                     "piece_id", "tempo")
    return rnd(out.drop("provenance"), 9, "tempo", "q10", "median", "q90", "share_slower")


@query("curve_qc_filled", sql("curves", GAPPY + """
, c1 AS (SELECT piece_id, beat FROM g GROUP BY 1, 2 HAVING avg((y IS NOT NULL)::INT) >= 0.88),
d AS (SELECT g.* FROM g JOIN c1 USING (piece_id, beat)),
r1 AS (SELECT piece_id, performance_id FROM d GROUP BY 1, 2 HAVING avg((y IS NOT NULL)::INT) >= 0.88),
i AS (SELECT d.*, row_number() OVER w AS i, CASE WHEN y IS NOT NULL THEN row_number() OVER w END AS oi
  FROM d JOIN r1 USING (piece_id, performance_id)
  WINDOW w AS (PARTITION BY piece_id, performance_id ORDER BY beat)),
b AS (SELECT *, last_value(y IGNORE NULLS) OVER u AS y0, last_value(oi IGNORE NULLS) OVER u AS i0,
  first_value(y IGNORE NULLS) OVER v AS y1, first_value(oi IGNORE NULLS) OVER v AS i1 FROM i
  WINDOW u AS (PARTITION BY piece_id, performance_id ORDER BY beat),
  v AS (PARTITION BY piece_id, performance_id ORDER BY beat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT piece_id, performance_id, beat, coalesce(CASE WHEN i1 > i0 THEN y0 + (y1 - y0) * (i - i0)
  / (i1 - i0) END, y0, y1) AS f FROM b)
SELECT piece_id, performance_id, beat, round(f - avg(f) OVER (PARTITION BY piece_id, performance_id), 9)
  AS centred FROM f"""))
def curve_qc_filled(spark, sf):
    """Curves after quality control, missing beats filled from their neighbours, then centred."""
    q = C.curve_qc(_gappy(spark, sf), "piece_id", "performance_id", "beat", "y", miss_pos=0.12,
                   miss_perf=0.12).select("piece_id", "performance_id", "beat", "y")
    f = C.filled_curves(q, "piece_id", "performance_id", "beat", "y", 4096)
    return f.select("piece_id", "performance_id", "beat", F.round("filled_centred", 9).alias("centred"))
