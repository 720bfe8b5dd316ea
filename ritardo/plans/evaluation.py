"""Metrics, raters, folds and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.functions import stats as S
from ritardo.functions.draws import uniform, uniform_sql
from ritardo.operators import agreement as A
from ritardo.operators import consensus as C
from ritardo.operators import resampling as R
from ritardo.operators import tables as T
from ritardo.plans.consensus import rnd
from ritardo.plans.registry import query
from ritardo.plans.standins import curves, notes, ratings, score, sql, table, takes

P = ["performance_id"]


@query("ratings_matrix", sql("ratings", """
SELECT segment_id, round(avg(value) FILTER (dimension = 'click'), 9) AS click,
  round(avg(value) FILTER (dimension = 'error'), 9) AS error, round(avg(value) FILTER (dimension = 'purchase'), 9) AS purchase,
  round(avg(value) FILTER (dimension = 'signup'), 9) AS signup, round(avg(value) FILTER (dimension = 'view'), 9) AS view
FROM ratings GROUP BY 1"""))
def ratings_matrix(spark, sf):
    dims = ["click", "error", "purchase", "signup", "view"]
    return rnd(T.ratings_matrix(ratings(spark, sf), ["segment_id"], "dimension", "value", dims), 9, *dims)


@query("loo_rater_means", sql("ratings", """
, p AS (SELECT segment_id, dimension, rater_id, avg(value) AS v FROM ratings GROUP BY 1, 2, 3)
SELECT segment_id, dimension, rater_id, count(*) OVER w - 1 AS n_others,
  round(CASE WHEN count(*) OVER w > 1 THEN (sum(v) OVER w - v) / (count(*) OVER w - 1) END, 9) AS loo_mean
FROM p WINDOW w AS (PARTITION BY segment_id, dimension)"""))
def loo_rater_means(spark, sf):
    p = ratings(spark, sf).groupBy("segment_id", "dimension", "rater_id").agg(
        F.avg("value").alias("v"))
    return rnd(C.loo_mean(p, ["segment_id", "dimension"], "v").drop("v"), 9, "loo_mean")


MODEL = """, p AS (SELECT segment_id, dimension, rater_id, avg(value) AS v FROM ratings GROUP BY 1, 2, 3),
m AS (SELECT *, CAST(segment_id * 37 % 101 AS DOUBLE) AS model FROM p)"""


@query("rater_parity", sql("ratings", MODEL + """
, l AS (SELECT *, (sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0) AS loo FROM m
  WINDOW w AS (PARTITION BY dimension, segment_id))
SELECT dimension, rater_id, count(*) AS n_segments,
  CASE WHEN count(*) >= 10 THEN round(corr(loo, v), 6) END AS r_rater,
  CASE WHEN count(*) >= 10 THEN round(corr(loo, model), 6) END AS r_model
FROM l WHERE loo IS NOT NULL GROUP BY 1, 2"""))
def rater_parity(spark, sf):
    return rnd(_parity(spark, sf), 6, "r_rater", "r_model")


def _parity(spark, sf):
    p = ratings(spark, sf).groupBy("segment_id", "dimension", "rater_id").agg(
        F.avg("value").alias("v")).withColumn(
        "model", (F.col("segment_id") * 37 % 101).cast("double"))
    return A.rater_parity(p, ["dimension"], "rater_id", "segment_id", "v", "model")


@query("rater_parity_summary", sql("ratings", MODEL + """
, l AS (SELECT *, (sum(v) OVER w - v) / nullif(count(*) OVER w - 1, 0) AS loo FROM m
  WINDOW w AS (PARTITION BY dimension, segment_id)),
r AS (SELECT dimension, rater_id, corr(loo, v) AS rr, corr(loo, model) AS rm FROM l WHERE loo IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT dimension, count(*) AS n_raters, round(tanh(avg(atanh(rr))), 6) AS rater_r,
  round(tanh(avg(atanh(rm))), 6) AS model_r, round(avg(rm - rr), 6) AS diff_mean,
  round(avg((rm > rr)::INT), 6) AS share_beaten FROM r GROUP BY 1"""))
def rater_parity_summary(spark, sf):
    p = _parity(spark, sf).where("r_rater is not null and r_model is not null")
    return p.groupBy("dimension").agg(
        F.count("*").alias("n_raters"), F.round(S.fisher_mean(F.col("r_rater")), 6).alias("rater_r"),
        F.round(S.fisher_mean(F.col("r_model")), 6).alias("model_r"),
        F.round(F.avg(F.col("r_model") - F.col("r_rater")), 6).alias("diff_mean"),
        F.round(F.avg((F.col("r_model") > F.col("r_rater")).cast("int")), 6).alias("share_beaten"))


@query("prediction_metrics", sql("notes", """
SELECT event_type, count(*) AS n,
  round(1 - sum((value - k) * (value - k)) / (var_pop(value) * count(*)), 6) AS r2,
  round(corr(value, k), 9) AS pearson,
  round(2 * covar_pop(value, k) / (var_pop(value) + var_pop(k) + (avg(value) - avg(k)) * (avg(value) - avg(k))), 9) AS ccc,
  round(regr_slope(k, value), 9) AS slope
FROM notes GROUP BY 1"""))
def prediction_metrics(spark, sf):
    t, p = F.col("value"), F.col("k").cast("double")
    return notes(spark, sf).groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(S.r2(t, p), 6).alias("r2"),
        F.round(S.pearson(t, p), 9).alias("pearson"), F.round(S.concordance(t, p), 9).alias("ccc"),
        F.round(F.regr_slope(p, t), 9).alias("slope"))


@query("spearman_by_type", sql("notes", """
, r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value)
    + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS rp
  FROM notes)
SELECT event_type, count(*) AS n, round(corr(rt, rp), 9) AS spearman FROM r GROUP BY 1"""))
def spearman_by_type(spark, sf):
    return rnd(A.spearman(notes(spark, sf), ["event_type"], "value", "k"), 9, "spearman")


PAIR = """
, d AS (SELECT performance_id AS g, note_id AS id, velocity // 20 AS t, k // 10 AS p FROM notes),
c AS (SELECT a.g, sign(a.t - b.t) AS st, sign(a.p - b.p) AS sp FROM d a JOIN d b ON a.g = b.g AND a.id < b.id)"""


@query("kendall_by_performance", sql("notes", PAIR + """
, n AS (SELECT g, count(*) FILTER (st * sp > 0) AS cc, count(*) FILTER (st * sp < 0) AS dd,
  count(*) FILTER (st = 0 AND sp <> 0) AS tt, count(*) FILTER (sp = 0 AND st <> 0) AS tp FROM c GROUP BY 1)
SELECT g AS performance_id, cc AS concordant, dd AS discordant,
  round((cc - dd) / sqrt((cc + dd + tt) * (cc + dd + tp)), 9) AS tau_b FROM n"""))
def kendall_by_performance(spark, sf):
    c = A.pair_counts(_pairs(spark, sf), P, "t", "p")
    return c.select("performance_id", "concordant", "discordant", F.round(
        A.kendall_tau_b(c), 9).alias("tau_b"))


def _pairs(spark, sf):
    return notes(spark, sf).withColumns({"t": F.expr("velocity div 20"), "p": F.expr("k div 10")})


@query("pairwise_accuracy", sql("notes", PAIR + """
SELECT count(*) FILTER (st <> 0) AS n_pairs,
  round(sum(CASE WHEN st = 0 THEN 0 WHEN sp = 0 THEN 0.5 WHEN st = sp THEN 1 ELSE 0 END)
    / count(*) FILTER (st <> 0), 9) AS accuracy FROM c"""))
def pairwise_accuracy(spark, sf):
    return rnd(A.pairwise_accuracy(A.pair_counts(_pairs(spark, sf), P, "t", "p"), []), 9,
               "accuracy")


@query("within_group_scores", sql("notes", """
, c AS (SELECT event_type, performance_id, value - avg(value) OVER w AS t, k - avg(k) OVER w AS p, count(*) OVER w AS n
  FROM notes WINDOW w AS (PARTITION BY event_type, performance_id))
SELECT event_type, round(1 - sum((t - p) * (t - p)) / (var_pop(t) * count(*)), 6) AS within_r2
FROM c WHERE n >= 2 GROUP BY 1"""))
def within_group_scores(spark, sf):
    k = ["event_type", "performance_id"]
    n = notes(spark, sf).withColumn("k", F.col("k").cast("double"))
    big = n.groupBy(*k).agg(F.count("*").alias("__n")).where("__n >= 2")
    d = C.center(C.center(n.join(big, k, "left_semi"), k, "value", "t"), k, "k", "p")
    return d.groupBy("event_type").agg(F.round(S.r2(F.col("t"), F.col("p")), 6).alias("within_r2"))


@query("within_spearman", sql("notes", """
, r AS (SELECT event_type, performance_id, rank() OVER (PARTITION BY event_type, performance_id ORDER BY value)
    + (count(*) OVER (PARTITION BY event_type, performance_id, value) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY event_type, performance_id ORDER BY k)
    + (count(*) OVER (PARTITION BY event_type, performance_id, k) - 1) / 2.0 AS rp FROM notes),
g AS (SELECT event_type, performance_id, corr(rt, rp) AS s FROM r GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT event_type, count(s) AS n_groups, round(avg(s), 9) AS mean_spearman FROM g GROUP BY 1"""))
def within_spearman(spark, sf):
    s = A.spearman(notes(spark, sf), ["event_type", "performance_id"], "value", "k")
    return s.where("n >= 3").groupBy("event_type").agg(
        F.count("spearman").alias("n_groups"), F.round(F.avg("spearman"), 9).alias("mean_spearman"))


@query("auc_by_source", """
WITH d AS (SELECT source, l.quality AS y, CAST(n_chars % 97 AS DOUBLE) AS s FROM documents JOIN labels l USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS r FROM d),
a AS (SELECT source, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, sum(r) FILTER (y = 1) AS sr
  FROM r GROUP BY 1)
SELECT source, n_pos, n_neg, CASE WHEN n_pos > 0 AND n_neg > 0
  THEN round((sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9) END AS auc FROM a""")
def auc_by_source(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "source", "quality", (F.col("n_chars") % 97).cast("double").alias("s"))
    return rnd(A.auc(d, ["source"], "quality", "s"), 9, "auc")


@query("leakage_report", sql("takes", """
, used AS (SELECT performance_id, performer_id AS work FROM takes WHERE tier <= 3),
held AS (SELECT DISTINCT performer_id AS work FROM takes WHERE year >= 2000 AND tier = 1)
SELECT (SELECT count(*) FROM used WHERE performance_id NOT IN (SELECT doc_id FROM documents)) AS n_unknown,
  (SELECT count(*) FROM used WHERE performance_id IN (SELECT doc_id FROM labels)) AS n_held_out_ids,
  (SELECT count(DISTINCT work) FROM used WHERE work IN (SELECT work FROM held)) AS n_held_out_works"""))
def leakage_report(spark, sf):
    from ritardo.operators.agreement import leakage

    t = takes(spark, sf)
    used = t.where("tier <= 3").select(F.col("performance_id").alias("id"), F.col(
        "performer_id").alias("work"))
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    works = t.where("year >= 2000 and tier = 1").select(F.col("performer_id").alias("work"))
    return leakage(used, known, held, works)


@query("cronbach_alpha", """
WITH w AS (SELECT l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c FROM lineitem)
SELECT count(*) AS n, round(3 / 2.0 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 9) AS alpha,
  round((abs(corr(a, b)) + abs(corr(a, c)) + abs(corr(b, c))) / 3, 9) AS mean_abs_r FROM w""")
def cronbach_alpha(spark, sf):
    w = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"),
        (F.col("l_tax") * 100).alias("c"))
    return rnd(A.scale_reliability(w, ["a", "b", "c"]), 9, "alpha", "mean_abs_r")


@query("velocity_agreement", sql("notes", """
, f AS (SELECT event_type, regr_slope(value, velocity) AS b, regr_intercept(value, velocity) AS a FROM notes GROUP BY 1),
e AS (SELECT n.event_type, value - a - b * velocity AS r FROM notes n JOIN f USING (event_type)),
m AS (SELECT event_type, median(r) AS med FROM e GROUP BY 1),
s AS (SELECT event_type, 1.4826 * median(abs(r - med)) AS rsd FROM e JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, round(b, 9) AS slope, round(rsd, 9) AS resid_rsd FROM f JOIN s USING (event_type)"""))
def velocity_agreement(spark, sf):
    n = notes(spark, sf).withColumn("velocity", F.col("velocity").cast("double"))
    return rnd(A.velocity_agreement(n, ["event_type"], "velocity", "value"), 9, "slope",
               "resid_rsd")


@query("composer_rollup", sql("takes", """
SELECT coalesce(CAST(tier AS VARCHAR), 'ALL') AS tier, count(*) AS n, round(avg(price), 4) AS mean_f1,
  round(median(price), 4) AS median_f1, round(2 * sum(price) / (sum(price) + sum(year)), 9) AS pooled
FROM takes GROUP BY ROLLUP(tier)"""))
def composer_rollup(spark, sf):
    t = takes(spark, sf).withColumn("tier", F.col("tier").cast("string"))
    return rnd(rnd(A.rollup_summary(t, "tier", "price", "price", "year"), 4, "mean_f1",
                   "median_f1"), 9, "pooled")


@query("rule_mismatch", sql("score", """
, n AS (SELECT score_id, voice, count(*) FILTER (staff = 1) AS n1, count(*) FILTER (staff = 2) AS n2 FROM score GROUP BY 1, 2),
h AS (SELECT s.*, CASE WHEN n1 > n2 THEN 'R' WHEN n2 > n1 THEN 'L' WHEN staff = 1 THEN 'R' ELSE 'L' END AS rule,
  CASE WHEN pitch >= 60 THEN 'R' ELSE 'L' END AS hand FROM score s JOIN n USING (score_id, voice)),
e AS (SELECT score_id, onset_uq, count(DISTINCT staff) AS ns, bool_or(rule <> hand) AS affected FROM h GROUP BY 1, 2)
SELECT h.score_id, round(avg((rule <> hand)::INT), 9) AS mismatch, any_value(ev.n) AS n_events,
  any_value(ev.a) AS n_affected FROM h JOIN (SELECT score_id, count(*) AS n, count(*) FILTER (affected) AS a
  FROM e WHERE ns = 2 GROUP BY 1) ev USING (score_id) GROUP BY 1"""))
def rule_mismatch(spark, sf):
    from ritardo.functions.keys import pitch_split_hand
    from ritardo.operators.hands import event_mismatch, voice_hand

    s = voice_hand(score(spark, sf), ["score_id"], "rule").withColumn(
        "hand", pitch_split_hand(F.col("pitch")))
    ev = event_mismatch(s, ["score_id", "onset_uq"], "rule", "hand").groupBy("score_id").agg(
        F.count("*").alias("n_events"), F.count(F.when(F.col("affected"), 1)).alias("n_affected"))
    m = s.groupBy("score_id").agg(F.round(F.avg(
        (F.col("rule") != F.col("hand")).cast("int")), 9).alias("mismatch"))
    return m.join(ev, "score_id")


# ------------------------------------------------------------------ folds and resampling

@query("group_folds", sql("takes", """
, g AS (SELECT performer_id, count(*) AS n FROM takes GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, """ + uniform_sql(7, "performer_id") + """, performer_id) AS i FROM g),
w AS (
  WITH RECURSIVE walk AS (
    SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, NULL::BIGINT AS performer_id, NULL::BIGINT AS n_rows, NULL::BIGINT AS fold
    UNION ALL
    SELECT i, list_transform(load, lambda x, j: CASE WHEN j = f THEN x + n ELSE x END), pid, n, f - 1
    FROM (SELECT o.i, w.load, o.performer_id AS pid, o.n, list_position(w.load, list_min(w.load)) AS f
      FROM walk w JOIN o ON o.i = w.i + 1))
  SELECT performer_id, n_rows, fold FROM walk WHERE fold IS NOT NULL)
SELECT * FROM w"""))
def group_folds(spark, sf):
    return R.group_fold_ids(takes(spark, sf), "performer_id", 5, seed=7)


@query("work_split", sql("takes", """
, w AS (SELECT DISTINCT performer_id AS work FROM takes),
f AS (SELECT performer_id AS work, CASE WHEN min(year) < 1993 THEN 'test' ELSE 'val' END AS side FROM takes
  GROUP BY 1 HAVING sum(price) > 4500000),
fr AS (SELECT work, row_number() OVER (ORDER BY """ + uniform_sql(3, "work") + """, work) AS r, count(*) OVER () AS n
  FROM w WHERE work NOT IN (SELECT work FROM f))
SELECT w.work, coalesce(f.side, CASE WHEN fr.r <= round(0.1 * fr.n) THEN 'val' END, 'train') AS split
FROM w LEFT JOIN f USING (work) LEFT JOIN fr USING (work)"""))
def work_split(spark, sf):
    t = takes(spark, sf).withColumnRenamed("performer_id", "work")
    forced = t.groupBy("work").agg(F.min("year").alias("y"), F.sum("price").alias("p")).where(
        "p > 4500000").select("work", F.when(F.col("y") < 1993, "test").otherwise("val").alias(
            "side"))
    return R.assign_split(t, "work", forced, 0.1, seed=3)


BOOT = """, g AS (SELECT performance_id, sum(value) AS num, count(*) AS den, sum(k) AS sk FROM notes GROUP BY 1),
ix AS (SELECT *, row_number() OVER (ORDER BY """ + uniform_sql(0, "performance_id") + """, performance_id) - 1 AS idx,
  count(*) OVER () AS kk FROM g),
b AS (SELECT unnest(range(200)) AS b),
d AS (SELECT b.b, CAST(floor(""" + uniform_sql(11, "b.b", "ix.idx") + """ * kk) AS BIGINT) AS idx FROM b CROSS JOIN ix)"""


@query("cluster_bootstrap", sql("notes", BOOT + """
, r AS (SELECT d.b, sum(num) / sum(den) AS m1, sum(num) / sum(den) - sum(sk) / sum(den) AS m2
  FROM d JOIN ix USING (idx) GROUP BY 1)
SELECT 'mean_value' AS metric, round((SELECT sum(num) / sum(den) FROM g), 6) AS estimate,
  round(quantile_cont(m1, 0.025), 6) AS low, round(quantile_cont(m1, 0.975), 6) AS high, 0::BIGINT AS n_failed FROM r
UNION ALL SELECT 'paired_diff', round((SELECT (sum(num) - sum(sk)) / sum(den) FROM g), 6),
  round(quantile_cont(m2, 0.025), 6), round(quantile_cont(m2, 0.975), 6), 0 FROM r"""))
def cluster_bootstrap(spark, sf):
    g = notes(spark, sf).groupBy("performance_id").agg(
        F.sum("value").alias("num"), F.count("*").alias("den"), F.sum("k").alias("sk"))
    out = R.bootstrap_ci(g, "performance_id", ["num", "den", "sk"], {
        "mean_value": F.col("num") / F.col("den"),
        "paired_diff": (F.col("num") - F.col("sk")) / F.col("den")}, n_boot=200, seed=11)
    return rnd(out, 6, "estimate", "low", "high")


@query("two_way_bootstrap", sql("notes", """
, c AS (SELECT performance_id, event_type, sum(value) AS num, count(*) AS den FROM notes GROUP BY 1, 2),
a0 AS (SELECT DISTINCT performance_id FROM c),
a AS (SELECT *, row_number() OVER (ORDER BY """ + uniform_sql(0, "performance_id") + """, performance_id) - 1 AS idx, count(*) OVER () AS kk FROM a0),
e0 AS (SELECT DISTINCT event_type FROM c),
e AS (SELECT *, row_number() OVER (ORDER BY """ + uniform_sql(0, "event_type") + """, event_type) - 1 AS idx, count(*) OVER () AS kk FROM e0),
b AS (SELECT unnest(range(100)) AS b),
da AS (SELECT b.b, CAST(floor(""" + uniform_sql(5, "b.b", "a.idx") + """ * kk) AS BIGINT) AS idx FROM b CROSS JOIN a),
de AS (SELECT b.b, CAST(floor(""" + uniform_sql(6, "b.b", "e.idx") + """ * kk) AS BIGINT) AS idx FROM b CROSS JOIN e),
wa AS (SELECT b, performance_id, count(*) AS w FROM da JOIN a USING (idx) GROUP BY 1, 2),
we AS (SELECT b, event_type, count(*) AS w FROM de JOIN e USING (idx) GROUP BY 1, 2),
r AS (SELECT wa.b, sum(wa.w * we.w * num) / sum(wa.w * we.w * den) AS v FROM c JOIN wa USING (performance_id)
  JOIN we ON we.b = wa.b AND we.event_type = c.event_type GROUP BY 1)
SELECT (SELECT round(sum(num) / sum(den), 6) FROM c) AS estimate, round(quantile_cont(v, 0.025), 6) AS low,
  round(quantile_cont(v, 0.975), 6) AS high FROM r"""))
def two_way_bootstrap(spark, sf):
    n = notes(spark, sf).withColumn("one", F.lit(1))
    out = R.two_way_bootstrap(n, "performance_id", "event_type", "value", "one", n_boot=100,
                              seed=5)
    return rnd(out, 6, "estimate", "low", "high")


@query("linked_groups", """
WITH c AS (SELECT c_custkey, c_nationkey, c_custkey % 5 <> 0 AS linked FROM customer),
o AS (SELECT *, CASE WHEN lag(linked) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) THEN 0 ELSE 1 END AS st FROM c),
i AS (SELECT *, sum(st) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS isl FROM o),
g AS (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey, isl) AS component,
  count(*) OVER (PARTITION BY c_nationkey, isl) AS n FROM i)
SELECT c_custkey AS node, component FROM g WHERE n > 1""")
def linked_groups(spark, sf):
    from ritardo.operators.ordered import chunk_of, scan

    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    c = scan(c, ["c_nationkey"], ["c_custkey"], chunk_of("c_custkey", 4096),
             nxt=("lead", "c_custkey"))
    # every customer is linked to the next of the nation, but for each fifth; all rows are nodes
    links = c.withColumn("nxt", F.when(F.col("c_custkey") % 5 != 0, F.col("nxt")))
    return R.connected_components(links, "c_custkey", "nxt")


@query("split_half_reliability", sql("ratings", """
, p AS (SELECT segment_id, rater_id, avg(value) AS v FROM ratings GROUP BY 1, 2),
d AS (SELECT p.*, t.draw FROM p CROSS JOIN (SELECT unnest(range(5)) AS draw) t),
r AS (SELECT *, row_number() OVER (PARTITION BY draw, segment_id ORDER BY """ + uniform_sql(
    9, "draw", "segment_id", "rater_id") + """, rater_id) AS r, count(*) OVER (PARTITION BY draw, segment_id) AS n FROM d),
h AS (SELECT draw, segment_id, avg(v) FILTER (r <= n / 2) AS a, avg(v) FILTER (r > n / 2) AS b FROM r GROUP BY 1, 2),
c AS (SELECT draw, corr(a, b) AS r FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT round(avg(r), 9) AS mean_r, round(2 * avg(r) / (1 + avg(r)), 9) AS reliability FROM c"""))
def split_half_reliability(spark, sf):
    return rnd(R.split_half(ratings(spark, sf), "segment_id", "rater_id", "value", 5, 9), 9,
               "mean_r", "reliability")


@query("expert_draw", sql("takes", """
SELECT tier, year, performance_id, row_number() OVER (PARTITION BY tier, year ORDER BY """ + uniform_sql(
    4, "performance_id") + """, performance_id) AS draw FROM takes
WHERE status <> 'P' AND performance_id NOT IN (SELECT doc_id FROM labels)
QUALIFY draw <= 15"""))
def expert_draw(spark, sf):
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("performance_id"))
    t = takes(spark, sf).where("status <> 'P'").join(held, "performance_id", "left_anti")
    return R.sample_per_group(t, ["tier", "year"], "performance_id", 15, 4).select(
        "tier", "year", "performance_id", "draw")


@query("stratified_selection", sql("takes", """
, e AS (SELECT *, count(DISTINCT tier) OVER (PARTITION BY performer_id) AS nl FROM takes WHERE price > 50000)
SELECT tier, status, performance_id FROM e WHERE nl >= 2
QUALIFY row_number() OVER (PARTITION BY tier, status ORDER BY """ + uniform_sql(8, "performance_id") + """, performance_id) <= 20"""))
def stratified_selection(spark, sf):
    t = takes(spark, sf).where("price > 50000")
    shared = t.groupBy("performer_id").agg(F.countDistinct("tier").alias("nl")).where("nl >= 2")
    t = t.join(shared, "performer_id", "left_semi")
    return R.sample_per_group(t, ["tier", "status"], "performance_id", 20, 8).select(
        "tier", "status", "performance_id")


@query("pair_schedule", sql("takes", """
, p AS (SELECT a.performance_id AS a, b.performance_id AS b, a.performer_id AS passage FROM takes a
  JOIN takes b ON a.performer_id = b.performer_id AND b.performance_id = (
    SELECT min(c.performance_id) FROM takes c WHERE c.performer_id = a.performer_id AND c.performance_id > a.performance_id))
SELECT passage, a, b, CAST(r % 20 AS BIGINT) AS listener FROM (
  SELECT *, row_number() OVER (ORDER BY """ + uniform_sql(2, "a") + """, a) - 1 AS r FROM p)"""))
def pair_schedule(spark, sf):
    from ritardo.operators.ordered import chunk_of, scan

    t = takes(spark, sf)
    p = scan(t, ["performer_id"], ["performance_id"], chunk_of("performance_id", 65536),
             b=("lead", "performance_id")).where("b is not null")
    r = R.hash_order(p, [], 2, "performance_id", "r")
    return r.select(F.col("performer_id").alias("passage"), F.col("performance_id").alias("a"),
                    "b", ((F.col("r") - 1) % 20).cast("bigint").alias("listener"))


@query("fixed_effects_slopes", sql("takes", """
, d AS (SELECT price - avg(price) OVER w AS y, year - avg(year) OVER w AS x1, tier - avg(tier) OVER w AS x2
  FROM takes WINDOW w AS (PARTITION BY performer_id)),
s AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS p, sum(x2 * y) AS q FROM d)
SELECT round((c * p - b * q) / (a * c - b * b), 4) AS beta_year, round((a * q - b * p) / (a * c - b * b), 4) AS beta_tier FROM s"""))
def fixed_effects_slopes(spark, sf):
    from ritardo.operators.models import fixed_effects

    return rnd(fixed_effects(takes(spark, sf), "performer_id", "price", "year", "tier").select(
        F.col("beta_1").alias("beta_year"), F.col("beta_2").alias("beta_tier")), 4, "beta_year",
        "beta_tier")


@query("pairwise_strengths")
def pairwise_strengths(spark, sf):
    from ritardo.operators.models import bradley_terry
    from ritardo.operators.ordered import chunk_of, scan

    n = scan(notes(spark, sf), P, ["onset_us", "note_id"], chunk_of("onset_us", 8_000_000),
             __t=("prev", "event_type"), __v=("prev", "value"))
    n = n.where("__t is not null and __t <> event_type and __v <> value")
    win = F.col("value") > F.col("__v")
    comps = n.select(
        F.when(win, F.col("event_type")).otherwise(F.col("__t")).alias("winner"),
        F.when(win, F.col("__t")).otherwise(F.col("event_type")).alias("loser"))
    return rnd(bradley_terry(comps, "winner", "loser"), 6, "strength")


@query("split_half_curves", sql("curves", """
, h AS (SELECT piece_id, beat, avg(x) FILTER (u < 0.5) AS a, avg(x) FILTER (u >= 0.5) AS b FROM (
  SELECT *, """ + uniform_sql(1, "performance_id") + """ AS u FROM curves) GROUP BY 1, 2)
SELECT piece_id, round(corr(a, b), 9) AS r, round(2 * corr(a, b) / (1 + corr(a, b)), 9) AS reliability FROM h GROUP BY 1"""))
def split_half_curves(spark, sf):
    c = curves(spark, sf).withColumn("u", uniform(1, F.col("performance_id")))
    h = c.groupBy("piece_id", "beat").agg(
        F.avg(F.when(F.col("u") < 0.5, F.col("x"))).alias("a"),
        F.avg(F.when(F.col("u") >= 0.5, F.col("x"))).alias("b"))
    r = F.corr("a", "b")
    return rnd(h.groupBy("piece_id").agg(r.alias("r"), (2 * r / (1 + r)).alias("reliability")), 9,
               "r", "reliability")


@query("icc_intervals", sql("ratings", """
, s AS (SELECT dimension, rater_id % 3 AS take, segment_id % 3 AS obs, avg(value) AS v FROM ratings GROUP BY 1, 2, 3),
r AS (SELECT *, avg(v) OVER (PARTITION BY dimension, obs) AS rm, avg(v) OVER (PARTITION BY dimension, take) AS cm,
  avg(v) OVER (PARTITION BY dimension) AS gm FROM s),
a AS (SELECT dimension, sum((rm - gm) * (rm - gm)) / 2 AS msr, sum((v - rm - cm + gm) * (v - rm - cm + gm)) / 4 AS mse FROM r GROUP BY 1),
f AS (SELECT dimension, msr / mse / (2 * (pow(0.025, -0.5) - 1)) AS lo, msr / mse * 39.24842 AS hi FROM a)
SELECT dimension, round((lo - 1) / (lo + 2), 5) AS icc_low, round((hi - 1) / (hi + 2), 5) AS icc_high FROM f"""))
def icc_intervals(spark, sf):
    """Three observations and takes: F with 2 and 4 degrees of freedom has a closed form, its
    reverse (4 and 2) the tabled 39.24842."""
    from ritardo.operators.consensus import icc_interval, variance_components

    s = ratings(spark, sf).groupBy("dimension", (F.col("rater_id") % 3).alias("take"), (
        F.col("segment_id") % 3).alias("obs")).agg(F.avg("value").alias("v"))
    v = icc_interval(variance_components(s, ["dimension"], "obs", "take", "v"))
    return rnd(v.select("dimension", "icc_low", "icc_high"), 5, "icc_low", "icc_high")


@query("t_intervals", sql("ratings", """
, s AS (SELECT dimension, rater_id % 3 AS part, avg(value) AS v FROM ratings GROUP BY 1, 2),
a AS (SELECT dimension, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM s GROUP BY 1)
SELECT dimension, n, round(mean, 6) AS mean, round(mean - 0.95 / sqrt(2 * 0.975 * 0.025) * sd / sqrt(n), 6) AS low,
  round(mean + 0.95 / sqrt(2 * 0.975 * 0.025) * sd / sqrt(n), 6) AS high FROM a"""))
def t_intervals(spark, sf):
    """Three parts: the quantile with 2 degrees of freedom has a closed form."""
    s = ratings(spark, sf).groupBy("dimension", (F.col("rater_id") % 3).alias("part")).agg(
        F.avg("value").alias("v"))
    return rnd(R.t_interval(s, ["dimension"], "v"), 6, "mean", "low", "high")
