"""Leave-one-performer-out prediction of curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.operators import prediction as PR
from ritardo.plans.registry import query
from ritardo.plans.standins import curves, sql, table


def _predicted(spark, sf):
    e = table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return PR.conditional_prediction(e, "label", "vec_id", "embedding", 64, 3)


@query("performer_mean_prediction", """
WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
c AS (SELECT label, vec_id, list_transform(range(1, 65), lambda i: x[i] - CASE WHEN i <= 32
  THEN list_avg(x[1:32]) ELSE 0 END) AS x FROM e),
u AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(x) AS x FROM c),
s AS (SELECT label, i, count(*) AS n, sum(x) AS s, sum(x * x) AS ss FROM u GROUP BY 1, 2),
h AS (SELECT u.*, i > 32 AS ch, n - 1 AS n, (s - x) / (n - 1) AS m,
  ss - x * x - (s - x) * (s - x) / (n - 1) AS v FROM u JOIN s USING (label, i)),
sc AS (SELECT label, vec_id, ch, sqrt(avg(v) / max(n)) AS sd, max(n) AS n FROM h GROUP BY 1, 2, 3),
y AS (SELECT label, vec_id, i, ch, (i - 1) % 32 < 16 AS known, (x - m) / sd AS y, sc.n
  FROM h JOIN sc USING (label, vec_id, ch)),
l AS (SELECT label, vec_id, ch, avg(y) AS lv FROM y WHERE known GROUP BY 1, 2, 3)
SELECT label, vec_id, round(CASE WHEN max(n) >= 2 THEN sum((y - lv) * (y - lv)) / sum(y * y) END, 6)
  AS err_mean FROM y JOIN l USING (label, vec_id, ch) WHERE NOT known GROUP BY 1, 2""")
def performer_mean_prediction(spark, sf):
    """Second halves of each performer's curves, predicted by the mean deviation of the first."""
    return _predicted(spark, sf).select("label", "vec_id", F.round("err_mean", 6).alias("err_mean"))


@query("conditional_prediction")
def conditional_prediction(spark, sf):
    """Share of the second halves that the others' first three components predict, by piece."""
    p = _predicted(spark, sf)
    return p.groupBy("label").agg(
        F.count("err_basis").alias("performers"), (1 - F.avg("err_mean")).alias("r2_mean"),
        (1 - F.avg("err_basis")).alias("r2_basis"))


@query("expected_expert_r2", sql("curves", """
, p AS (SELECT piece_id, beat, avg(x) AS m, var_samp(x) AS s2, count(x) AS n FROM curves GROUP BY 1, 2
  HAVING count(x) >= 2),
a AS (SELECT piece_id, var_pop(m) * count(*) AS ss, sum(s2) AS s, sum(s2 / n) AS noise FROM p GROUP BY 1)
SELECT piece_id, k AS experts, round(CASE WHEN ss > 0 THEN 1 - (s / k + noise) / ss END, 6) AS r2
FROM a, (SELECT unnest([1, 5, 10]) AS k)"""))
def expected_expert_r2(spark, sf):
    """Expected share of each piece's mean curve that means of 1, 5 and 10 new experts explain."""
    r = PR.expected_r2(curves(spark, sf), "piece_id", "beat", "x", (1, 5, 10))
    return r.select("piece_id", "experts", F.round("r2", 6).alias("r2"))
