"""Expression of matched notes, alignment scores, bar error tables, pedal depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.operators import expression as X
from ritardo.operators import sequences as S
from ritardo.plans.consensus import rnd
from ritardo.plans.registry import query
from ritardo.plans.standins import NOTE_CHUNK, SCORE_CHUNK, notes, score, sql

P, SC = ["performance_id"], ["score_id"]

# the written side: onsets on a grid of 0.4 s, so that chords arise; a tenth of the pairs name a
# neighbour's note
MATCHED = """
, s AS (SELECT performance_id, note_id AS s_id, onset_us // 400000 * 400000 AS onset_uq, duration_us * 2 AS duration_uq, pitch FROM notes),
pl AS (SELECT performance_id, note_id AS p_id, onset_us, duration_us AS played_us, velocity FROM notes),
j AS (SELECT s.*, pl.p_id, pl.onset_us, pl.played_us, pl.velocity FROM notes n JOIN s ON s.performance_id = n.performance_id AND s.s_id = n.note_id
  JOIN pl ON pl.performance_id = n.performance_id AND pl.p_id = n.note_id - CASE WHEN n.note_id % 10 = 0 THEN 1 ELSE 0 END WHERE n.label = 'match'),
m AS (SELECT * EXCLUDE (a, b) FROM (SELECT *, row_number() OVER (PARTITION BY performance_id, onset_uq, pitch ORDER BY s_id, p_id) AS a,
  row_number() OVER (PARTITION BY performance_id, p_id ORDER BY onset_uq, pitch, s_id) AS b FROM j) WHERE a = 1 AND b = 1)"""


def _matched(spark, sf):
    n = notes(spark, sf)
    s = n.select("performance_id", F.col("note_id").alias("s_id"), F.expr(
        "onset_us div 400000 * 400000").alias("onset_uq"), (F.col("duration_us") * 2).alias(
            "duration_uq"), "pitch")
    p = n.select("performance_id", F.col("note_id").alias("p_id"), "onset_us", F.col(
        "duration_us").alias("played_us"), "velocity")
    other = F.when(F.col("note_id") % 10 == 0, 1).otherwise(0)
    pairs = n.where("label = 'match'").select("performance_id", F.col("note_id").alias("s_id"), (
        F.col("note_id") - other).alias("p_id"))
    return X.matched_pairs(s, p, pairs, P)


@query("matched_pairs", sql("notes", MATCHED + """
SELECT performance_id, s_id, p_id, onset_uq, pitch, onset_us, velocity FROM m"""))
def matched_pairs(spark, sf):
    return _matched(spark, sf).select(
        "performance_id", "s_id", "p_id", "onset_uq", "pitch", "onset_us", "velocity")


EXPRESSION = MATCHED + """
, c AS (SELECT performance_id, onset_uq, avg(onset_us) AS t FROM m GROUP BY 1, 2),
sl AS (SELECT performance_id, regr_slope(t, onset_uq::DOUBLE) AS us_per_uq FROM c GROUP BY 1),
st AS (SELECT *, (lead(t) OVER w - t) / ((lead(onset_uq) OVER w - onset_uq) * us_per_uq) AS ratio FROM c JOIN sl USING (performance_id)
  WINDOW w AS (PARTITION BY performance_id ORDER BY onset_uq)),
x AS (SELECT m.*, CASE WHEN ratio > 0 THEN ln(ratio) END AS log_ioi, CASE WHEN duration_uq >= 62500 AND played_us > 0
  AND played_us / (duration_uq * us_per_uq) > 0 THEN ln(played_us / (duration_uq * us_per_uq)) END AS log_art
  FROM m JOIN st USING (performance_id, onset_uq))"""


@query("note_expression", sql("notes", EXPRESSION + """
SELECT performance_id, s_id, p_id, round(log_ioi, 6) AS log_ioi, round(log_art, 6) AS log_art FROM x"""))
def note_expression(spark, sf):
    x = X.note_expression(_matched(spark, sf), P, NOTE_CHUNK)
    return rnd(x.select("performance_id", "s_id", "p_id", "log_ioi", "log_art"), 6, "log_ioi", "log_art")


@query("onset_curves", sql("notes", EXPRESSION + """
SELECT performance_id, onset_uq, round(avg(velocity), 6) AS velocity, round(avg(log_ioi), 6) AS log_ioi FROM x GROUP BY 1, 2"""))
def onset_curves(spark, sf):
    x = X.note_expression(_matched(spark, sf), P, NOTE_CHUNK)
    return rnd(X.onset_curves(x, P), 6, "velocity", "log_ioi")


LABELS = """
, al AS (SELECT performance_id, note_id AS s_id, note_id AS p_id, CASE WHEN label IN ('match', 'interpolated') THEN 'match' ELSE label END AS label FROM notes),
pr AS (SELECT performance_id, s_id, CASE WHEN s_id % 9 = 0 THEN p_id + 1 ELSE p_id END AS p_id, CASE WHEN s_id % 13 = 0 THEN 'deletion' ELSE label END AS label FROM al),
ks AS (SELECT DISTINCT performance_id FROM notes)"""


def _prf_sql(label: str, cols: str) -> str:
    a = f"(SELECT DISTINCT performance_id, {cols} FROM pr WHERE label = '{label}')"
    b = f"(SELECT DISTINCT performance_id, {cols} FROM al WHERE label = '{label}')"
    return f""", {label}_c AS (SELECT performance_id, (SELECT count(*) FROM {a} a WHERE a.performance_id = ks.performance_id) AS np,
  (SELECT count(*) FROM {b} b WHERE b.performance_id = ks.performance_id) AS nt,
  (SELECT count(*) FROM (SELECT * FROM {a} INTERSECT SELECT * FROM {b}) c WHERE c.performance_id = ks.performance_id) AS nc FROM ks),
{label}_p AS (SELECT performance_id, CASE WHEN np > 0 THEN nc / np WHEN nt = 0 THEN 1 ELSE 0 END AS {label}_precision,
  CASE WHEN nt > 0 THEN nc / nt WHEN np = 0 THEN 1 ELSE 0 END AS {label}_recall,
  CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN nc = 0 THEN 0 ELSE 2 * nc / (np + nt) END AS {label}_f1 FROM {label}_c)"""


def _accuracy_sql(name: str, note: str, other: str, lone: str) -> str:
    def side(t: str) -> str:
        return (f"(SELECT performance_id, {note} AS n, CASE WHEN count(*) = count(CASE WHEN label = 'match' THEN {other} END) "
                f"THEN max(CASE WHEN label = 'match' THEN {other} END) END AS x FROM {t} WHERE label IN ('match', '{lone}') GROUP BY 1, 2)")
    return f""", {name}_a AS (SELECT t.performance_id, avg(CASE WHEN p.n IS NOT NULL AND t.x IS NOT DISTINCT FROM p.x THEN 1.0 ELSE 0.0 END) AS {name}_accuracy
  FROM {side('al')} t LEFT JOIN {side('pr')} p ON p.performance_id = t.performance_id AND p.n = t.n GROUP BY 1)"""


_SHOWN = [f"{a}_{b}" for a in ("match", "insertion", "deletion") for b in ("precision", "recall", "f1")]


@query("alignment_scores", sql("notes", LABELS + _prf_sql("match", "s_id, p_id") + _prf_sql("insertion", "p_id")
                               + _prf_sql("deletion", "s_id") + _accuracy_sql("played", "p_id", "s_id", "insertion")
                               + _accuracy_sql("written", "s_id", "p_id", "deletion") + """
SELECT performance_id, """ + ", ".join(f"round({c}, 9) AS {c}" for c in _SHOWN) + """,
  round(coalesce(played_accuracy, 1), 9) AS played_accuracy, round(coalesce(written_accuracy, 1), 9) AS written_accuracy
FROM ks JOIN match_p USING (performance_id) JOIN insertion_p USING (performance_id) JOIN deletion_p USING (performance_id)
  LEFT JOIN played_a USING (performance_id) LEFT JOIN written_a USING (performance_id)"""))
def alignment_scores(spark, sf):
    true = notes(spark, sf).select(
        "performance_id", F.col("note_id").alias("s_id"), F.col("note_id").alias("p_id"), F.when(
            F.col("label") == "interpolated", "match").otherwise(F.col("label")).alias("label"))
    pred = true.select(
        "performance_id", "s_id", F.when(F.col("s_id") % 9 == 0, F.col("p_id") + 1).otherwise(
            F.col("p_id")).alias("p_id"),
        F.when(F.col("s_id") % 13 == 0, "deletion").otherwise(F.col("label")).alias("label"))
    return rnd(X.alignment_scores(pred, true, P), 9, *_SHOWN, "played_accuracy", "written_accuracy")


@query("bar_error_table", sql("score", """
, f AS (SELECT score_id, pitch, onset_uq, min(onset_uq / 100.0) AS t FROM score GROUP BY 1, 2, 3),
p AS (SELECT *, lag(t) OVER (PARTITION BY score_id, pitch ORDER BY onset_uq) AS pt FROM f),
n AS (SELECT s.score_id, s.measure_idx, coalesce(s.onset_uq / 100.0 - p.pt < 600000, false) AS fr,
  CASE quantity % 5 WHEN 0 THEN 'missed' WHEN 1 THEN 'wrong_pitch' WHEN 2 THEN 'extra' ELSE 'correct' END AS label
  FROM score s JOIN p USING (score_id, pitch, onset_uq)),
b AS (SELECT score_id, unnest(range(max(measure_idx) + 1)) AS measure_idx FROM score GROUP BY 1)
SELECT b.score_id, b.measure_idx, CASE WHEN b.measure_idx < 40 THEN b.measure_idx::VARCHAR ELSE (b.measure_idx - 40)::VARCHAR || ' (2)' END AS printed,
  count(*) FILTER (label IN ('correct', 'wrong_pitch', 'missed')) AS n_score_notes, count(*) FILTER (label = 'wrong_pitch') AS n_wrong_pitch,
  count(*) FILTER (label = 'missed') AS n_missed, count(*) FILTER (label = 'extra') AS n_extra, count(*) FILTER (label = 'missed' AND fr) AS n_missed_fast_repeat
FROM b LEFT JOIN n USING (score_id, measure_idx) GROUP BY ALL"""))
def bar_error_table(spark, sf):
    from ritardo.functions.keys import pass_label

    s = score(spark, sf).withColumn("expected_us", F.col("onset_uq") / 100.0)
    n = S.fast_repeats(s, SC, "expected_us", 600_000, SCORE_CHUNK).withColumn("label", F.expr(
        "case quantity % 5 when 0 then 'missed' when 1 then 'wrong_pitch' when 2 then 'extra' else 'correct' end"))
    b = s.groupBy("score_id").agg(F.max("measure_idx").alias("m")).select("score_id", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("measure_idx"))
    second = F.col("measure_idx") >= 40
    b = b.withColumn("printed", pass_label(F.when(second, F.col("measure_idx") - 40).otherwise(
        F.col("measure_idx")).cast("string"), F.when(second, 2).otherwise(1)))
    return X.bar_error_table(b, n, SC)


@query("pedal_depth", sql("notes", """
, e AS (SELECT performance_id, onset_us AS t, max(velocity) AS v FROM notes WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
h AS (SELECT *, lead(t) OVER (PARTITION BY performance_id ORDER BY t) AS nx FROM e),
sp AS (SELECT performance_id, min(onset_us) AS s, max(onset_us + duration_us) AS z FROM notes GROUP BY 1)
SELECT performance_id, round(coalesce(sum(greatest(least(coalesce(nx, z), z) - greatest(t, s), 0) * v), 0) / (any_value(z - s) * 127), 9) AS depth_mean
FROM sp LEFT JOIN h USING (performance_id) GROUP BY 1"""))
def pedal_depth(spark, sf):
    n = notes(spark, sf)
    spans = n.groupBy("performance_id").agg(F.min("onset_us").alias("start_us"), F.max(
        F.col("onset_us") + F.col("duration_us")).alias("end_us"))
    e = n.where("event_type in ('view', 'click')").groupBy("performance_id", F.col(
        "onset_us").alias("time_us")).agg(F.max("velocity").alias("pedal_value"))
    return rnd(X.pedal_depth(e, spans, P, NOTE_CHUNK).select("performance_id", "depth_mean"), 9, "depth_mean")


ONSETS = """
, s0 AS (SELECT performance_id, note_id // 2 * 2 AS s_id, onset_us AS onset_uq, k % 10 = 0 AS is_grace FROM notes WHERE label <> 'insertion'),
p0 AS (SELECT performance_id, note_id // 3 * 3 AS p_id, onset_us, pitch, velocity FROM notes WHERE label <> 'deletion'),
pr AS (SELECT performance_id, note_id // 2 * 2 AS s_id, note_id // 3 * 3 AS p_id, label FROM notes),
s1 AS (SELECT performance_id, s_id, min((onset_uq, is_grace)) AS s FROM s0 GROUP BY 1, 2),
p1 AS (SELECT performance_id, p_id, min((onset_us, pitch, velocity)) AS p FROM p0 GROUP BY 1, 2),
j AS (SELECT pr.*, s[1] AS onset_uq, s[2] AS is_grace, p[1] AS onset_us, p[2] AS pitch, p[3] AS velocity, s IS NOT NULL AND p IS NOT NULL AS ok
  FROM pr LEFT JOIN s1 USING (performance_id, s_id) LEFT JOIN p1 USING (performance_id, p_id) WHERE label = 'match')"""


def _onsets(spark, sf):
    n = notes(spark, sf)
    sid, pid = F.expr("note_id div 2 * 2").alias("s_id"), F.expr("note_id div 3 * 3").alias("p_id")
    s = n.where("label <> 'insertion'").select("performance_id", sid, F.col("onset_us").alias(
        "onset_uq"), (F.col("k") % 10 == 0).alias("is_grace"))
    p = n.where("label <> 'deletion'").select("performance_id", pid, "onset_us", "pitch", "velocity")
    return X.matched_onsets(s, p, n.select("performance_id", sid, pid, "label"), P)


@query("matched_onsets", sql("notes", ONSETS + """
SELECT performance_id, s_id, p_id, onset_uq, onset_us, pitch, velocity FROM j WHERE ok AND NOT is_grace"""))
def matched_onsets(spark, sf):
    return _onsets(spark, sf)[0]


@query("matched_onset_counts", sql("notes", ONSETS + """
, c AS (SELECT performance_id, count(*) FILTER (label = 'match') AS n_match, count(*) FILTER (label = 'interpolated') AS n_interpolated_skipped,
  count(*) FILTER (label = 'insertion') AS n_insertion, count(*) FILTER (label = 'deletion') AS n_deletion FROM pr GROUP BY 1),
o AS (SELECT performance_id, count(*) FILTER (NOT ok) AS n_missing_ids_skipped, count(*) FILTER (ok AND is_grace) AS n_grace_skipped FROM j GROUP BY 1),
a AS (SELECT performance_id, count(*) AS n_score_notes FROM s0 GROUP BY 1), b AS (SELECT performance_id, count(*) AS n_perf_notes FROM p0 GROUP BY 1)
SELECT performance_id, n_match, n_interpolated_skipped, n_insertion, n_deletion, coalesce(n_missing_ids_skipped, 0) AS n_missing_ids_skipped,
  coalesce(n_grace_skipped, 0) AS n_grace_skipped, coalesce(n_score_notes, 0) AS n_score_notes, coalesce(n_perf_notes, 0) AS n_perf_notes
FROM c LEFT JOIN o USING (performance_id) LEFT JOIN a USING (performance_id) LEFT JOIN b USING (performance_id)"""))
def matched_onset_counts(spark, sf):
    return _onsets(spark, sf)[1]


@query("steady_edge_time_map", sql("notes", """
, k AS (SELECT performance_id, onset_us // 500000 * 1000000 AS kp, max(onset_us)::DOUBLE AS kv FROM notes GROUP BY 1, 2),
g AS (SELECT *, (lead(kv) OVER w - kv) / (lead(kp) OVER w - kp) AS slope FROM k WINDOW w AS (PARTITION BY performance_id ORDER BY kp)),
r AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY kp) AS a, row_number() OVER (PARTITION BY performance_id ORDER BY kp DESC) AS z
  FROM g WHERE slope IS NOT NULL),
e AS (SELECT performance_id, median(slope) FILTER (a <= 5) AS lo_s, median(slope) FILTER (z <= 5) AS hi_s FROM r GROUP BY 1),
m AS (SELECT performance_id, min(kp) AS lo, max(kp) AS hi, arg_min(kv, kp) AS lov, arg_max(kv, kp) AS hiv FROM k GROUP BY 1),
pt AS (SELECT performance_id, note_id, 3 * onset_us - 9000000 AS pos FROM notes),
h AS (SELECT pt.*, g.kp, g.kv, g.slope FROM pt ASOF LEFT JOIN g ON pt.performance_id = g.performance_id AND pt.pos >= g.kp)
SELECT performance_id, note_id, round(CASE WHEN pos < lo THEN lov + (pos - lo) * coalesce(lo_s, 0) WHEN pos > hi THEN hiv + (pos - hi) * coalesce(hi_s, 0)
  ELSE kv + (pos - kp) * coalesce(slope, 0) END, 0) AS expected_us FROM h JOIN m USING (performance_id) LEFT JOIN e USING (performance_id)"""))
def steady_edge_time_map(spark, sf):
    n = notes(spark, sf)
    k = n.groupBy("performance_id", F.expr("onset_us div 500000 * 1000000").alias("kp")).agg(
        F.max("onset_us").cast("double").alias("kv"))
    pts = n.select("performance_id", "note_id", (F.col("onset_us") * 3 - 9_000_000).alias("pos"))
    out = X.steady_edges(pts, k, P, "pos", "kp", "kv", NOTE_CHUNK, 5, "expected_us")
    return out.select("performance_id", "note_id", F.round("expected_us", 0).alias("expected_us"))


@query("beat_table", sql("notes", """
, w AS (SELECT performance_id, onset_us // 1000000 AS beat, max(onset_us) FILTER (event_type = 'view') AS a, max(onset_us) FILTER (event_type = 'click') AS b,
  max(velocity) FILTER (event_type = 'view' AND k > 20) AS la FROM notes GROUP BY 1, 2)
SELECT performance_id, beat, 'pid7-view' AS recording, a AS time, la AS loudness, 7 AS performer FROM w WHERE a IS NOT NULL
UNION ALL SELECT performance_id, beat, 'pid12b-click', b, NULL, 12 FROM w WHERE b IS NOT NULL"""))
def beat_table(spark, sf):
    from ritardo.sources.readers import beat_table as table_of

    def cell(cond: str, col: str, name: str):
        return F.max(F.when(F.expr(cond), F.col(col))).alias(name)

    n = notes(spark, sf).groupBy("performance_id", F.expr("onset_us div 1000000").alias("beat"))
    t = n.agg(cell("event_type = 'view'", "onset_us", "pid7-view"),
              cell("event_type = 'click'", "onset_us", "pid12b-click"))
    v = n.agg(cell("event_type = 'view' and k > 20", "velocity", "pid7-view"))
    return table_of(t, v, ["performance_id", "beat"], ["pid7-view", "pid12b-click"])
