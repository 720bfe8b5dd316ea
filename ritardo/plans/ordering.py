"""Ordered-stream queries (sequence operators on the stand-in tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.functions.stats import geometric_mean
from ritardo.operators import sequences as S
from ritardo.operators.ordered import chunk_of, scan
from ritardo.plans.registry import query
from ritardo.plans.standins import (
    MICRO, NOTE_CHUNK, SCORE_CHUNK, bars, notes, score, sql,
)

P = ["performance_id"]
SC = ["score_id"]


@query("tempo_from_beat_times", sql("notes", """
SELECT performance_id, note_id,
  round(CASE WHEN g > 0 THEN 60e6 / g END, 6) AS tempo_bpm
FROM (SELECT *, lead(onset_us) OVER (PARTITION BY performance_id ORDER BY note_id) - onset_us AS g
      FROM notes)"""))
def tempo_from_beat_times(spark, sf):
    n = notes(spark, sf)
    t = S.tempo_from_beats(n, P, "note_id", "onset_us", 4096)
    return t.select("performance_id", "note_id", F.round("tempo_bpm", 6).alias("tempo_bpm"))


@query("performed_events", sql("notes", """
, m AS (SELECT *, CASE WHEN onset_us - lag(onset_us) OVER w > 100000 THEN 1 ELSE 0 END AS st
  FROM notes WINDOW w AS (PARTITION BY performance_id ORDER BY onset_us, note_id)),
e AS (SELECT *, 1 + sum(st) OVER (PARTITION BY performance_id ORDER BY onset_us, note_id) AS event
  FROM m)
SELECT performance_id, CAST(event AS BIGINT) AS event, min(onset_us) AS onset_us,
  count(*) AS n_notes,
  coalesce(bit_or(CASE WHEN pitch < 64 THEN 1::BIGINT << (pitch % 64)::INT END), 0) AS lo,
  coalesce(bit_or(CASE WHEN pitch >= 64 THEN 1::BIGINT << (pitch % 64)::INT END), 0) AS hi
FROM e GROUP BY 1, 2"""))
def performed_events(spark, sf):
    return S.performed_events(notes(spark, sf), P, 100_000, NOTE_CHUNK)


@query("score_events", sql("score", """
SELECT score_id, onset_uq, count(*) AS n_notes,
  coalesce(bit_or(CASE WHEN pitch = 63 THEN (-9223372036854775808)::BIGINT WHEN pitch < 63 THEN 1::BIGINT << (pitch % 64)::INT END), 0) AS lo,
  coalesce(bit_or(CASE WHEN pitch = 127 THEN (-9223372036854775808)::BIGINT WHEN pitch >= 64 THEN 1::BIGINT << (pitch % 64)::INT END), 0) AS hi
FROM score GROUP BY 1, 2"""))
def score_events(spark, sf):
    return S.score_events(score(spark, sf), SC)


@query("chord_clusters", sql("notes", """
, d AS (SELECT DISTINCT performance_id, onset_us FROM notes),
o AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY onset_us) AS rn FROM d),
r AS (
  WITH RECURSIVE walk AS (
    SELECT performance_id, rn, onset_us, onset_us AS chord_us FROM o WHERE rn = 1
    UNION ALL
    SELECT o.performance_id, o.rn, o.onset_us,
      CASE WHEN o.onset_us - w.chord_us <= 400000 THEN w.chord_us ELSE o.onset_us END
    FROM walk w JOIN o ON o.performance_id = w.performance_id AND o.rn = w.rn + 1)
  SELECT * FROM walk)
SELECT performance_id, onset_us, chord_us FROM r"""))
def chord_clusters(spark, sf):
    return S.chord_clusters(notes(spark, sf), P, 400_000, NOTE_CHUNK)


@query("local_ioi", sql("notes", """
, c AS (SELECT DISTINCT performance_id, onset_us AS chord_us FROM notes),
g AS (SELECT *, lead(chord_us) OVER (PARTITION BY performance_id ORDER BY chord_us) - chord_us AS gap
  FROM c)
SELECT performance_id, chord_us, round(quantile_cont(CAST(gap AS DOUBLE), 0.5) OVER
    (PARTITION BY performance_id ORDER BY chord_us ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6)
    AS local_ioi_us FROM g"""))
def local_ioi(spark, sf):
    c = notes(spark, sf).select("performance_id", F.col("onset_us").alias("chord_us")).distinct()
    out = S.local_ioi(c, P, NOTE_CHUNK)
    return out.select("performance_id", "chord_us",
                      F.round("local_ioi_us", 6).alias("local_ioi_us"))


@query("fast_run_notes", sql("notes", """
, pl AS (SELECT * FROM notes WHERE label <> 'interpolated'),
d AS (SELECT DISTINCT performance_id, onset_us FROM pl),
o AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY onset_us) AS rn FROM d),
r AS (
  WITH RECURSIVE walk AS (
    SELECT performance_id, rn, onset_us, onset_us AS chord_us FROM o WHERE rn = 1
    UNION ALL
    SELECT o.performance_id, o.rn, o.onset_us,
      CASE WHEN o.onset_us - w.chord_us <= 30000 THEN w.chord_us ELSE o.onset_us END
    FROM walk w JOIN o ON o.performance_id = w.performance_id AND o.rn = w.rn + 1)
  SELECT * FROM walk),
c AS (SELECT DISTINCT performance_id, chord_us FROM r),
g AS (SELECT *, lead(chord_us) OVER (PARTITION BY performance_id ORDER BY chord_us) - chord_us AS gap
  FROM c),
l AS (SELECT performance_id, chord_us, quantile_cont(CAST(gap AS DOUBLE), 0.5) OVER
  (PARTITION BY performance_id ORDER BY chord_us ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS ioi
  FROM g)
SELECT n.performance_id, n.note_id, coalesce(l.ioi < 300000, false) AS fast_run
FROM notes n LEFT JOIN r ON n.label <> 'interpolated' AND r.performance_id = n.performance_id
  AND r.onset_us = n.onset_us
LEFT JOIN l ON l.performance_id = r.performance_id AND l.chord_us = r.chord_us"""))
def fast_run_notes(spark, sf):
    n = notes(spark, sf)
    played = n.where("label <> 'interpolated'")
    ch = S.chord_clusters(played, P, 30_000, NOTE_CHUNK)
    ioi = S.local_ioi(ch.select("performance_id", "chord_us").distinct(), P, NOTE_CHUNK)
    per_onset = ch.join(ioi, [*P, "chord_us"], "left").select(
        *P, "onset_us", "local_ioi_us", F.lit("played").alias("__kind"))
    key = n.withColumn("__kind", F.when(F.col("label") != "interpolated", "played"))
    return key.join(per_onset, [*P, "onset_us", "__kind"], "left").select(
        *P, "note_id",
        F.coalesce(F.col("local_ioi_us") < 300_000, F.lit(False)).alias("fast_run"))


def _matched(spark, sf):
    """Notes as matched pairs: the score position is the half-second slot of the onset."""
    return notes(spark, sf).withColumn(
        "pos_uq", F.expr("(onset_us div 500000) * 1000000"))


@query("expected_onsets", sql("notes", """
, q AS (SELECT performance_id, (onset_us // 500000) * 1000000 AS pos_uq,
  quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS med FROM notes GROUP BY 1, 2)
SELECT performance_id, pos_uq, round(med, 3) AS median_us,
  round(max(med) OVER (PARTITION BY performance_id ORDER BY pos_uq), 3) AS knot_us FROM q"""))
def expected_onsets(spark, sf):
    k = S.expected_onsets(_matched(spark, sf), P, NOTE_CHUNK)
    return k.select("performance_id", "pos_uq", F.round("median_us", 3).alias("median_us"),
                    F.round("knot_us", 3).alias("knot_us"))


@query("tempo_pairing_windows", sql("notes", """
, q AS (SELECT performance_id, (onset_us // 500000) * 1000000 AS pos_uq,
  quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS med FROM notes GROUP BY 1, 2),
k AS (SELECT performance_id, pos_uq, max(med) OVER (PARTITION BY performance_id ORDER BY pos_uq) AS kt
  FROM q),
e AS (SELECT *, first_value(pos_uq) OVER w AS q0, last_value(pos_uq) OVER w AS q1,
  first_value(kt) OVER w AS t0, last_value(kt) OVER w AS t1 FROM k
  WINDOW w AS (PARTITION BY performance_id ORDER BY pos_uq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT performance_id, pos_uq, round(CASE WHEN q1 > q0 THEN
  least(greatest(0.4 * (t1 - t0) / (q1 - q0) * 1e6, 100000.0), 300000.0) ELSE 100000.0 END, 3)
  AS window_us FROM e"""))
def tempo_pairing_windows(spark, sf):
    from ritardo.operators.correctness import tempo_windows

    k = S.expected_onsets(_matched(spark, sf), P, NOTE_CHUNK)
    w = tempo_windows(k, P, NOTE_CHUNK)
    return w.select("performance_id", "pos_uq", F.round("window_us", 3).alias("window_us"))


@query("fast_repeat_notes", sql("score", """
, f AS (SELECT score_id, pitch, onset_uq, min(onset_uq / 100.0) AS t FROM score GROUP BY 1, 2, 3),
p AS (SELECT *, lag(t) OVER (PARTITION BY score_id, pitch ORDER BY onset_uq) AS pt FROM f)
SELECT s.score_id, s.note_id, coalesce(s.onset_uq / 100.0 - p.pt < 600000, false) AS fast_repeat
FROM score s JOIN p USING (score_id, pitch, onset_uq)"""))
def fast_repeat_notes(spark, sf):
    s = score(spark, sf).withColumn("expected_us", F.col("onset_uq") / 100.0)
    out = S.fast_repeats(s, SC, "expected_us", 600_000, SCORE_CHUNK)
    return out.select("score_id", "note_id", "fast_repeat")


def _bar_counts(spark, sf):
    n = notes(spark, sf)
    return n.groupBy("performance_id", F.expr("onset_us div 500000").alias("measure_idx")).agg(
        F.sum(F.when(F.col("label") != "interpolated", 1).otherwise(0)).alias("n_notes"),
        F.sum(F.when(F.col("label").isin("deletion", "insertion"), 1).otherwise(0)).alias(
            "n_missed"),
    )


_BAR_COUNTS = """
, bc AS (SELECT performance_id, onset_us // 500000 AS measure_idx,
  count(*) FILTER (label <> 'interpolated') AS n_notes,
  count(*) FILTER (label IN ('deletion', 'insertion')) AS n_missed FROM notes GROUP BY 1, 2),
g AS (SELECT *, n_missed / n_notes >= 0.8 AS hit, n_missed / n_notes >= 0.5 AS half,
  row_number() OVER (PARTITION BY performance_id ORDER BY measure_idx) AS i FROM bc WHERE n_notes > 0),
h AS (SELECT *, i - row_number() OVER (PARTITION BY performance_id ORDER BY measure_idx) AS isl
  FROM g WHERE hit),
runs AS (SELECT performance_id, isl, min(measure_idx) AS first_bar, max(measure_idx) AS last_bar,
  min(i) AS i0, max(i) AS i1, count(*) AS n_bars FROM h GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("not_heard_runs", sql("notes", _BAR_COUNTS + """
SELECT performance_id, first_bar, last_bar, n_bars FROM runs"""))
def not_heard_runs(spark, sf):
    return S.not_heard_runs(_bar_counts(spark, sf), P, width=32)


@query("not_heard_runs_merged", sql("notes", _BAR_COUNTS + """
, lim AS (SELECT performance_id, max(i) AS n FROM g GROUP BY 1),
m AS (SELECT r.*, lag(i1) OVER w AS p1 FROM runs r
  WINDOW w AS (PARTITION BY performance_id ORDER BY i0)),
b AS (SELECT m.*, CASE WHEN p1 IS NOT NULL AND i0 - p1 - 1 <= 2 AND NOT EXISTS (
    SELECT 1 FROM g WHERE g.performance_id = m.performance_id AND g.i > m.p1 AND g.i < m.i0
      AND NOT half) THEN 0 ELSE 1 END AS st FROM m),
c AS (SELECT *, sum(st) OVER (PARTITION BY performance_id ORDER BY i0) AS grp FROM b),
d AS (SELECT performance_id, grp, min(i0) AS i0, max(i1) AS i1 FROM c GROUP BY 1, 2),
e AS (SELECT d.performance_id,
  CASE WHEN d.i0 - 1 <= 2 AND NOT EXISTS (SELECT 1 FROM g WHERE g.performance_id = d.performance_id
    AND g.i < d.i0 AND NOT half) THEN 1 ELSE d.i0 END AS i0,
  CASE WHEN lim.n - d.i1 <= 2 AND NOT EXISTS (SELECT 1 FROM g WHERE
    g.performance_id = d.performance_id AND g.i > d.i1 AND NOT half) THEN lim.n ELSE d.i1 END AS i1
  FROM d JOIN lim USING (performance_id))
SELECT e.performance_id, a.measure_idx AS first_bar, z.measure_idx AS last_bar,
  e.i1 - e.i0 + 1 AS n_bars
FROM e JOIN g a ON a.performance_id = e.performance_id AND a.i = e.i0
JOIN g z ON z.performance_id = e.performance_id AND z.i = e.i1"""))
def not_heard_runs_merged(spark, sf):
    return S.not_heard_runs(_bar_counts(spark, sf), P, merge_gap=2, width=32)


def _grid_score(spark, sf):
    """The score on a weekly grid, so that rest-free runs occur."""
    return score(spark, sf).withColumn(
        "onset_uq", F.expr("(onset_uq div 28000000) * 1000000")).withColumn(
        "duration_uq", F.expr("(1 + quantity div 40) * 1000000"))


_GRID = """
, gs AS (SELECT score_id, staff, voice, pitch, (onset_uq // 28000000) * 1000000 AS onset_uq,
  (1 + quantity // 40) * 1000000 AS duration_uq FROM score),
onset AS (SELECT score_id, staff, voice, onset_uq, min(duration_uq) AS d,
  list_sort(list(pitch)) AS ps FROM gs GROUP BY 1, 2, 3, 4),
lk AS (SELECT *, CASE WHEN onset_uq = lag(onset_uq) OVER w + lag(d) OVER w AND d = lag(d) OVER w
  THEN 0 ELSE 1 END AS st FROM onset WINDOW w AS (PARTITION BY score_id, staff, voice
  ORDER BY onset_uq)),
rn AS (SELECT *, sum(st) OVER (PARTITION BY score_id, staff, voice ORDER BY onset_uq) AS run FROM lk),
ru AS (SELECT *, min(onset_uq) OVER r AS run_start_uq, count(*) OVER r AS n_onsets,
  row_number() OVER (PARTITION BY score_id, staff, voice, run ORDER BY onset_uq) - 1 AS pos
  FROM rn WINDOW r AS (PARTITION BY score_id, staff, voice, run)
  QUALIFY n_onsets >= 3)"""


@query("even_runs", sql("score", _GRID + """
SELECT score_id, staff, voice, onset_uq, CAST(d AS BIGINT) AS duration_uq, run_start_uq, n_onsets,
  pos, array_to_string(ps, ',') AS pitches FROM ru"""))
def even_runs(spark, sf):
    r = S.even_runs(_grid_score(spark, sf), SC, SCORE_CHUNK, min_notes=3)
    return r.withColumn("pitches", F.concat_ws(",", F.col("pitches").cast("array<string>")))


@query("strict_runs", sql("score", _GRID + """
, t AS (SELECT a.score_id, a.staff, a.voice, a.run_start_uq, p.p AS period, a.pos,
    CASE WHEN p.p = 0 THEN CAST(sign(a.ps[-1] - b.ps[-1]) AS INT)
         WHEN a.ps = b.ps THEN 1 ELSE 0 END AS sig
  FROM ru a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS p) p
  JOIN ru b ON a.score_id = b.score_id AND a.staff = b.staff AND a.voice = b.voice
    AND a.run_start_uq = b.run_start_uq AND b.pos = a.pos - greatest(p.p, 1)),
i1 AS (SELECT *, CASE WHEN sig = lag(sig) OVER w THEN 0 ELSE 1 END AS st FROM t
  WINDOW w AS (PARTITION BY score_id, staff, voice, run_start_uq, period ORDER BY pos)),
i2 AS (SELECT *, sum(st) OVER (PARTITION BY score_id, staff, voice, run_start_uq, period
  ORDER BY pos) AS isl FROM i1),
sp AS (SELECT score_id, staff, voice, run_start_uq, period, min(pos) - greatest(period, 1) AS lo,
  max(pos) AS hi FROM i2 WHERE sig <> 0 GROUP BY score_id, staff, voice, run_start_uq, period, isl
  HAVING max(pos) - (min(pos) - greatest(period, 1)) + 1 >= greatest(3, 2 * period)),
cv AS (SELECT score_id, staff, voice, run_start_uq, unnest(range(lo, hi + 1)) AS pos,
  period = 0 AS mono FROM sp),
cc AS (SELECT score_id, staff, voice, run_start_uq, pos, bool_or(mono) AS m, bool_or(NOT mono) AS f
  FROM cv GROUP BY 1, 2, 3, 4, 5),
rr AS (SELECT *, pos - row_number() OVER (PARTITION BY score_id, staff, voice, run_start_uq
  ORDER BY pos) AS isl FROM cc)
SELECT score_id, staff, voice, run_start_uq, min(pos) AS first_pos, max(pos) AS last_pos,
  CASE WHEN bool_or(m) AND bool_or(f) THEN 'mixed' WHEN bool_or(m) THEN 'monotone'
  ELSE 'figure' END AS kind
FROM rr GROUP BY score_id, staff, voice, run_start_uq, isl
HAVING max(pos) - min(pos) + 1 >= 3"""))
def strict_runs(spark, sf):
    r = S.even_runs(_grid_score(spark, sf), SC, SCORE_CHUNK, min_notes=3)
    return S.strict_runs(r, SC, min_notes=3)


@query("detect_pauses", sql("notes", """
, g0 AS (SELECT performance_id, note_id AS pos, onset_us AS t,
  lead(note_id) OVER w - note_id AS db, lead(onset_us) OVER w - onset_us AS ioi,
  lead(note_id) OVER w + note_id AS mid2 FROM notes
  WINDOW w AS (PARTITION BY performance_id ORDER BY note_id)),
g AS (SELECT *, ioi / db AS rate FROM g0 WHERE db IS NOT NULL),
m AS (SELECT a.performance_id, a.pos, a.ioi, a.db,
  CASE WHEN count(b.rate) >= 2 THEN quantile_cont(b.rate, 0.5) END AS med
  FROM g a LEFT JOIN g b ON a.performance_id = b.performance_id AND a.pos <> b.pos
    AND b.mid2 BETWEEN a.mid2 - 1200 AND a.mid2 + 1200
  GROUP BY 1, 2, 3, 4)
SELECT performance_id, pos, ioi, round(med * db, 6) AS expected,
  coalesce(ioi >= 2.5 * med * db AND ioi - med * db >= 300000, false) AS pause FROM m"""))
def detect_pauses(spark, sf):
    b = notes(spark, sf).select("performance_id", F.col("note_id").alias("pos"),
                                F.col("onset_us").alias("time"))
    out = S.detect_pauses(b, P, win=600, width=4096)
    return out.withColumn("expected", F.round("expected", 6))


@query("metric_profile", sql("notes", """
, q AS (SELECT *, k % 4 AS slot FROM notes),
m AS (SELECT performance_id, slot, CASE WHEN count(*) >= 10 THEN median(value) ELSE 0 END AS profile
  FROM q GROUP BY 1, 2)
SELECT q.performance_id, q.note_id, q.slot, round(m.profile, 6) AS profile,
  round(q.value - m.profile, 6) AS jitter FROM q JOIN m USING (performance_id, slot)"""))
def metric_profile(spark, sf):
    n = notes(spark, sf).withColumn("slot", F.col("k") % 4)
    out = S.metric_profile(n, P, "slot", "value", min_count=10)
    return out.select("performance_id", "note_id", "slot", F.round("profile", 6).alias("profile"),
                      F.round("jitter", 6).alias("jitter"))


@query("bar_jitter_table", sql("notes", """
, q AS (SELECT *, k % 4 AS slot, onset_us // 2000000 AS measure_idx FROM notes),
m AS (SELECT performance_id, slot, CASE WHEN count(*) >= 3 THEN median(value) ELSE 0 END AS profile
  FROM q GROUP BY 1, 2),
j AS (SELECT q.*, q.value - m.profile AS jitter FROM q JOIN m USING (performance_id, slot))
SELECT performance_id, measure_idx, count(*) AS n, round(exp(avg(ln(value))), 6) AS geo_period,
  round(sqrt(avg(jitter * jitter)), 6) AS rms_jitter, round(max(abs(jitter)), 6) AS max_abs_jitter
FROM j GROUP BY 1, 2"""))
def bar_jitter_table(spark, sf):
    n = notes(spark, sf).withColumn("slot", F.col("k") % 4).withColumn(
        "measure_idx", F.expr("onset_us div 2000000"))
    out = S.metric_profile(n, P, "slot", "value")
    return out.groupBy("performance_id", "measure_idx").agg(
        F.count("*").alias("n"),
        F.round(geometric_mean(F.col("value")), 6).alias("geo_period"),
        F.round(F.sqrt(F.avg(F.col("jitter") * F.col("jitter"))), 6).alias("rms_jitter"),
        F.round(F.max(F.abs("jitter")), 6).alias("max_abs_jitter"),
    )


@query("steady_streams", sql("notes", """
, o AS (SELECT performance_id, onset_us, avg(velocity) AS v FROM notes GROUP BY 1, 2),
g AS (SELECT *, lead(onset_us) OVER (PARTITION BY performance_id ORDER BY onset_us) - onset_us AS ioi
  FROM o QUALIFY ioi IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY onset_us) AS i,
  quantile_cont(CAST(ioi AS DOUBLE), 0.5) OVER (PARTITION BY performance_id ORDER BY onset_us
  ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM g),
s AS (SELECT *, i - row_number() OVER (PARTITION BY performance_id ORDER BY onset_us) AS isl
  FROM m WHERE ioi / med > 0.3 AND ioi / med < 2.5)
SELECT performance_id, min(onset_us) AS start_us, count(*) AS n_iois,
  round(avg(ioi), 3) AS ioi_mean, round(stddev_samp(ioi) / avg(ioi), 6) AS ioi_cv,
  round(stddev_samp(v), 6) AS velocity_sd
FROM s GROUP BY performance_id, isl HAVING count(*) >= 6"""))
def steady_streams(spark, sf):
    out = S.steady_streams(notes(spark, sf), P, NOTE_CHUNK, lo=0.3, hi=2.5, min_len=6)
    return out.select("performance_id", "start_us", "n_iois",
                      F.round("ioi_mean", 3).alias("ioi_mean"),
                      F.round("ioi_cv", 6).alias("ioi_cv"),
                      F.round("velocity_sd", 6).alias("velocity_sd"))


@query("onset_sanity", sql("notes", """
, p AS (SELECT *, onset_us - lag(onset_us) OVER (PARTITION BY performance_id, pitch
  ORDER BY onset_us, note_id) AS gap FROM notes)
SELECT performance_id, count(*) AS n_notes,
  round(CASE WHEN max(onset_us) > min(onset_us)
    THEN count(*) / ((max(onset_us) - min(onset_us)) / 1e6) END, 6) AS notes_per_sec,
  round(count(*) FILTER (gap < 500000) / count(*), 9) AS share_double_trigger,
  round(count(*) FILTER (duration_us < 100000) / count(*), 9) AS share_short,
  round(count(*) FILTER (pitch < 45 OR pitch > 108) * 0 + count(*) FILTER (pitch < 21 OR pitch > 108)
    / count(*), 9) AS share_out_of_range,
  min(pitch) AS pitch_min, max(pitch) AS pitch_max, round(avg(velocity), 6) AS vel_mean,
  round(stddev_pop(velocity), 6) AS vel_sd
FROM p GROUP BY 1"""))
def onset_sanity(spark, sf):
    out = S.onset_sanity(notes(spark, sf), P, NOTE_CHUNK, double_us=500_000, short_us=100_000)
    r6 = ("notes_per_sec", "vel_mean", "vel_sd")
    r9 = ("share_double_trigger", "share_short", "share_out_of_range")
    for c in r6:
        out = out.withColumn(c, F.round(c, 6))
    for c in r9:
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("snap_score_durations", sql("score", """
, o AS (SELECT DISTINCT score_id, staff, voice, onset_uq FROM score),
n AS (SELECT *, lead(onset_uq) OVER (PARTITION BY score_id, staff, voice ORDER BY onset_uq)
  - onset_uq AS ioi FROM o)
SELECT s.score_id, s.note_id, CAST(CASE WHEN ioi - duration_uq > 0 AND ioi - duration_uq <= 0.3 * ioi
  THEN ioi ELSE duration_uq END AS BIGINT) AS duration_uq
FROM score s JOIN n USING (score_id, staff, voice, onset_uq)"""))
def snap_score_durations(spark, sf):
    out = S.snap_durations(score(spark, sf), SC, SCORE_CHUNK, max_gap_rel=0.3)
    return out.select("score_id", "note_id", "duration_uq")


_PEDAL = """
, ev AS (SELECT performance_id, note_id, onset_us AS t, value >= 64 AS down FROM notes),
ch AS (SELECT *, lag(down) OVER (PARTITION BY performance_id ORDER BY t, note_id) AS was FROM ev),
st AS (SELECT * FROM ch WHERE down <> coalesce(was, false)),
nx AS (SELECT *, lead(t) OVER (PARTITION BY performance_id ORDER BY t, note_id) AS up_us FROM st),
pr AS (SELECT performance_id, t AS down_us, up_us FROM nx WHERE down)"""


def _pedal(spark, sf):
    return notes(spark, sf).select(
        "performance_id", F.col("note_id").alias("event_id"),
        F.col("onset_us").alias("time_us"), "value")


@query("pedal_presses", sql("notes", _PEDAL + " SELECT * FROM pr"))
def pedal_presses(spark, sf):
    return S.pedal_presses(_pedal(spark, sf), P, NOTE_CHUNK)


@query("pedal_summary", sql("notes", _PEDAL + """
, sp AS (SELECT performance_id, min(onset_us) AS s, max(onset_us + duration_us) AS e
  FROM notes GROUP BY 1)
SELECT sp.performance_id, count(down_us) AS n_presses,
  round(coalesce(sum(greatest(0, least(coalesce(up_us, e), e) - greatest(down_us, s))), 0)
    / max(e - s), 9) AS down_fraction,
  round(median(coalesce(up_us, e) - down_us), 3) AS median_press_us
FROM sp LEFT JOIN pr USING (performance_id) GROUP BY 1"""))
def pedal_summary(spark, sf):
    n = notes(spark, sf)
    spans = n.groupBy("performance_id").agg(
        F.min("onset_us").alias("start_us"),
        F.max(F.col("onset_us") + F.col("duration_us")).alias("end_us"))
    pr = S.pedal_presses(_pedal(spark, sf), P, NOTE_CHUNK)
    out = S.pedal_summary(pr, spans, P)
    return out.select("performance_id", "n_presses",
                      F.round("down_fraction", 9).alias("down_fraction"),
                      F.round("median_press_us", 3).alias("median_press_us"))


@query("measure_rows", sql("bars", """
SELECT s.score_id, s.note_id, CASE WHEN s.onset_uq < b.end_uq THEN b.measure_idx END AS measure_idx
FROM score s ASOF LEFT JOIN bars b ON s.score_id = b.score_id AND s.onset_uq >= b.start_uq"""))
def measure_rows(spark, sf):
    s = score(spark, sf).select("score_id", "note_id", "onset_uq")
    out = S.place_in_bars(s, bars(spark, sf), SC, "onset_uq", SCORE_CHUNK)
    return out.select("score_id", "note_id", "measure_idx")


@query("interpolated_time_map", sql("notes", """
, q AS (SELECT performance_id, (onset_us // 500000) * 1000000 AS pos_uq,
  quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS med FROM notes GROUP BY 1, 2),
k AS (SELECT performance_id, pos_uq AS kp, max(med) OVER (PARTITION BY performance_id
  ORDER BY pos_uq) AS kv FROM q),
s AS (SELECT *, coalesce((lead(kv) OVER w - kv) / (lead(kp) OVER w - kp),
  (kv - lag(kv) OVER w) / (kp - lag(kp) OVER w), 0) AS slope,
  row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY performance_id ORDER BY kp)),
f AS (SELECT * FROM s WHERE rn = 1),
pt AS (SELECT performance_id, note_id, 2 * onset_us - 3000000 AS pos FROM notes)
SELECT pt.performance_id, pt.note_id, round(coalesce(s.kv + (pt.pos - s.kp) * s.slope,
  f.kv + (pt.pos - f.kp) * f.slope), 0) AS expected_us
FROM pt ASOF LEFT JOIN s ON pt.performance_id = s.performance_id AND pt.pos >= s.kp
JOIN f ON f.performance_id = pt.performance_id"""))
def interpolated_time_map(spark, sf):
    k = S.expected_onsets(_matched(spark, sf), P, NOTE_CHUNK)
    pts = notes(spark, sf).select("performance_id", "note_id",
                                  (F.col("onset_us") * 2 - 3_000_000).alias("pos"))
    out = S.interpolate(pts, k, P, "pos", "pos_uq", "knot_us", NOTE_CHUNK, "expected_us")
    return out.select("performance_id", "note_id", F.round("expected_us", 0).alias("expected_us"))


@query("bar_labels", sql("bars", """
SELECT score_id, measure_idx, CASE WHEN n = 1 THEN name ELSE concat(name, ' (', n, ')') END AS label
FROM (SELECT *, CAST(measure_idx % 12 AS VARCHAR) AS name, row_number() OVER (
  PARTITION BY score_id, measure_idx % 12 ORDER BY measure_idx) AS n FROM bars)"""))
def bar_labels(spark, sf):
    from ritardo.functions.keys import pass_label

    b = bars(spark, sf).withColumn("name", (F.col("measure_idx") % 12).cast("string"))
    b = scan(b.withColumn("__one", F.lit(1).cast("bigint")), ["score_id", "name"],
             ["measure_idx"], chunk_of("measure_idx", 4096), n=("sum", "__one"))
    return b.select("score_id", "measure_idx",
                    pass_label(F.col("name"), F.col("n")).alias("label"))


assert MICRO == 1_000_000
