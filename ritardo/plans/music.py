"""Score and performance feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.operators import music as M
from ritardo.plans.consensus import rnd
from ritardo.plans.registry import query
from ritardo.plans.standins import (
    MICRO, NOTE_CHUNK, SCORE_CHUNK, bars, curves, notes, score, sql,
)

P = ["performance_id"]
SC = ["score_id"]


@query("note_features", sql("notes", """
, c AS (SELECT performance_id, pitch, count(*) AS c FROM notes GROUP BY 1, 2),
sp AS (SELECT a.performance_id, a.pitch, ln((any_value(a.c) + 1) / (coalesce(sum(b.c), 0) / 4.0 + 1)) AS spike
  FROM c a LEFT JOIN c b ON a.performance_id = b.performance_id AND abs(a.pitch - b.pitch) IN (1, 2) GROUP BY 1, 2),
j AS (SELECT a.performance_id, a.note_id, a.pitch, a.velocity, a.duration_us, a.onset_us AS t, b.onset_us AS u, b.pitch AS q, b.velocity AS v,
  b.onset_us + b.duration_us AS off, b.note_id AS bid FROM notes a LEFT JOIN notes b ON a.performance_id = b.performance_id
  AND a.note_id <> b.note_id AND b.onset_us BETWEEN a.onset_us - 4000000 AND a.onset_us + 1000000),
g AS (SELECT performance_id, note_id, any_value(pitch) AS pitch,
  count(bid) FILTER (abs(u - t) <= 1000000) AS density, count(bid) FILTER (abs(u - t) <= 50000) AS n_chord,
  coalesce(any_value(velocity) - median(v) FILTER (abs(u - t) <= 1000000), 0) AS vel_rel_local,
  coalesce(any_value(velocity) - max(v) FILTER (abs(u - t) <= 50000), 0) AS vel_rel_chord,
  coalesce(bool_or((pitch - q) IN (12, 19, 24, 28, 31, 34, 36)) FILTER (abs(u - t) <= 50000), false) AS harm_onset,
  coalesce(bool_or((pitch - q) IN (12, 19, 24, 28, 31, 34, 36)) FILTER (u <= t + 50000 AND off >= t - 50000), false) AS harm_sounding,
  any_value(pitch) - max(q) FILTER (abs(u - t) <= 500000) AS gap_above,
  min(abs(pitch - q)) FILTER (abs(u - t) <= 500000) AS gap_nearest FROM j GROUP BY 1, 2),
s AS (SELECT note_id, onset_us - lag(onset_us) OVER (PARTITION BY performance_id, pitch ORDER BY onset_us, note_id) AS dt FROM notes)
SELECT g.performance_id, g.note_id, density, n_chord, round(vel_rel_local, 3) AS vel_rel_local, vel_rel_chord, harm_onset, harm_sounding,
  gap_above, gap_nearest, round(CASE WHEN dt IS NULL THEN ln(10.0) ELSE ln(least(10.0, dt / 1e6) + 1e-3) END, 9) AS same_pitch_dt,
  round(spike, 9) AS pitch_spike FROM g JOIN s USING (note_id) JOIN sp ON sp.performance_id = g.performance_id AND sp.pitch = g.pitch"""))
def note_features(spark, sf):
    f = M.note_features(notes(spark, sf), P, width=NOTE_CHUNK)
    f = f.select("performance_id", "note_id", "density", "n_chord", "vel_rel_local",
                 "vel_rel_chord", "harm_onset", "harm_sounding", "gap_above", "gap_nearest",
                 "same_pitch_dt", "pitch_spike")
    return rnd(rnd(f, 9, "same_pitch_dt", "pitch_spike"), 3, "vel_rel_local")


@query("spurious_notes", sql("notes", """
, c AS (SELECT performance_id, pitch, count(*) AS c FROM notes GROUP BY 1, 2),
sp AS (SELECT a.performance_id, a.pitch, ln((any_value(a.c) + 1) / (coalesce(sum(b.c), 0) / 4.0 + 1)) AS spike
  FROM c a LEFT JOIN c b ON a.performance_id = b.performance_id AND abs(a.pitch - b.pitch) IN (1, 2) GROUP BY 1, 2)
SELECT n.performance_id, n.note_id FROM notes n JOIN sp USING (performance_id, pitch)
WHERE n.pitch >= 50 AND spike >= 0.1 AND ln(n.duration_us / 1e6 + 1e-3) < ln(0.6 + 1e-3)
  AND NOT EXISTS (SELECT 1 FROM notes b WHERE b.performance_id = n.performance_id AND b.note_id <> n.note_id
    AND (n.pitch - b.pitch) IN (12, 19, 24, 28, 31, 34, 36) AND b.onset_us BETWEEN n.onset_us - 4000000 AND n.onset_us + 50000
    AND (b.onset_us + b.duration_us >= n.onset_us - 50000))"""))
def spurious_notes(spark, sf):
    f = M.note_features(notes(spark, sf), P, width=NOTE_CHUNK)
    rule = M.spurious_rule(min_pitch=50, min_spike=0.1, max_dur=0.6)
    return f.where(rule).select("performance_id", "note_id")


HARMONY = """
, w AS (SELECT score_id, unnest(range(onset_uq // 4000000, (onset_uq + duration_uq - 1) // 4000000 + 1)) AS w,
  onset_uq, onset_uq + duration_uq AS off, pitch FROM score),
o AS (SELECT *, least(off, (w + 1) * 4000000) - greatest(onset_uq, w * 4000000) AS ov FROM w),
pc AS (SELECT score_id, w, pitch % 12 AS pc, sum(ov) AS wt, min(pitch) AS low,
  min(onset_uq) FILTER (onset_uq >= w * 4000000) AS f FROM o GROUP BY 1, 2, 3),
t AS (SELECT score_id, w, sum(wt) AS tot, min(low) % 12 AS bass, min(f) AS first_onset FROM pc GROUP BY 1, 2),
hw AS (SELECT score_id, w, bit_or(CASE WHEN wt / tot >= 0.15 OR pc = bass THEN 1::BIGINT << pc::INT ELSE 0 END) AS pcs,
  any_value(bass) AS bass, any_value(first_onset) AS first_onset FROM pc JOIN t USING (score_id, w) GROUP BY 1, 2)"""


@query("harmony_windows", sql("score", HARMONY + """
SELECT score_id, w, pcs, bass, first_onset FROM hw"""))
def harmony_windows(spark, sf):
    return M.harmony_windows(score(spark, sf), SC, 4 * MICRO)


_MASKS = ",".join(str(m) for m in M.chord_masks("functional"))


@query("harmony_changes", sql("score", HARMONY + f"""
, p AS (SELECT *, lag(bass) OVER x AS prev_bass, lag(pcs) OVER x AS pp FROM hw
  WINDOW x AS (PARTITION BY score_id ORDER BY w))
SELECT score_id, w, first_onset, bass, prev_bass, pcs FROM p WHERE prev_bass IS NOT NULL AND bass <> prev_bass
  AND first_onset IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM (SELECT unnest([{_MASKS}]) AS m) WHERE ((pcs | pp) & ~m) = 0)"""))
def harmony_changes(spark, sf):
    return M.harmony_changes(M.harmony_windows(score(spark, sf), SC, 4 * MICRO), SC)


@query("pedal_blur", sql("notes", """
, c AS (SELECT performance_id, note_id, onset_us AS t, 500000 + k * 10000 AS per,
  lead(onset_us) OVER (PARTITION BY performance_id ORDER BY onset_us) AS nx FROM notes WHERE event_type = 'click'),
e AS (SELECT performance_id, onset_us AS t, note_id, value >= 64 AS down FROM notes WHERE event_type <> 'click'),
l AS (SELECT performance_id, t FROM e WHERE NOT down),
a AS (SELECT *, CAST(trunc(t - 0.25 * per) AS BIGINT) AS a0, CAST(trunc(t + 0.5 * per) AS BIGINT) AS a1 FROM c),
d AS (SELECT a.*, e.down FROM a ASOF LEFT JOIN e ON a.performance_id = e.performance_id AND a.a0 >= e.t),
u AS (SELECT d.*, l.t AS up FROM d ASOF LEFT JOIN l ON d.performance_id = l.performance_id AND d.a0 < l.t)
SELECT performance_id, t AS time_us, coalesce(down, false) AND (up IS NULL OR up > a1) AS blurred,
  round(CASE WHEN coalesce(down, false) AND (up IS NULL OR up > a1)
    THEN (least(coalesce(up, 4611686018427387904), coalesce(nx, 4611686018427387904), t + 4 * per) - t) / per ELSE 0 END, 9) AS blur_beats FROM u"""))
def pedal_blur(spark, sf):
    n = notes(spark, sf)
    ch = n.where("event_type = 'click'").select(
        "performance_id", F.col("onset_us").alias("time_us"),
        (F.lit(500_000) + F.col("k") * 10_000).alias("period_us"))
    ped = n.where("event_type <> 'click'").select(
        "performance_id", F.col("onset_us").alias("time_us"), F.col("note_id").alias("event_id"),
        "value")
    return rnd(M.pedal_blur(ch, ped, P, NOTE_CHUNK), 9, "blur_beats").drop("period_us")


def _played_score(spark, sf):
    """Score notes with a played onset and loudness."""
    return score(spark, sf).withColumns({
        "onset_sec": F.col("onset_uq") / 1e6 * 0.5 + F.col("discount"),
        "velocity": F.col("quantity").cast("double")})


PLAYED = """, pl AS (SELECT *, onset_uq / 1e6 * 0.5 + discount AS onset_sec, CAST(quantity AS DOUBLE) AS velocity FROM score)"""
SYNC = PLAYED + """
, o AS (SELECT score_id, onset_uq, 1000 * (avg(onset_sec) FILTER (staff = 1) - avg(onset_sec) FILTER (staff = 2)) AS a,
  avg(velocity) FILTER (staff = 1) - avg(velocity) FILTER (staff = 2) AS dv FROM pl GROUP BY 1, 2),
g AS (SELECT * FROM o WHERE a IS NOT NULL AND dv IS NOT NULL),
m AS (SELECT score_id, median(a) AS med FROM g GROUP BY 1),
s AS (SELECT score_id, any_value(med) AS med, 1.4826 * median(abs(a - med)) AS sd FROM g JOIN m USING (score_id) GROUP BY 1),
i AS (SELECT g.* FROM g JOIN s USING (score_id) WHERE sd <= 0 OR abs(a - med) <= 3 * greatest(sd, 1e-9)),
f AS (SELECT score_id, CASE WHEN count(*) >= 3 AND max(dv) > min(dv) THEN regr_slope(a, dv) ELSE 0 END AS b,
  CASE WHEN count(*) >= 3 AND max(dv) > min(dv) THEN regr_intercept(a, dv) ELSE avg(a) END AS c FROM i GROUP BY 1),
r AS (SELECT g.*, a - c - b * dv AS res, b FROM g JOIN f USING (score_id))"""


@query("hand_synchrony", sql("score", SYNC + """
SELECT score_id, onset_uq, round(a, 6) AS async_ms, round(dv, 6) AS dv, round(res, 6) AS resid_ms FROM r"""))
def hand_synchrony(spark, sf):
    h = M.hand_synchrony(_played_score(spark, sf), SC)
    return rnd(h.select("score_id", "onset_uq", "async_ms", "dv", "resid_ms"), 6, "async_ms", "dv",
               "resid_ms")


@query("synchrony_summary", sql("score", SYNC + """
, rm AS (SELECT score_id, median(res) AS rmed FROM r GROUP BY 1),
rs AS (SELECT score_id, 1.4826 * median(abs(res - rmed)) AS rsd FROM r JOIN rm USING (score_id) GROUP BY 1)
SELECT r.score_id, count(*) AS n_onsets, round(avg(a), 6) AS mean_ms, round(any_value(s.med), 6) AS median_ms,
  round(any_value(s.sd), 6) AS sd_ms, round(any_value(b), 6) AS vel_slope_ms, round(any_value(rsd), 6) AS resid_sd_ms,
  count(*) FILTER (abs(dv) <= 5) AS n_equal, round(avg(a) FILTER (abs(dv) <= 5), 6) AS equal_mean_ms
FROM r JOIN s USING (score_id) JOIN rs USING (score_id) GROUP BY 1"""))
def synchrony_summary(spark, sf):
    h = M.hand_synchrony(_played_score(spark, sf), SC)
    return rnd(M.synchrony_summary(h, SC), 6, "mean_ms", "median_ms", "sd_ms", "vel_slope_ms",
               "resid_sd_ms", "equal_mean_ms")


@query("onset_table", sql("score", """
, o AS (SELECT score_id, onset_uq, max(pitch) AS top, min(pitch) AS bass, count(*) AS n_notes,
  max(onset_uq + duration_uq) AS max_end FROM score GROUP BY 1, 2),
h AS (SELECT o.score_id, o.onset_uq, max(s.pitch) AS held FROM o JOIN score s ON s.score_id = o.score_id
  AND s.onset_uq < o.onset_uq AND s.onset_uq + s.duration_uq > o.onset_uq GROUP BY 1, 2)
SELECT o.*, coalesce(held, -1) AS held, top >= coalesce(held, -1) AS melody_new,
  greatest(top, coalesce(held, -1)) AS melody_pitch FROM o LEFT JOIN h USING (score_id, onset_uq)"""))
def onset_table(spark, sf):
    return M.onset_table(score(spark, sf), SC, 8 * MICRO)


VOICED = PLAYED + """
, m AS (SELECT score_id, onset_uq, max_by(note_id, (pitch, note_id)) AS mid FROM pl GROUP BY 1, 2),
t AS (SELECT m.*, pl.pitch AS mp, pl.velocity AS mv, pl.onset_sec AS ms FROM m JOIN pl ON pl.score_id = m.score_id AND pl.note_id = m.mid)
, v AS (SELECT pl.score_id, pl.onset_uq, any_value(mid) AS melody_id, count(*) AS n_accomp, any_value(mv) - avg(velocity) AS vel_diff,
  1000 * (avg(onset_sec) - any_value(ms)) AS lead_ms
FROM pl JOIN t ON t.score_id = pl.score_id AND t.onset_uq = pl.onset_uq AND pl.pitch < mp GROUP BY 1, 2)"""


@query("voicing_bars", sql("score", VOICED + """
SELECT score_id, onset_uq // 28000000 AS bar, count(*) AS n, round(avg(vel_diff), 6) AS vel_diff, round(avg(lead_ms), 6) AS lead_ms
FROM v GROUP BY 1, 2"""))
def voicing_bars(spark, sf):
    v = M.voicing(_played_score(spark, sf), SC).withColumn("bar", F.expr("onset_uq div 28000000"))
    return rnd(M.voicing_bars(v, SC, "bar"), 6, "vel_diff", "lead_ms")


@query("voicing_summary", sql("score", VOICED + """
SELECT score_id, count(*) AS n_onsets, round(avg(vel_diff), 6) AS vel_diff_mean, round(avg(CASE WHEN vel_diff > 0 THEN 1.0 ELSE 0.0 END), 6) AS share_louder,
  round(avg(lead_ms), 6) AS lead_mean_ms, round(corr(lead_ms, vel_diff), 6) AS lead_vel_corr, round(median(vel_diff), 6) AS vel_diff_median,
  round(median(lead_ms), 6) AS lead_median_ms FROM v GROUP BY 1"""))
def voicing_summary(spark, sf):
    s = M.voicing_summary(M.voicing(_played_score(spark, sf), SC), SC)
    return rnd(s, 6, "vel_diff_mean", "share_louder", "lead_mean_ms", "lead_vel_corr",
               "vel_diff_median", "lead_median_ms")


@query("legato_overlap", sql("score", PLAYED + """
, m AS (SELECT score_id, onset_uq, arg_max(duration_uq, (pitch, note_id)) AS d, arg_max(onset_sec, (pitch, note_id)) AS t,
  arg_max(onset_sec + quantity / 40.0, (pitch, note_id)) AS z FROM pl GROUP BY 1, 2),
n AS (SELECT *, lead(onset_uq) OVER w AS nq, lead(t) OVER w AS ns FROM m WINDOW w AS (PARTITION BY score_id ORDER BY onset_uq))
SELECT score_id, round(CASE WHEN count(*) >= 3 THEN avg(CASE WHEN abs(onset_uq + d - nq) <= 1 THEN CASE WHEN z > ns THEN 1.0 ELSE 0.0 END END) END, 9) AS legato_overlap
FROM n GROUP BY 1"""))
def legato_overlap(spark, sf):
    s = _played_score(spark, sf).withColumn("release_sec", F.col("onset_sec") + F.col("quantity") / 40.0)
    return rnd(M.legato_overlap(s, SC, SCORE_CHUNK), 9, "legato_overlap")


@query("chord_spread", sql("score", PLAYED + """
, c AS (SELECT score_id, onset_uq, 1000 * (max(onset_sec) - min(onset_sec)) AS s, count(*) AS n FROM pl GROUP BY 1, 2)
SELECT score_id, round(median(s), 6) AS chord_spread_ms FROM c WHERE n >= 2 GROUP BY 1"""))
def chord_spread(spark, sf):
    return rnd(M.chord_spread(_played_score(spark, sf), SC), 6, "chord_spread_ms")


@query("voicing", sql("score", VOICED + """
SELECT score_id, onset_uq, melody_id, n_accomp, round(vel_diff, 6) AS vel_diff, round(lead_ms, 6) AS lead_ms FROM v"""))
def voicing(spark, sf):
    return rnd(M.voicing(_played_score(spark, sf), SC), 6, "vel_diff", "lead_ms")


ARCS = """
, st AS (SELECT DISTINCT piece_id, performance_id, beat // 8 * 8 + performance_id % 3 AS start FROM curves),
p AS (SELECT c.*, s.start FROM curves c ASOF JOIN st s ON c.piece_id = s.piece_id AND c.performance_id = s.performance_id AND c.beat >= s.start),
u AS (SELECT *, 2.0 * (beat - min(beat) OVER w) / greatest(max(beat) OVER w - min(beat) OVER w, 1e-9) - 1 AS u, count(*) OVER w AS n
  FROM p WINDOW w AS (PARTITION BY performance_id, start)),
f AS (SELECT piece_id, performance_id, start, any_value(n) AS n, regr_slope(x, u) AS b, regr_intercept(x, u) AS a,
  regr_slope(u * u, u) AS bq, regr_intercept(u * u, u) AS aq FROM u GROUP BY 1, 2, 3),
e AS (SELECT u.piece_id, u.performance_id, u.start, x, x - a - b * u AS ey, u * u - aq - bq * u AS eq, f.n, a, b, aq, bq FROM u
  JOIN f ON f.performance_id = u.performance_id AND f.start = u.start),
r AS (SELECT piece_id, performance_id, start, any_value(n) AS n, CASE WHEN any_value(n) >= 3 THEN sum(ey * eq) / sum(eq * eq) END AS c2,
  any_value(a) AS a, any_value(b) AS b, any_value(aq) AS aq, any_value(bq) AS bq, var_pop(x) * any_value(n) AS ss,
  sum(ey * ey) AS sl, sum(ey * eq) AS syq, sum(eq * eq) AS sqq FROM e GROUP BY 1, 2, 3),
arc AS (SELECT *, a - c2 * aq AS c0, b - c2 * bq AS c1, CASE WHEN c2 IS NOT NULL THEN 1 - (sl - syq * syq / sqq) / ss END AS r2 FROM r)"""


@query("phrase_arcs", sql("curves", ARCS + """
SELECT piece_id, performance_id, start, n, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(r2, 6) AS r2 FROM arc"""))
def phrase_arcs(spark, sf):
    a = _arcs(spark, sf).drop("ss")
    return rnd(a, 6, "c0", "c1", "c2", "r2")


def _arcs(spark, sf):
    c = curves(spark, sf).select("piece_id", "performance_id", "beat", "x")
    k = ["piece_id", "performance_id"]
    st = c.select(*k, (F.expr("beat div 8 * 8") + F.col("performance_id") % 3).alias(
        "start")).distinct()
    return M.phrase_arcs(c, st, k, "beat", "x", 4096)


@query("phrase_arc_summary", sql("curves", ARCS + """
SELECT piece_id, performance_id, count(c2) AS n_phrases, round(avg((c2 < 0)::INT), 9) AS concave_share,
  round(1 - sum(CASE WHEN r2 IS NOT NULL THEN (1 - r2) * ss ELSE ss END) / sum(ss), 6) AS arc_r2_within FROM arc GROUP BY 1, 2"""))
def phrase_arc_summary(spark, sf):
    s = M.arc_summary(_arcs(spark, sf), ["piece_id", "performance_id"])
    return rnd(rnd(s, 9, "concave_share"), 6, "arc_r2_within")


@query("shifted_phrase_starts", sql("curves", """
, st AS (SELECT DISTINCT performance_id, beat // 8 * 8 AS start FROM curves),
sp AS (SELECT performance_id, min(beat) AS lo, max(beat) + 1 AS hi FROM curves GROUP BY 1)
SELECT performance_id, lo + ((start - lo + 59) % (hi - lo)) AS start FROM st JOIN sp USING (performance_id)"""))
def shifted_phrase_starts(spark, sf):
    c = curves(spark, sf)
    st = c.select("performance_id", F.expr("beat div 8 * 8").alias("start")).distinct()
    sp = c.groupBy("performance_id").agg(F.min("beat").alias("lo"), (F.max("beat") + 1).alias(
        "hi"))
    return M.shift_boundaries(st, sp, P, 59)


@query("run_evenness", sql("notes", """
, r AS (SELECT performance_id, onset_us // 5000000 AS run, note_id AS pos, onset_us, note_id * 3000 AS expected_us, CAST(velocity AS DOUBLE) AS v FROM notes),
i AS (SELECT *, (lead(onset_us) OVER w - onset_us) AS ioi, (lead(expected_us) OVER w - expected_us) AS ex FROM r
  WINDOW w AS (PARTITION BY performance_id, run ORDER BY pos)),
a AS (SELECT performance_id, run, count(*) AS n_onsets, count(CASE WHEN ex > 0 THEN 1 END) AS n_iois,
  CASE WHEN count(ioi / ex) >= 4 THEN stddev_samp(ioi / ex) / avg(ioi / ex) END AS ioi_cv,
  count(ioi / ex) / nullif(sum(ioi), 0) * 1e6 AS note_rate FROM i GROUP BY 1, 2),
u AS (SELECT *, 2.0 * (pos - min(pos) OVER w) / greatest(max(pos) OVER w - min(pos) OVER w, 1e-9) - 1 AS u FROM r WINDOW w AS (PARTITION BY performance_id, run)),
f AS (SELECT performance_id, run, count(*) AS n, regr_slope(v, u) AS b, regr_intercept(v, u) AS a, regr_slope(u * u, u) AS bq,
  regr_intercept(u * u, u) AS aq FROM u GROUP BY 1, 2),
e AS (SELECT u.performance_id, u.run, v - a - b * u AS ey, u * u - aq - bq * u AS eq FROM u JOIN f USING (performance_id, run)),
s AS (SELECT performance_id, run, sum(ey * ey) AS sl, sum(ey * ey) - sum(ey * eq) * sum(ey * eq) / nullif(sum(eq * eq), 0) AS sq FROM e GROUP BY 1, 2)
SELECT performance_id, run, n_onsets, n_iois, round(ioi_cv, 6) AS ioi_cv, round(note_rate, 6) AS note_rate,
  round(CASE WHEN n >= 12 THEN sqrt(sq / (n - 3)) WHEN n >= 5 THEN sqrt(sl / (n - 2)) END, 6) AS vel_sd
FROM a JOIN f USING (performance_id, run) JOIN s USING (performance_id, run)"""))
def run_evenness(spark, sf):
    r = notes(spark, sf).select(
        "performance_id", F.expr("onset_us div 5000000").alias("run"),
        F.col("note_id").alias("pos"), "onset_us", (F.col("note_id") * 3000).alias("expected_us"),
        F.col("velocity").cast("double").alias("velocity"))
    return rnd(M.evenness(r, ["performance_id", "run"]), 6, "ioi_cv", "note_rate", "vel_sd")


@query("bar_positions", sql("bars", """
, m AS (SELECT score_id, min(measure_idx) AS m0 FROM bars GROUP BY 1)
SELECT s.score_id, s.note_id, s.onset_uq - b.start_uq + CASE WHEN s.measure_idx = m0 AND b.end_uq - b.start_uq < 28000000
  THEN 28000000 - (b.end_uq - b.start_uq) ELSE 0 END AS pos_in_bar
FROM score s JOIN bars b USING (score_id, measure_idx) JOIN m USING (score_id)"""))
def bar_positions(spark, sf):
    s = score(spark, sf).select("score_id", "note_id", "onset_uq", "measure_idx")
    return M.bar_positions(s, bars(spark, sf), SC, 28 * MICRO).select(
        "score_id", "note_id", "pos_in_bar")


@query("cadence_kernels", sql("score", """
, ev AS (SELECT DISTINCT score_id, onset_uq AS e FROM score WHERE quantity = 50),
a AS (SELECT s.score_id, s.note_id, s.onset_uq, ev.e AS nx FROM score s ASOF LEFT JOIN ev ON ev.score_id = s.score_id AND s.onset_uq <= ev.e),
b AS (SELECT a.*, ev.e AS pv FROM a ASOF LEFT JOIN ev ON ev.score_id = a.score_id AND a.onset_uq > ev.e)
SELECT score_id, note_id, round(coalesce(exp(-(nx - onset_uq) / 28e6), 0), 9) AS pre,
  round(coalesce(exp(-(onset_uq - pv) / 28e6), 0), 9) AS post FROM b"""))
def cadence_kernels(spark, sf):
    s = score(spark, sf)
    ev = s.where("quantity = 50").select("score_id", F.col("onset_uq").alias("event")).distinct()
    out = M.event_kernels(s.select("score_id", "note_id", "onset_uq"), ev, SC, "onset_uq", 28e6,
                          SCORE_CHUNK)
    return rnd(out.select("score_id", "note_id", "pre", "post"), 9, "pre", "post")


@query("hand_risk_flags", sql("score", """
, n AS (SELECT score_id, voice, count(*) FILTER (staff = 1) AS n1, count(*) FILTER (staff = 2) AS n2 FROM score GROUP BY 1, 2),
o AS (SELECT score_id, onset_uq, count(*) FILTER (staff = 1) AS c1, count(*) FILTER (staff = 2) AS c2,
  min(pitch) FILTER (staff = 1) AS lo1, max(pitch) FILTER (staff = 1) AS hi1, min(pitch) FILTER (staff = 2) AS lo2,
  max(pitch) FILTER (staff = 2) AS hi2 FROM score GROUP BY 1, 2)
SELECT score_id, note_id, coalesce(CASE WHEN n1 > n2 THEN staff <> 1 WHEN n2 > n1 THEN staff <> 2 END, false) AS off_staff,
  coalesce(CASE WHEN staff = 1 THEN pitch < hi2 ELSE pitch > lo1 END, false) AS crossing,
  CASE WHEN staff = 1 THEN c1 > 5 OR hi1 - lo1 > 14 ELSE c2 > 5 OR hi2 - lo2 > 14 END AS stretch
FROM score JOIN n USING (score_id, voice) JOIN o USING (score_id, onset_uq)"""))
def hand_risk_flags(spark, sf):
    return M.hand_risk_flags(score(spark, sf), SC).select("score_id", "note_id", "off_staff",
                                                          "crossing", "stretch")


@query("bar_window_span", sql("notes", """
, m AS (SELECT performance_id, onset_us, k AS pos, onset_us // 3000000 AS bar FROM notes WHERE label = 'match'),
s AS (SELECT performance_id, min(onset_us) AS start_us FROM m WHERE bar BETWEEN 2 AND 4 GROUP BY 1),
p AS (SELECT performance_id, min(pos) AS pos FROM m WHERE bar = 5 GROUP BY 1),
e AS (SELECT performance_id, quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS end_us FROM m JOIN p USING (performance_id, pos) WHERE bar = 5 GROUP BY 1)
SELECT performance_id, start_us, end_us FROM s LEFT JOIN e USING (performance_id)"""))
def bar_window_span(spark, sf):
    m = notes(spark, sf).where("label = 'match'").select(
        "performance_id", "onset_us", F.col("k").alias("pos"), F.expr(
            "onset_us div 3000000").alias("measure_idx"))
    return M.bar_window_span(m, P, 2, 4)


@query("global_descriptors", sql("notes", """
, b AS (SELECT performance_id, stddev_samp(m) AS bar_vel_sd FROM (SELECT performance_id, onset_us // 2000000 AS bar, avg(velocity) AS m
  FROM notes GROUP BY 1, 2) GROUP BY 1)
SELECT performance_id, round(avg(velocity), 6) AS vel_mean, round(stddev_pop(velocity), 6) AS vel_sd,
  round(quantile_cont(CAST(velocity AS DOUBLE), 0.95) - quantile_cont(CAST(velocity AS DOUBLE), 0.05), 6) AS vel_range,
  round(any_value(bar_vel_sd), 6) AS bar_vel_sd, round(quantile_cont(CAST(duration_us AS DOUBLE), 0.5), 3) AS art_median,
  round(quantile_cont(CAST(duration_us AS DOUBLE), 0.75) - quantile_cont(CAST(duration_us AS DOUBLE), 0.25), 3) AS art_iqr,
  round(count(*) / ((max(onset_us + duration_us) - min(onset_us)) / 1e6), 6) AS notes_per_sec
FROM notes JOIN b USING (performance_id) GROUP BY 1"""))
def global_descriptors(spark, sf):
    n = notes(spark, sf).withColumn("bar", F.expr("onset_us div 2000000"))
    d = M.global_descriptors(n, P, "bar")
    return rnd(rnd(d, 6, "vel_mean", "vel_sd", "vel_range", "bar_vel_sd", "notes_per_sec"), 3,
               "art_median", "art_iqr")


@query("bar_window_notes", sql("notes", """
, w AS (SELECT *, CASE WHEN label = 'match' THEN onset_us // 3000000 END AS bar FROM notes),
m AS (SELECT performance_id, onset_us, k AS pos, bar FROM w WHERE bar IS NOT NULL),
s AS (SELECT performance_id, min(onset_us) AS start_us FROM m WHERE bar BETWEEN 2 AND 4 GROUP BY 1),
p AS (SELECT performance_id, min(pos) AS pos FROM m WHERE bar = 5 GROUP BY 1),
e AS (SELECT performance_id, quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS end_us FROM m
  JOIN p USING (performance_id, pos) WHERE bar = 5 GROUP BY 1),
t AS (SELECT performance_id, max(onset_us + duration_us) AS top FROM notes GROUP BY 1),
x AS (SELECT performance_id, start_us, coalesce(end_us, top)::DOUBLE AS z FROM s JOIN t USING (performance_id)
  LEFT JOIN e USING (performance_id)),
n AS (SELECT w.*, z FROM w JOIN x USING (performance_id) WHERE CASE WHEN bar IS NULL
  THEN onset_us >= start_us - 30000 AND onset_us < z - 100 ELSE bar BETWEEN 2 AND 4 END)
SELECT performance_id, note_id, onset_us - min(onset_us) OVER (PARTITION BY performance_id)
    AS new_onset_us, round(greatest(20000.0, least(onset_us + duration_us, z + 500000) - onset_us), 3)
  AS new_duration_us FROM n"""))
def bar_window_notes(spark, sf):
    """Bars 2 to 4 of every performance as a performance that begins at 0."""
    n = notes(spark, sf).withColumn("measure_idx", F.when(F.col("label") == "match", F.expr(
        "onset_us div 3000000")))
    m = n.where("measure_idx is not null").select(
        "performance_id", "onset_us", F.col("k").alias("pos"), "measure_idx")
    w = M.bar_window_notes(n, M.bar_window_span(m, P, 2, 4), P, 2, 4, release_us=500_000)
    return w.select("performance_id", "note_id", "new_onset_us", F.round("new_duration_us", 3).alias(
        "new_duration_us"))
