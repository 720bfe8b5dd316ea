"""Join and correctness queries: two renditions of the event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.operators import correctness as K
from ritardo.operators import joins as J
from ritardo.operators import matching as M
from ritardo.plans.consensus import rnd
from ritardo.plans.registry import query
from ritardo.plans.standins import NOTE_CHUNK, notes, score, sql, table

P = ["performance_id"]
JITTER = "(cast(floor(value * 1000) as bigint) % 60000) - 30000"


def reference_notes(spark, sf):
    """The reference rendition: every event but the insertions."""
    return notes(spark, sf).where("label <> 'insertion'")


def estimated_notes(spark, sf):
    """The second rendition: every event but the deletions, with shifted onsets."""
    return notes(spark, sf).where("label <> 'deletion'").withColumn(
        "onset_us", F.col("onset_us") + F.expr(JITTER) + 250_000)


REF_EST = """
, r AS (SELECT * FROM notes WHERE label <> 'insertion'),
e AS (SELECT * REPLACE (onset_us + (CAST(floor(value * 1000) AS BIGINT) % 60000) - 30000 + 250000
  AS onset_us) FROM notes WHERE label <> 'deletion')"""

# walk the reference notes of a (performance, pitch) in time order, taking the earliest estimate
# that is unused and not too early
MATCHED = """
, rr AS (SELECT *, row_number() OVER (PARTITION BY performance_id, pitch ORDER BY onset_us, note_id) AS i
  FROM r),
el AS (SELECT performance_id, pitch, list(onset_us ORDER BY onset_us, note_id) AS es,
  list(note_id ORDER BY onset_us, note_id) AS ids FROM {est} GROUP BY 1, 2),
w AS (
  WITH RECURSIVE walk AS (
    SELECT performance_id, pitch, 0 AS i, 0::BIGINT AS k, NULL::BIGINT AS ref_id,
      NULL::BIGINT AS est_id, NULL::BIGINT AS ref_us, NULL::BIGINT AS est_us
    FROM (SELECT DISTINCT performance_id, pitch FROM rr)
    UNION ALL
    SELECT performance_id, pitch, i, CASE WHEN j <= len(es) AND es[j] <= t + {tol} THEN j ELSE j - 1 END,
      CASE WHEN es[j] <= t + {tol} THEN rid END, CASE WHEN es[j] <= t + {tol} THEN ids[j] END,
      CASE WHEN es[j] <= t + {tol} THEN t END, CASE WHEN es[j] <= t + {tol} THEN es[j] END
    FROM (SELECT w.performance_id, w.pitch, rr.i, rr.onset_us AS t, rr.note_id AS rid, el.es, el.ids,
        greatest(w.k, len(list_filter(el.es, lambda x: x < rr.onset_us - {tol}))) + 1 AS j
      FROM walk w JOIN rr ON rr.performance_id = w.performance_id AND rr.pitch = w.pitch
        AND rr.i = w.i + 1
      JOIN el ON el.performance_id = w.performance_id AND el.pitch = w.pitch))
  SELECT * FROM walk WHERE est_id IS NOT NULL)"""


# two passes: the median offset of the wide matches is taken off, then the narrow ones are made
ONE_CLOCK = MATCHED.format(tol=400000, est="e") + """
, off AS (SELECT performance_id, CAST(round(median(est_us - ref_us)) AS BIGINT) AS o FROM w GROUP BY 1),
f AS (SELECT e.* REPLACE (onset_us - coalesce(o, 0) AS onset_us) FROM e LEFT JOIN off USING (performance_id))
""" + MATCHED.format(tol=50000, est="f").replace("rr AS", "rr2 AS").replace(" rr ", " rr2 ").replace(
    "el AS", "el2 AS").replace(" el ", " el2 ").replace("el.", "el2.").replace("rr.", "rr2.").replace(
    "FROM rr)", "FROM rr2)").replace("\nw AS", "\nw2 AS")


@query("match_notes", sql("notes", REF_EST + MATCHED.format(tol=2000000, est="e") + """
SELECT performance_id, pitch, ref_id, est_id FROM w"""))
def match_notes(spark, sf):
    m = M.match_notes(reference_notes(spark, sf), estimated_notes(spark, sf), P, 2_000_000,
                      NOTE_CHUNK)
    return m.select("performance_id", "pitch", "ref_id", "est_id")


@query("note_f1", sql("notes", REF_EST + MATCHED.format(tol=50000, est="e") + """
, nr AS (SELECT performance_id, count(*) AS n_ref FROM r GROUP BY 1),
ne AS (SELECT performance_id, count(*) AS n_est FROM e GROUP BY 1),
nm AS (SELECT performance_id, count(*) AS n_match, avg(est_us - ref_us) / 1000.0 AS err FROM w GROUP BY 1),
a AS (SELECT performance_id, n_ref, n_est, coalesce(n_match, 0) AS n_match, err
  FROM nr JOIN ne USING (performance_id) LEFT JOIN nm USING (performance_id))
SELECT performance_id, n_ref, n_est, n_match, round(err, 9) AS onset_err_mean_ms,
  round(n_match / n_est, 9) AS precision, round(n_match / n_ref, 9) AS recall,
  round(CASE WHEN n_match > 0 THEN 2.0 * n_match / (n_ref + n_est) ELSE 0 END, 9) AS f1 FROM a"""))
def note_f1(spark, sf):
    f = M.note_f1(reference_notes(spark, sf), estimated_notes(spark, sf), P, 50_000, NOTE_CHUNK)
    return rnd(f, 9, "precision", "recall", "f1", "onset_err_mean_ms")


@query("note_f1_clock_offset", sql("notes", REF_EST + ONE_CLOCK + """
, nr AS (SELECT performance_id, count(*) AS n_ref FROM r GROUP BY 1),
ne AS (SELECT performance_id, count(*) AS n_est FROM e GROUP BY 1),
nm AS (SELECT performance_id, count(*) AS n_match, avg(est_us - ref_us) / 1000.0 AS err FROM w2 GROUP BY 1),
a AS (SELECT performance_id, n_ref, n_est, coalesce(n_match, 0) AS n_match, err
  FROM nr JOIN ne USING (performance_id) LEFT JOIN nm USING (performance_id))
SELECT performance_id, n_ref, n_est, n_match, round(err, 9) AS onset_err_mean_ms,
  round(n_match / n_est, 9) AS precision, round(n_match / n_ref, 9) AS recall,
  round(CASE WHEN n_match > 0 THEN 2.0 * n_match / (n_ref + n_est) ELSE 0 END, 9) AS f1 FROM a"""))
def note_f1_clock_offset(spark, sf):
    f = M.note_f1(reference_notes(spark, sf), estimated_notes(spark, sf), P, 50_000, NOTE_CHUNK,
                  first_tol_us=400_000)
    return rnd(f, 9, "precision", "recall", "f1", "onset_err_mean_ms")


@query("label_false_extras", sql("notes", REF_EST + ONE_CLOCK + """
SELECT e.performance_id, e.note_id, CASE WHEN w2.est_id IS NULL THEN 1 ELSE 0 END AS false_extra
FROM e LEFT JOIN w2 ON w2.performance_id = e.performance_id AND w2.est_id = e.note_id"""))
def label_false_extras(spark, sf):
    # the clocks of these tables are a quarter of a second apart
    out = M.false_extras(reference_notes(spark, sf), estimated_notes(spark, sf), P, NOTE_CHUNK,
                         first_tol_us=400_000)
    return out.select("performance_id", "note_id", "false_extra")


@query("nearest_note_labels", sql("notes", REF_EST + """
, lo AS (SELECT e.performance_id, e.note_id AS row_id, e.pitch, e.onset_us AS t, r.note_id AS lo_id,
  e.onset_us - r.onset_us AS dl
  FROM e ASOF LEFT JOIN r ON e.performance_id = r.performance_id AND e.pitch = r.pitch
    AND e.onset_us >= r.onset_us),
hi AS (SELECT e.note_id AS row_id, r.note_id AS hi_id, r.onset_us - e.onset_us AS dh
  FROM e ASOF LEFT JOIN r ON e.performance_id = r.performance_id AND e.pitch = r.pitch
    AND e.onset_us < r.onset_us)
SELECT performance_id, row_id, CASE WHEN dh IS NULL OR dl <= dh
  THEN CASE WHEN dl <= 600000 THEN lo_id END ELSE CASE WHEN dh <= 600000 THEN hi_id END END AS note_id
FROM lo JOIN hi USING (row_id)"""))
def nearest_note_labels(spark, sf):
    rows = estimated_notes(spark, sf).select(
        "performance_id", "pitch", F.col("note_id").alias("row_id"),
        F.col("onset_us").alias("row_us"))
    out = M.nearest_note(rows, reference_notes(spark, sf), P, 600_000, NOTE_CHUNK)
    return out.select("performance_id", "row_id", "note_id")


@query("label_integrity", sql("notes", REF_EST + """
, lo AS (SELECT e.performance_id, e.note_id AS row_id, e.velocity, r.note_id AS lo_id, e.onset_us - r.onset_us AS dl
  FROM e ASOF LEFT JOIN r ON e.performance_id = r.performance_id AND e.pitch = r.pitch AND e.onset_us >= r.onset_us),
hi AS (SELECT e.note_id AS row_id, r.note_id AS hi_id, r.onset_us - e.onset_us AS dh
  FROM e ASOF LEFT JOIN r ON e.performance_id = r.performance_id AND e.pitch = r.pitch AND e.onset_us < r.onset_us),
m AS (SELECT performance_id, velocity, CASE WHEN dh IS NULL OR dl <= dh THEN CASE WHEN dl <= 600000 THEN lo_id END
  ELSE CASE WHEN dh <= 600000 THEN hi_id END END AS note_id FROM lo JOIN hi USING (row_id)),
c AS (SELECT m.*, r.velocity AS v, CASE WHEN m.note_id IS NOT NULL THEN count(*) OVER (PARTITION BY m.performance_id, m.note_id) END AS n
  FROM m LEFT JOIN r ON r.performance_id = m.performance_id AND r.note_id = m.note_id)
SELECT performance_id, count(*) AS n_rows, count(*) FILTER (note_id IS NULL) AS n_unmatched, count(*) FILTER (n > 1) AS n_duplicate,
  count(*) FILTER (v <> velocity) AS n_velocity_differs FROM c GROUP BY 1"""))
def label_integrity(spark, sf):
    rows = estimated_notes(spark, sf).select(
        "performance_id", "pitch", F.col("note_id").alias("row_id"),
        F.col("onset_us").alias("row_us"), "velocity")
    return M.labelled_notes(rows, reference_notes(spark, sf), P, 600_000, NOTE_CHUNK)[1]


# a bound on the number of steps is not needed: the walk ends with the last candidate
GREEDY = """
, ord AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS i FROM cand),
lim AS (SELECT {key}, max(i) AS n FROM ord GROUP BY {key}),
gw AS (
  WITH RECURSIVE walk AS (
    SELECT {key}, 0 AS i, []::VARCHAR[] AS us, []::VARCHAR[] AS up, NULL::VARCHAR AS s, NULL::VARCHAR AS p
    FROM lim
    UNION ALL
    SELECT {wkey}, o.i,
      CASE WHEN list_contains(w.us, o.s) OR list_contains(w.up, o.p) THEN w.us ELSE list_append(w.us, o.s) END,
      CASE WHEN list_contains(w.us, o.s) OR list_contains(w.up, o.p) THEN w.up ELSE list_append(w.up, o.p) END,
      CASE WHEN list_contains(w.us, o.s) OR list_contains(w.up, o.p) THEN NULL ELSE o.s END,
      CASE WHEN list_contains(w.us, o.s) OR list_contains(w.up, o.p) THEN NULL ELSE o.p END
    FROM walk w JOIN ord o ON {join} AND o.i = w.i + 1)
  SELECT * FROM walk WHERE s IS NOT NULL)"""


@query("boundary_prf", sql("notes", REF_EST + """
, fo AS (SELECT performance_id, min(onset_us) AS pos FROM r GROUP BY 1),
bp AS (SELECT performance_id, onset_us AS pos FROM e WHERE event_type IN ('view', 'signup')
  AND (performance_id, onset_us) NOT IN (SELECT performance_id, pos FROM fo)),
bt AS (SELECT performance_id, onset_us AS pos FROM r WHERE event_type IN ('click', 'error')
  AND (performance_id, onset_us) NOT IN (SELECT performance_id, pos FROM fo)),
cand AS (SELECT p.performance_id, abs(p.pos - t.pos) AS d, p.pos AS pp, t.pos AS tt,
  CAST(p.pos AS VARCHAR) AS s, CAST(t.pos AS VARCHAR) AS p
  FROM bp p JOIN bt t ON p.performance_id = t.performance_id AND abs(p.pos - t.pos) <= 1000000)
""" + GREEDY.format(key="performance_id", wkey="w.performance_id", order="d, pp, tt",
                    join="o.performance_id = w.performance_id") + """
, a AS (SELECT performance_id, np AS n_pred, nt AS n_true, coalesce(tp, 0) AS tp
  FROM (SELECT performance_id, count(*) AS np FROM bp GROUP BY 1)
  JOIN (SELECT performance_id, count(*) AS nt FROM bt GROUP BY 1) USING (performance_id)
  LEFT JOIN (SELECT performance_id, count(*) AS tp FROM gw GROUP BY 1) USING (performance_id))
SELECT performance_id, n_pred, n_true, tp, round(tp / n_pred, 9) AS precision,
  round(tp / n_true, 9) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (n_pred + n_true) ELSE 0 END, 9) AS f1 FROM a"""))
def boundary_prf(spark, sf):
    pred = estimated_notes(spark, sf).where("event_type in ('view', 'signup')").select(
        "performance_id", F.col("onset_us").alias("pos"))
    true = reference_notes(spark, sf).where("event_type in ('click', 'error')").select(
        "performance_id", F.col("onset_us").alias("pos"))
    first = reference_notes(spark, sf).groupBy(*P).agg(F.min("onset_us").alias("pos"))
    return rnd(M.boundary_prf(pred, true, P, 1_000_000, first), 9, "precision", "recall", "f1")


@query("wrong_pitch_pairing", sql("notes", REF_EST + """
, m AS (SELECT performance_id, note_id, pitch, onset_us + 250000 AS x FROM r WHERE event_type IN ('error', 'view')),
x AS (SELECT performance_id, note_id, pitch, onset_us FROM e WHERE event_type IN ('signup', 'click', 'purchase')),
cand AS (SELECT m.performance_id, CAST(m.note_id AS VARCHAR) AS s, CAST(x.note_id AS VARCHAR) AS p,
  m.note_id AS sid, x.note_id AS pid, abs(x.onset_us - m.x) / 100000.0
    + CASE WHEN abs(x.pitch - m.pitch) <= 2 THEN abs(x.pitch - m.pitch) ELSE 3 END / 12.0 AS cost
  FROM m JOIN x ON m.performance_id = x.performance_id AND abs(x.onset_us - m.x) <= 300000
    AND (abs(x.pitch - m.pitch) IN (1, 2, 12)))
""" + GREEDY.format(key="performance_id", wkey="w.performance_id", order="cost, sid, pid",
                    join="o.performance_id = w.performance_id") + """
SELECT performance_id, CAST(s AS BIGINT) AS s_id, CAST(p AS BIGINT) AS p_id FROM gw"""))
def wrong_pitch_pairing(spark, sf):
    missed = reference_notes(spark, sf).where("event_type in ('error', 'view')").select(
        "performance_id", F.col("note_id").alias("s_id"), F.col("pitch").alias("s_pitch"),
        (F.col("onset_us") + 250_000).cast("double").alias("expected_us"),
        F.lit(300_000.0).alias("window_us"))
    extra = estimated_notes(spark, sf).where(
        "event_type in ('signup', 'click', 'purchase')").select(
        "performance_id", F.col("note_id").alias("p_id"), F.col("pitch").alias("p_pitch"),
        "onset_us")
    return K.pair_wrong_pitches(missed, extra, P)


@query("loo_expected_onsets", sql("notes", """
, g AS (SELECT performance_id, note_id, (onset_us // 500000) * 1000000 AS pos_uq, onset_us FROM notes),
mate AS (SELECT a.performance_id, a.note_id, quantile_cont(CAST(b.onset_us AS DOUBLE), 0.5) AS mate
  FROM g a JOIN g b ON a.performance_id = b.performance_id AND a.pos_uq = b.pos_uq
    AND a.note_id <> b.note_id GROUP BY 1, 2),
q AS (SELECT performance_id, pos_uq, quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS med FROM g GROUP BY 1, 2),
k AS (SELECT *, max(med) OVER (PARTITION BY performance_id ORDER BY pos_uq) AS kt FROM q),
n AS (SELECT performance_id, pos_uq, lag(pos_uq) OVER w AS p0, lag(kt) OVER w AS k0,
  lead(pos_uq) OVER w AS p1, lead(kt) OVER w AS k1 FROM k
  WINDOW w AS (PARTITION BY performance_id ORDER BY pos_uq))
SELECT g.performance_id, g.note_id, round(coalesce(mate,
  k0 + (k1 - k0) * (g.pos_uq - p0) / (p1 - p0), k0, k1), 0) AS expected_us
FROM g JOIN n USING (performance_id, pos_uq) LEFT JOIN mate USING (performance_id, note_id)"""))
def loo_expected_onsets(spark, sf):
    n = notes(spark, sf).select("performance_id", "note_id", F.expr(
        "(onset_us div 500000) * 1000000").alias("pos_uq"), "onset_us")
    out = M.loo_expected_onsets(n, n, P, "note_id", NOTE_CHUNK)
    return out.select("performance_id", "note_id",
                      F.round("expected_us", 0).alias("expected_us"))


@query("evaluate_alignment_matches", sql("notes", """
, p AS (SELECT DISTINCT performance_id, k AS s, pitch AS q FROM notes WHERE event_type IN ('view', 'click', 'signup')),
t AS (SELECT DISTINCT performance_id, k AS s, pitch AS q FROM notes WHERE event_type IN ('view', 'error', 'purchase')),
j AS (SELECT performance_id, p.s IS NOT NULL AS a, t.s IS NOT NULL AS b
  FROM p FULL JOIN t USING (performance_id, s, q)),
c AS (SELECT performance_id, count(*) FILTER (a) AS n_pred, count(*) FILTER (b) AS n_true,
  count(*) FILTER (a AND b) AS n_correct FROM j GROUP BY 1)
SELECT *, round(CASE WHEN n_pred > 0 THEN n_correct / n_pred ELSE 0 END, 9) AS precision,
  round(CASE WHEN n_true > 0 THEN n_correct / n_true ELSE 0 END, 9) AS recall,
  round(CASE WHEN n_correct > 0 THEN 2.0 * n_correct / (n_pred + n_true) ELSE 0 END, 9) AS f1 FROM c"""))
def evaluate_alignment_matches(spark, sf):
    n = notes(spark, sf).withColumnsRenamed({"k": "s", "pitch": "q"})
    out = M.set_prf(n.where("event_type in ('view', 'click', 'signup')"),
                    n.where("event_type in ('view', 'error', 'purchase')"), P, ["s", "q"])
    return rnd(out, 9, "precision", "recall", "f1")


@query("beat_consistency", sql("notes", """
, d AS (SELECT performance_id, onset_us // 3000000 AS bar, min(onset_us) AS db FROM notes GROUP BY 1, 2),
s AS (SELECT *, lead(db) OVER (PARTITION BY performance_id ORDER BY bar) AS nx FROM d),
n AS (SELECT performance_id, onset_us // 3000000 AS bar,
  onset_us + (CAST(floor(value * 100000) AS BIGINT) % 2000000) - 1000000 AS t FROM notes WHERE label = 'match')
SELECT n.performance_id, count(*) AS n_checked, round(avg((t >= db - 250000
  AND (nx IS NULL OR t <= nx + 250000))::INT), 9) AS share_inside
FROM n JOIN s USING (performance_id, bar) GROUP BY 1"""))
def beat_consistency(spark, sf):
    n = notes(spark, sf).withColumn("bar", F.expr("onset_us div 3000000"))
    downbeats = n.groupBy("performance_id", "bar").agg(F.min("onset_us").alias("downbeat_us"))
    m = n.where("label = 'match'").withColumn(
        "onset_us", F.col("onset_us") + F.expr(
            "(cast(floor(value * 100000) as bigint) % 2000000) - 1000000"))
    return rnd(J.beat_consistency(m, downbeats, P, "bar", 250_000, 4096), 9, "share_inside")


@query("restrict_to_score", sql("notes", """
, keep AS (SELECT performance_id, note_id FROM notes WHERE k BETWEEN 20 AND 69 AND label <> 'insertion'),
ins AS (SELECT performance_id, min(onset_us) AS lo, max(onset_us) AS hi FROM notes
  WHERE label = 'match' AND k BETWEEN 20 AND 69 GROUP BY 1)
SELECT n.performance_id, n.note_id, n.label FROM notes n LEFT JOIN ins USING (performance_id)
WHERE (n.label = 'insertion' AND n.onset_us BETWEEN lo AND hi)
   OR (n.label <> 'insertion' AND n.k BETWEEN 20 AND 69)"""))
def restrict_to_score(spark, sf):
    n = notes(spark, sf)
    pairs = n.select(
        "performance_id", "label",
        F.when(F.col("label") != "insertion", F.col("note_id")).alias("s_id"),
        F.when(F.col("label") != "deletion", F.col("note_id")).alias("p_id"), "onset_us")
    keep = n.where("label <> 'insertion' and k between 20 and 69").select(
        "performance_id", F.col("note_id").alias("s_id"))
    out = J.restrict_to_score(pairs, keep, P)
    return out.select("performance_id", F.coalesce("s_id", "p_id").alias("note_id"), "label")


@query("alias_conflicts", sql("notes", """
, d AS (SELECT doc_id, source, lang, list_distinct(regexp_extract_all(lower(text), '[a-z]{11,}')) AS toks
  FROM documents),
h AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM labels) AND len(toks) > 0),
c AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND len(toks) > 0)
SELECT DISTINCT c.doc_id AS piece_id, h.doc_id AS held_piece_id FROM h JOIN c ON h.source = c.source
WHERE list_has_any(h.toks, c.toks) AND (list_has_all(h.toks, c.toks) OR list_has_all(c.toks, h.toks))"""))
def alias_conflicts(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("piece_id"), F.col("source").alias("surname"), "lang",
        F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z]{11,}', 0)")).alias("tokens"))
    rated = table(spark, sf, "labels").select(F.col("doc_id").alias("piece_id"))
    return J.alias_conflicts(d.join(rated, "piece_id", "left_semi"),
                             d.join(rated, "piece_id", "left_anti"), "^[a-z]+$")


@query("best_window", sql("notes", """
, w AS (SELECT performance_id, event_type AS window_id, min(onset_us) AS first_seen,
  list_distinct(list(onset_us // 3000000)) AS bars FROM notes WHERE event_type <> 'error' GROUP BY 1, 2),
i AS (SELECT DISTINCT performance_id, onset_us // 3000000 AS bar FROM notes WHERE event_type = 'error'),
c AS (SELECT i.performance_id, w.window_id, first_seen, count(*) AS n FROM i JOIN w
  ON w.performance_id = i.performance_id AND list_contains(w.bars, i.bar) GROUP BY 1, 2, 3)
SELECT performance_id, window_id, n AS n_shared FROM c
QUALIFY row_number() OVER (PARTITION BY performance_id ORDER BY n DESC, first_seen) = 1"""))
def best_window(spark, sf):
    n = notes(spark, sf).withColumn("bar", F.expr("onset_us div 3000000"))
    win = n.where("event_type <> 'error'").groupBy(
        "performance_id", F.col("event_type").alias("window_id")).agg(
        F.min("onset_us").alias("seq"), F.collect_set("bar").alias("bars"))
    return J.best_window(n.where("event_type = 'error'").select("performance_id", "bar"), win, P)


@query("span_match_share", sql("notes", REF_EST + """
SELECT r.performance_id, round(avg(EXISTS (SELECT 1 FROM e WHERE e.performance_id = r.performance_id
  AND e.pitch = r.pitch AND e.onset_us BETWEEN r.onset_us + 250000 - 125000 AND r.onset_us + 250000 + 125000)::INT), 9)
  AS share_found
FROM r GROUP BY 1"""))
def span_match_share(spark, sf):
    r = reference_notes(spark, sf).withColumn("onset_us", F.col("onset_us") + 250_000)
    return rnd(J.span_match(r, estimated_notes(spark, sf), P, 125_000), 9, "share_found")


@query("ground_truth_variant", sql("notes", """
, v AS (SELECT DISTINCT performance_id, event_type AS variant, pitch AS id FROM notes WHERE event_type <> 'error'),
t AS (SELECT DISTINCT performance_id, pitch AS id FROM notes WHERE event_type = 'error'),
nv AS (SELECT performance_id, variant, count(*) AS nv FROM v GROUP BY 1, 2),
nt AS (SELECT performance_id, count(*) AS nt FROM t GROUP BY 1),
c AS (SELECT performance_id, variant, count(*) AS nc FROM v JOIN t USING (performance_id, id) GROUP BY 1, 2),
j AS (SELECT nv.performance_id, nv.variant, coalesce(nc, 0) / (nv + nt - coalesce(nc, 0)) AS jaccard
  FROM nv JOIN nt USING (performance_id) LEFT JOIN c USING (performance_id, variant))
SELECT performance_id, variant, round(jaccard, 9) AS jaccard FROM j
QUALIFY row_number() OVER (PARTITION BY performance_id ORDER BY jaccard DESC, variant) = 1"""))
def ground_truth_variant(spark, sf):
    n = notes(spark, sf).select("performance_id", F.col("event_type").alias("variant"),
                                F.col("pitch").alias("id"))
    return rnd(J.best_variant(n.where("variant <> 'error'"), n.where("variant = 'error'"), P), 9,
               "jaccard")


@query("track_staff_lookup", sql("score", """
, l AS (SELECT score_id, onset_uq, pitch, CASE WHEN count(DISTINCT staff) = 2 THEN 0 ELSE min(staff) END AS track
  FROM score GROUP BY 1, 2, 3)
SELECT s.score_id, s.note_id, CAST(l.track AS BIGINT) AS track
FROM score s JOIN l USING (score_id, onset_uq, pitch)"""))
def track_staff_lookup(spark, sf):
    s = score(spark, sf)
    return J.staff_from_tracks(s.drop("staff"), s, ["score_id"]).select(
        "score_id", "note_id", "track")


@query("opening_match", sql("notes", """
, o AS (SELECT performance_id, pitch, row_number() OVER (PARTITION BY performance_id ORDER BY onset_us, note_id) AS i
  FROM notes),
g AS (SELECT a.performance_id, a.i, a.pitch AS p0, b.pitch AS p1, c.pitch AS p2 FROM o a
  JOIN o b ON b.performance_id = a.performance_id AND b.i = a.i + 1
  JOIN o c ON c.performance_id = a.performance_id AND c.i = a.i + 2)
SELECT q.performance_id * 1000 + q.i // 10 AS segment_id, f.performance_id, min(f.i) AS start_idx, count(*) AS n_places
FROM g q JOIN g f ON q.i % 10 = 1 AND f.performance_id = q.performance_id AND f.p0 = q.p0 AND f.p1 = q.p1 AND f.p2 = q.p2 GROUP BY 1, 2"""))
def opening_match(spark, sf):
    from ritardo.operators.ordered import chunk_of
    from ritardo.operators.sequences import running_index

    n = running_index(notes(spark, sf), P, ["onset_us", "note_id"],
                      chunk_of("onset_us", NOTE_CHUNK), "idx")
    n = n.select("performance_id", (F.col("idx") + 1).alias("idx"), "pitch")
    # every tenth note of a score begins a segment of it
    s = n.select("performance_id", (F.col("performance_id") * 1000 + F.expr(
        "(idx - 1) div 10")).alias("segment_id"), ((F.col("idx") - 1) % 10 + 1).alias("idx"), "pitch")
    return J.opening_match(n, P, s.where("idx <= 3"), "segment_id", 3)


@query("clock_line", sql("notes", REF_EST + """
, j AS (SELECT e.performance_id, r.onset_us / 1e6 AS x, e.onset_us / 1e6 AS y FROM r JOIN e USING (performance_id, note_id)),
l1 AS (SELECT performance_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM j GROUP BY 1),
m1 AS (SELECT j.performance_id, median(y - a - b * x) AS med FROM j JOIN l1 USING (performance_id) GROUP BY 1),
s1 AS (SELECT j.performance_id, any_value(med) AS med, greatest(1.4826 * median(abs(y - a - b * x - med)), 1e-3) AS sd
  FROM j JOIN l1 USING (performance_id) JOIN m1 USING (performance_id) GROUP BY 1),
k1 AS (SELECT j.* FROM j JOIN l1 USING (performance_id) JOIN s1 USING (performance_id)
  WHERE abs(y - a - b * x - med) < 1.5 * sd)
SELECT performance_id, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept,
  count(*) AS n_kept FROM k1 GROUP BY 1"""))
def clock_line(spark, sf):
    r = reference_notes(spark, sf).select("performance_id", "note_id",
                                          (F.col("onset_us") / 1e6).alias("x"))
    e = estimated_notes(spark, sf).select("performance_id", "note_id",
                                          (F.col("onset_us") / 1e6).alias("y"))
    out = J.trimmed_line(r.join(e, ["performance_id", "note_id"]), P, "x", "y", rounds=2, cut=1.5)
    return rnd(out, 9, "slope", "intercept")


@query("detection_counts", sql("notes", """
, p AS (SELECT DISTINCT performance_id, k AS id FROM notes WHERE event_type IN ('view', 'click')),
t AS (SELECT DISTINCT performance_id, k AS id FROM notes WHERE event_type IN ('click', 'error')),
g AS (SELECT DISTINCT performance_id, k AS id FROM notes WHERE event_type = 'signup'),
j AS (SELECT performance_id, id, p.id IS NOT NULL AS a, t.id IS NOT NULL AS b FROM
  (SELECT performance_id, id FROM p) p FULL JOIN t USING (performance_id, id))
, c AS (SELECT j.performance_id, count(*) FILTER (a AND b) AS tp,
  count(*) FILTER (a AND NOT b AND g.id IS NULL) AS fp, count(*) FILTER (b AND NOT a) AS fn
  FROM j LEFT JOIN g ON g.performance_id = j.performance_id AND g.id = j.id GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall FROM c"""))
def detection_counts(spark, sf):
    n = notes(spark, sf).select("performance_id", F.col("k").alias("id"), "event_type")
    out = J.detection_counts(n.where("event_type in ('view', 'click')"),
                             n.where("event_type in ('click', 'error')"),
                             n.where("event_type = 'signup'"), P, ["id"])
    return rnd(out, 9, "precision", "recall")


@query("annotator_agreement", sql("notes", """
, a AS (SELECT performance_id, k, CAST(floor(value) AS INT) % 4 AS c FROM notes WHERE event_type = 'view'),
b AS (SELECT performance_id, k, CAST(floor(value) AS INT) % 4 AS c FROM notes WHERE event_type = 'click'),
m AS (SELECT a.c AS ca, b.c AS cb FROM a JOIN b USING (performance_id, k)),
n AS (SELECT count(*) AS n, avg((ca = cb)::INT) AS po, avg(abs(ca - cb)) AS wo FROM m),
fa AS (SELECT ca AS c, count(*) AS f FROM m GROUP BY 1), fb AS (SELECT cb AS c, count(*) AS f FROM m GROUP BY 1),
e AS (SELECT sum(CASE WHEN fa.c = fb.c THEN fa.f * fb.f ELSE 0 END) AS pe,
  sum(abs(fa.c - fb.c) * fa.f * fb.f) AS we FROM fa CROSS JOIN fb)
SELECT n.n, round((po - pe / (n * n)) / (1 - pe / (n * n)), 9) AS kappa,
  round(1 - wo / (we / (n * n)), 9) AS weighted_kappa FROM n CROSS JOIN e"""))
def annotator_agreement(spark, sf):
    n = notes(spark, sf).select("performance_id", "k", "event_type",
                                (F.floor("value").cast("int") % 4).alias("c"))
    a = n.where("event_type = 'view'").select("performance_id", "k", F.col("c").alias("ca"))
    b = n.where("event_type = 'click'").select("performance_id", "k", F.col("c").alias("cb"))
    return rnd(J.kappa(a.join(b, ["performance_id", "k"]), "ca", "cb"), 9, "kappa",
               "weighted_kappa")


# ------------------------------------------------------------------ correctness

def correctness_inputs(spark, sf):
    """Score notes, played notes and listed pairs of every performance."""
    from ritardo.operators.ordered import chunk_of, scan

    n = notes(spark, sf)
    s = n.where("label <> 'insertion'").select(
        "performance_id", F.col("note_id").alias("s_id"),
        F.expr("(onset_us div 250000) * 1000000").alias("pos_uq"),
        F.lit(1_000_000).cast("bigint").alias("dur_uq"), "pitch",
        (F.col("k") % 25 == 7).alias("is_grace"), (F.col("k") % 25 == 3).alias("is_orn"))
    shift = (F.when(F.col("k") % 20 == 5, 1).when(F.col("k") % 20 == 6, 2)
             .when(F.col("k") % 20 == 8, 12).otherwise(0))
    p = n.where("label <> 'deletion'").select(
        "performance_id", F.col("note_id").alias("p_id"),
        (F.col("onset_us") + F.expr(JITTER)).alias("onset_us"),
        (F.col("pitch") + shift).cast("bigint").alias("pitch"))
    own = n.select(
        "performance_id", (F.col("note_id") * 2).alias("seq"), "label",
        F.when(F.col("label") != "insertion", F.col("note_id")).alias("s_id"),
        F.when(F.col("label") != "deletion", F.col("note_id")).alias("p_id"))
    clicks = scan(n.where("event_type = 'click'"), P, ["note_id"], chunk_of("note_id", 4096),
                  before=("prev", "note_id"))
    twice = clicks.where("k % 5 = 0 and before is not null").select(
        "performance_id", (F.col("note_id") * 2 + 1).alias("seq"), F.lit("match").alias("label"),
        F.col("note_id").alias("s_id"), F.col("before").alias("p_id"))
    return s, p, own.unionByName(twice)


PAIRS = """
, s AS (SELECT performance_id, note_id AS s_id, pitch, k % 25 = 7 AS is_grace, k % 25 = 3 AS is_orn
  FROM notes WHERE label <> 'insertion'),
p AS (SELECT performance_id, note_id AS p_id, pitch + CASE k % 20 WHEN 5 THEN 1 WHEN 6 THEN 2 WHEN 8
  THEN 12 ELSE 0 END AS pitch FROM notes WHERE label <> 'deletion'),
c AS (SELECT *, lag(note_id) OVER (PARTITION BY performance_id ORDER BY note_id) AS before
  FROM notes WHERE event_type = 'click'),
pr AS (SELECT performance_id, note_id * 2 AS seq, label, CASE WHEN label <> 'insertion' THEN note_id END AS s_id,
    CASE WHEN label <> 'deletion' THEN note_id END AS p_id FROM notes
  UNION ALL SELECT performance_id, note_id * 2 + 1, 'match', note_id, before FROM c
  WHERE k % 5 = 0 AND before IS NOT NULL)"""


@query("initial_pairs", sql("notes", PAIRS + """
SELECT pr.performance_id, pr.seq, CASE
  WHEN label = 'match' AND s.s_id IS NOT NULL AND p.p_id IS NOT NULL AND p.pitch <> s.pitch
    AND NOT ((is_grace OR is_orn) AND abs(p.pitch - s.pitch) <= 2) THEN 'dissolved'
  WHEN label = 'match' AND s.s_id IS NOT NULL AND p.p_id IS NOT NULL THEN 'correct'
  WHEN label = 'interpolated' AND s.s_id IS NOT NULL AND p.p_id IS NOT NULL THEN 'interpolated'
  WHEN label = 'ornament' AND p.p_id IS NOT NULL THEN 'ornament' END AS kind
FROM pr LEFT JOIN s ON s.performance_id = pr.performance_id AND s.s_id = pr.s_id
LEFT JOIN p ON p.performance_id = pr.performance_id AND p.p_id = pr.p_id"""))
def initial_pairs(spark, sf):
    s, p, pairs = correctness_inputs(spark, sf)
    return K.initial_pairs(s, p, pairs, P).select("performance_id", "seq", "kind")


@query("correctness_summary")
def correctness_summary(spark, sf):
    s, p, pairs = correctness_inputs(spark, sf)
    res = K.correctness(s, p, pairs, P, NOTE_CHUNK)
    return K.summary(res.score, res.played, P).join(res.steps, "performance_id", "left")


@query("correctness_bars")
def correctness_bars(spark, sf):
    s, p, pairs = correctness_inputs(spark, sf)
    bars = s.select("performance_id", F.expr("pos_uq div 16000000").alias("measure_idx")
                    ).distinct().select(
        "performance_id", "measure_idx", (F.col("measure_idx") * 16_000_000).alias("start_uq"),
        ((F.col("measure_idx") + 1) * 16_000_000).alias("end_uq"))
    res = K.correctness(s, p, pairs, P, NOTE_CHUNK, window_rule="error")
    res = K.add_bars(res, bars, P, NOTE_CHUNK * 4)
    return K.bar_table(res, bars, P)


@query("label_summary", sql("notes", """
, a AS (SELECT performance_id, count(*) FILTER (label IN ('match', 'deletion') AND k < 90) AS c,
  count(*) FILTER (label = 'match') AS n_correct, count(*) FILTER (label = 'deletion') AS n_missed,
  count(*) FILTER (label = 'insertion') AS n_extra, count(*) FILTER (label = 'interpolated') AS n_interpolated
  FROM notes GROUP BY 1)
SELECT performance_id, n_correct + n_missed AS n_score_notes, n_correct, 0::BIGINT AS n_wrong_pitch, n_missed,
  0::BIGINT AS n_ornament_skipped, n_interpolated, n_correct + n_extra AS n_performed_notes, n_extra,
  0::BIGINT AS n_ornament,
  round(n_correct / nullif(n_correct + n_missed, 0), 9) AS accuracy,
  round((n_missed + n_extra) / nullif(n_correct + n_missed, 0), 9) AS error_rate,
  round(2.0 * n_correct / greatest(1, 2 * n_correct + n_missed + n_extra), 9) AS match_ratio,
  2.0 * n_correct / greatest(1, 2 * n_correct + n_missed + n_extra) < 0.8 AS alignment_suspect FROM a"""))
def label_summary(spark, sf):
    n = notes(spark, sf)
    lab = (F.when(F.col("label") == "match", "correct").when(F.col("label") == "deletion", "missed")
           .when(F.col("label") == "insertion", "extra").otherwise("interpolated"))
    s = n.where("label <> 'insertion'").select("performance_id", lab.alias("label"))
    p = n.where("label <> 'deletion'").select("performance_id", lab.alias("label"))
    return rnd(K.summary(s, p, P), 9, "accuracy", "error_rate", "match_ratio")


LOO = """
, g AS (SELECT performance_id, note_id, pitch, (onset_us // 500000) * 1000000 AS pos_uq, onset_us FROM notes WHERE event_type <> 'signup'),
mate AS (SELECT a.performance_id, a.note_id, quantile_cont(CAST(b.onset_us AS DOUBLE), 0.5) AS mate
  FROM g a JOIN g b ON a.performance_id = b.performance_id AND a.pos_uq = b.pos_uq AND a.note_id <> b.note_id GROUP BY 1, 2),
q AS (SELECT performance_id, pos_uq, quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS med FROM g GROUP BY 1, 2),
kk AS (SELECT *, max(med) OVER (PARTITION BY performance_id ORDER BY pos_uq) AS kt FROM q),
nb AS (SELECT performance_id, pos_uq, lag(pos_uq) OVER w AS p0, lag(kt) OVER w AS k0, lead(pos_uq) OVER w AS p1, lead(kt) OVER w AS k1 FROM kk
  WINDOW w AS (PARTITION BY performance_id ORDER BY pos_uq)),
ex AS (SELECT g.*, coalesce(mate, k0 + (k1 - k0) * (g.pos_uq - p0) / (p1 - p0), k0, k1) AS e
  FROM g JOIN nb USING (performance_id, pos_uq) LEFT JOIN mate USING (performance_id, note_id))"""


@query("same_pitch_reassignment", sql("notes", LOO + """
, fr AS (SELECT performance_id, note_id AS new_id, pitch, onset_us AS nu FROM notes WHERE event_type = 'signup'),
op AS (SELECT ex.performance_id, note_id, new_id, abs(nu - e) - abs(onset_us - e) AS loss FROM ex JOIN fr ON fr.performance_id = ex.performance_id
  AND fr.pitch = ex.pitch WHERE note_id % 7 <> 0 AND abs(nu - e) <= 2000000 AND abs(nu - e) - abs(onset_us - e) < -30000),
ord AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY loss, note_id, new_id) AS i FROM op),
w AS (
  WITH RECURSIVE walk AS (
    SELECT DISTINCT performance_id, 0::BIGINT AS i, []::BIGINT[] AS us, []::BIGINT[] AS up, NULL::BIGINT AS s_id, NULL::BIGINT AS new_id FROM ord
    UNION ALL
    SELECT w.performance_id, o.i, CASE WHEN b THEN w.us ELSE list_append(w.us, o.note_id) END,
      CASE WHEN b THEN w.up ELSE list_concat(w.up, [o.note_id, o.new_id]) END, CASE WHEN b THEN NULL ELSE o.note_id END, CASE WHEN b THEN NULL ELSE o.new_id END
    FROM (SELECT w.*, list_contains(w.us, o.note_id) OR list_contains(w.up, o.note_id) OR list_contains(w.up, o.new_id) AS b
      FROM walk w JOIN ord o ON o.performance_id = w.performance_id AND o.i = w.i + 1) w
    JOIN ord o ON o.performance_id = w.performance_id AND o.i = w.i + 1)
  SELECT performance_id, s_id, new_id FROM walk WHERE s_id IS NOT NULL)
SELECT performance_id, s_id, s_id AS p_id, new_id FROM w"""))
def same_pitch_reassignment(spark, sf):
    n = notes(spark, sf)
    m = n.where("event_type <> 'signup'").select(
        "performance_id", F.col("note_id").alias("s_id"), F.col("note_id").alias("p_id"),
        F.expr("(onset_us div 500000) * 1000000").alias("pos_uq"), "pitch", "onset_us",
        (F.col("note_id") % 7 == 0).alias("frozen"))
    free = n.where("event_type = 'signup'").select(
        "performance_id", F.col("note_id").alias("p_id"), "pitch", "onset_us")
    return M.reassign_same_pitch(m, free, P, NOTE_CHUNK, window_us=2_000_000)


@query("error_pairing_windows", sql("notes", LOO + """
, r AS (SELECT performance_id, pos_uq, max(abs(onset_us - e)) AS r FROM ex GROUP BY 1, 2),
p AS (SELECT DISTINCT performance_id, (onset_us // 500000) * 1000000 AS pos_uq FROM notes),
w AS (SELECT p.*, coalesce(2.0 * max(r) OVER (PARTITION BY performance_id ORDER BY pos_uq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) AS w
  FROM p LEFT JOIN r USING (performance_id, pos_uq))
SELECT performance_id, pos_uq, round(least(greatest(w, 100000), 300000), 3) AS window_us FROM w"""))
def error_pairing_windows(spark, sf):
    n = notes(spark, sf).withColumn("pos_uq", F.expr("(onset_us div 500000) * 1000000"))
    w = K.error_windows(n, n.where("event_type <> 'signup'"), P, "note_id", NOTE_CHUNK)
    return rnd(w, 3, "window_us")


@query("local_onset_error", sql("notes", REF_EST + """
, j AS (SELECT e.performance_id, note_id, r.onset_us AS x, (e.onset_us - r.onset_us - 250000) / 1000.0::DOUBLE AS d FROM r JOIN e USING (performance_id, note_id)),
l AS (SELECT performance_id, CASE WHEN count(*) OVER w >= 5 THEN d - quantile_cont(d, 0.5) OVER w END AS l FROM j
  WINDOW w AS (PARTITION BY performance_id ORDER BY x, note_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)),
m AS (SELECT performance_id, median(l) AS med FROM l GROUP BY 1)
SELECT performance_id, round(sqrt(avg(pow(least(greatest(l, -100), 100), 2))), 6) AS local_rms_ms, round(avg((abs(l) > 30)::INT), 9) AS share_gt30,
  round(quantile_cont(abs(l), 0.9), 6) AS p90_abs_ms, round(1.4826 * median(abs(l - med)), 6) AS local_rsd_ms
FROM l JOIN m USING (performance_id) WHERE l IS NOT NULL GROUP BY 1"""))
def local_onset_error(spark, sf):
    from ritardo.operators.ordered import chunk_of

    r = reference_notes(spark, sf).select("performance_id", "note_id", F.col("onset_us").alias("x"))
    e = estimated_notes(spark, sf).select("performance_id", "note_id", F.col("onset_us").alias("y"))
    d = r.join(e, ["performance_id", "note_id"]).withColumn(
        "d", (F.col("y") - F.col("x") - 250_000) / 1000.0)
    out = J.local_onset_error(d, P, "x", ["x", "note_id"], "d", chunk_of("x", NOTE_CHUNK))
    return rnd(rnd(out, 6, "local_rms_ms", "p90_abs_ms", "local_rsd_ms"), 9, "share_gt30")


@query("placed_marks", sql("bars", """
, mk AS (SELECT score_id, note_id AS mark_id, measure_idx % 12 AS measure, onset_uq - measure_idx * 28000000 AS off FROM score WHERE quantity > 45),
ps AS (SELECT score_id, measure_idx % 12 AS measure, start_uq FROM bars WHERE measure_idx % 12 < 11),
n AS (SELECT DISTINCT score_id, onset_uq FROM score)
SELECT mk.score_id, mk.mark_id, ps.start_uq + mk.off AS pos, CASE WHEN ps.start_uq IS NULL THEN 'unmapped' WHEN n.onset_uq IS NOT NULL THEN 'on_note'
  ELSE 'off_onset' END AS outcome FROM mk LEFT JOIN ps ON ps.score_id = mk.score_id AND ps.measure = mk.measure
LEFT JOIN n ON n.score_id = mk.score_id AND n.onset_uq = ps.start_uq + mk.off"""))
def placed_marks(spark, sf):
    from ritardo.plans.standins import bars

    s = score(spark, sf)
    name = F.col("measure_idx") % 12
    mk = s.where("quantity > 45").select(
        "score_id", F.col("note_id").alias("mark_id"), name.alias("measure"),
        (F.col("onset_uq") - F.col("measure_idx") * 28_000_000).alias("offset"))
    ps = bars(spark, sf).where("measure_idx % 12 < 11").select(
        "score_id", name.alias("measure"), F.col("start_uq").alias("start"))
    return J.place_marks(mk, ps, s.select("score_id", F.col("onset_uq").alias("pos")), ["score_id"])


@query("commonest_offset", sql("score", """
, c AS (SELECT score_id, quantity % 16 AS off, count(*) AS n FROM score GROUP BY 1, 2)
SELECT score_id, off AS offset, n FROM c QUALIFY row_number() OVER (PARTITION BY score_id ORDER BY n DESC, off) = 1"""))
def commonest_offset(spark, sf):
    s = score(spark, sf).withColumn("offset", F.col("quantity") % 16)
    return J.commonest_offset(s, ["score_id"], "offset")
