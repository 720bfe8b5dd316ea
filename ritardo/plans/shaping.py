"""Rendition, curve, phrase and report-section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ritardo.functions import stats as S
from ritardo.functions.draws import uniform_sql
from ritardo.operators import consensus as C
from ritardo.operators import curves as V
from ritardo.operators import joins as J
from ritardo.operators import phrases as H
from ritardo.operators import renditions as G
from ritardo.operators import report as R
from ritardo.operators import sequences as Q
from ritardo.operators import tables as T
from ritardo.plans.consensus import LOO_LIMITS, NOTE_BARS, checked_bars, note_bars, rnd
from ritardo.plans.matching import REF_EST, estimated_notes, reference_notes
from ritardo.plans.registry import query
from ritardo.plans.standins import (
    MICRO, NOTE_CHUNK, SCORE_CHUNK, curves, notes, score, sql, table, takes,
)

P = ["performance_id"]
SC = ["score_id"]


# ------------------------------------------------------------------ renditions

@query("scaled_renditions", sql("notes", """
, l AS (SELECT performance_id, regr_slope(onset_us, note_id) AS b, regr_intercept(onset_us, note_id) AS a, avg(velocity) AS v FROM notes GROUP BY 1),
f AS (SELECT unnest([0.0, 0.5, 2.0]::DOUBLE[]) AS factor)
SELECT performance_id, note_id, factor, round(a + b * note_id + factor * (onset_us - a - b * note_id), 0) AS onset_us,
  least(greatest(round(v + factor * (velocity - v)), 1), 127) AS velocity FROM notes JOIN l USING (performance_id) CROSS JOIN f"""))
def scaled_renditions(spark, sf):
    out = G.scaled_renditions(notes(spark, sf), P, "note_id", "onset_us", "velocity",
                              [0.0, 0.5, 2.0])
    return out.select("performance_id", "note_id", "factor", F.round("onset_us", 0).alias(
        "onset_us"), F.col("velocity").cast("double").alias("velocity"))


@query("deadpan_rendition", sql("score", """
SELECT score_id, note_id, round((onset_uq - min(onset_uq) OVER (PARTITION BY score_id)) * 0.5::DOUBLE, 3) AS onset_us,
  round(duration_uq * 0.5::DOUBLE * 0.95::DOUBLE, 3) AS duration_us, CAST(64 AS BIGINT) AS velocity FROM score"""))
def deadpan_rendition(spark, sf):
    d = G.deadpan(score(spark, sf), SC, 0.5, 64)
    return d.select("score_id", "note_id", F.round("onset_us", 3).alias("onset_us"), F.round(
        "duration_us", 3).alias("duration_us"), F.col("velocity").cast("bigint").alias("velocity"))


@query("articulation_scale", sql("notes", """
, n AS (SELECT *, lead(onset_us) OVER (PARTITION BY performance_id, pitch ORDER BY onset_us, note_id) AS nx,
  CAST(trunc(greatest(20000, duration_us * 4.0)) AS BIGINT) AS d FROM notes)
SELECT performance_id, note_id, least(d, coalesce(greatest(20000, nx - onset_us), d)) AS duration_us FROM n"""))
def articulation_scale(spark, sf):
    return G.articulation_scale(notes(spark, sf), P, 4.0, NOTE_CHUNK).select(
        "performance_id", "note_id", "duration_us")


_Z = ("sqrt(-2.0 * ln(greatest(" + uniform_sql(12, "performance_id", "onset_us", "'a'")
      + ", 1e-12))) * cos(2.0 * pi() * " + uniform_sql(12, "performance_id", "onset_us", "'b'") + ")")


@query("timing_jitter", sql("notes", f"""
, o AS (SELECT DISTINCT performance_id, onset_us FROM notes),
g AS (SELECT *, least(onset_us - lag(onset_us) OVER w, lead(onset_us) OVER w - onset_us) AS gap FROM o
  WINDOW w AS (PARTITION BY performance_id ORDER BY onset_us)),
s AS (SELECT performance_id, onset_us, {_Z} * 50000 AS z, coalesce(gap * 0.45, 0) AS lim FROM g)
SELECT performance_id, note_id, round(onset_us + least(greatest(z, -lim), lim), 3) AS new_onset_us
FROM notes JOIN s USING (performance_id, onset_us)"""))
def timing_jitter(spark, sf):
    out = G.timing_jitter(notes(spark, sf), P, 50_000.0, NOTE_CHUNK, 12)
    return rnd(out.select("performance_id", "note_id", "new_onset_us"), 3, "new_onset_us")


@query("velocity_components", sql("score", """
, k AS (SELECT a.score_id, a.note_id, any_value(a.quantity) AS v, any_value(a.staff) = 1 AS mel,
  sum(exp(-0.5 * pow((b.onset_uq - a.onset_uq) / 7e6, 2))) FILTER (b.staff = 1) AS sm,
  sum(exp(-0.5 * pow((b.onset_uq - a.onset_uq) / 7e6, 2))) FILTER (b.staff = 2) AS sa,
  sum(exp(-0.5 * pow((b.onset_uq - a.onset_uq) / 7e6, 2)) * b.quantity) FILTER (b.staff = 1) AS vm,
  sum(exp(-0.5 * pow((b.onset_uq - a.onset_uq) / 7e6, 2)) * b.quantity) FILTER (b.staff = 2) AS va
  FROM score a JOIN score b ON a.score_id = b.score_id GROUP BY 1, 2),
m AS (SELECT score_id, avg(quantity) AS m FROM score GROUP BY 1),
g AS (SELECT score_id, note_id, v, mel, CASE WHEN sm > 1e-3 AND sa > 1e-3 THEN vm / sm - va / sa ELSE 0 END AS gap,
  CASE WHEN sm > 1e-3 AND sa > 1e-3 THEN sm / (sm + sa) ELSE 0 END AS pm FROM k)
SELECT score_id, note_id, round(gap, 6) AS gap, round(CASE WHEN mel THEN (1 - pm) * gap ELSE -pm * gap END, 6) AS voicing,
  round(v - m - CASE WHEN mel THEN (1 - pm) * gap ELSE -pm * gap END, 6) AS dynamics FROM g JOIN m USING (score_id)"""))
def velocity_components(spark, sf):
    s = score(spark, sf).withColumn("melody", F.col("staff") == 1)
    d = G.velocity_components(s, SC, "onset_uq", "quantity", "melody", 7 * MICRO, SCORE_CHUNK)
    return d.select("score_id", "note_id", F.round("gap", 6).alias("gap"), F.round("V", 6).alias(
        "voicing"), F.round("D", 6).alias("dynamics"))


@query("injected_mistakes", sql("notes", """
, d AS (SELECT performance_id, note_id, row_number() OVER (PARTITION BY performance_id ORDER BY
    -ln(greatest(""" + uniform_sql(21, "note_id") + """, 1e-12)) / velocity, note_id) AS r,
  count(*) OVER (PARTITION BY performance_id) AS n, """ + uniform_sql(22, "note_id") + """ AS u2 FROM notes),
k AS (SELECT *, CAST(round(n * 0.1) AS BIGINT) AS k FROM d),
c AS (SELECT *, k // 3 + CASE WHEN k % 3 >= 1 THEN 1 ELSE 0 END AS c1, k // 3 + CASE WHEN k % 3 >= 2 THEN 1 ELSE 0 END AS c2 FROM k),
l AS (SELECT *, CASE WHEN r <= c1 THEN 'wrong_pitch' WHEN r <= c1 + c2 THEN 'missed' WHEN r <= k THEN 'extra' ELSE 'correct' END AS mistake FROM c)
SELECT performance_id, note_id, mistake, CASE WHEN mistake = 'wrong_pitch' THEN [1, -1, 2, -2, 12, -12][CAST(floor(u2 * 6) AS INT) + 1] ELSE 0 END AS delta FROM l"""))
def injected_mistakes(spark, sf):
    out = G.inject_mistakes(notes(spark, sf), P, 0.1, 21, weight="velocity")
    return out.select("performance_id", "note_id", "mistake", "delta")


# ------------------------------------------------------------------ curves and references

@query("smoothed_curves")
def smoothed_curves(spark, sf):
    e = table(spark, sf, "embeddings")
    s = e.select("vec_id", "label", F.posexplode(V.smooth_curve(F.col("embedding").cast(
        "array<double>"), 8.0)).alias("beat", "smooth"))
    return rnd(s, 9, "smooth")


@query("component_shares")
def component_shares(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("piece_id"), "embedding")
    c = V.component_shares(e, "piece_id", "embedding", 64)
    return c.select("piece_id", "k", F.round(F.get("ratios", 0), 9).alias("first_share"))


@query("majority_score_references", sql("takes", """
, p AS (SELECT performance_id, performer_id, status, CASE WHEN tier <= 2 THEN 'sensor' ELSE 'transcribed' END AS prov FROM takes),
n AS (SELECT performer_id, status, count(*) AS n, count(*) FILTER (prov = 'sensor') AS ns FROM p GROUP BY 1, 2),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY performer_id ORDER BY n DESC, status) = 1)
SELECT p.performance_id, p.performer_id, p.status FROM p JOIN b USING (performer_id, status) WHERE b.n >= 8 OR b.ns >= 3"""))
def majority_score_references(spark, sf):
    t = takes(spark, sf).withColumn("provenance", F.when(F.col("tier") <= 2, "sensor").otherwise(
        "transcribed"))
    return V.majority_score(t, "performer_id", "status", min_perfs=8, min_sensor=3).select(
        "performance_id", "performer_id", "status")


@query("capped_references", sql("takes", """
, p AS (SELECT performance_id, performer_id % 1009 AS source_id, year, CASE WHEN tier = 1 THEN 'sensor' ELSE 'transcribed' END AS prov FROM takes),
x AS (SELECT * FROM p WHERE performance_id NOT IN (SELECT doc_id FROM labels) AND source_id NOT IN (SELECT doc_id FROM labels))
SELECT performance_id, year FROM x"""))
def capped_references(spark, sf):
    t = takes(spark, sf).select(
        "performance_id", "year", (F.col("performer_id") % 1009).alias("source_id"),
        F.when(F.col("tier") == 1, "sensor").otherwise("transcribed").alias("provenance"))
    held = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    # all references count; the capped draw stays available as an operator
    return V.exclude_references(t, held).select("performance_id", "year")


# ------------------------------------------------------------------ markings and boundaries

@query("dynamics_columns", sql("score", """
, lv AS (SELECT score_id, onset_uq AS start, max(staff) AS level FROM score WHERE quantity = 50 GROUP BY 1, 2),
hp AS (SELECT score_id, onset_uq AS s, onset_uq + duration_uq * 10 AS e FROM score WHERE quantity IN (48, 49)),
a AS (SELECT s.score_id, s.note_id, s.onset_uq, coalesce(lv.level, 0) AS level FROM score s ASOF LEFT JOIN lv
  ON lv.score_id = s.score_id AND s.onset_uq >= lv.start),
r AS (SELECT p.score_id, p.onset_uq, max((p.onset_uq - s) / (e - s)) AS ramp FROM (SELECT DISTINCT score_id, onset_uq FROM score) p
  JOIN hp ON hp.score_id = p.score_id AND p.onset_uq BETWEEN s AND e GROUP BY 1, 2)
SELECT a.score_id, a.note_id, a.level, round(coalesce(ramp, 0), 9) AS ramp, ramp IS NOT NULL AS inside
FROM a LEFT JOIN r USING (score_id, onset_uq)"""))
def dynamics_columns(spark, sf):
    s = score(spark, sf)
    lv = s.where("quantity = 50").groupBy("score_id", F.col("onset_uq").alias("start")).agg(
        F.max("staff").alias("level"))
    hp = s.where("quantity in (48, 49)").select("score_id", F.col("onset_uq").alias("start"), (
        F.col("onset_uq") + F.col("duration_uq") * 10).alias("end"))
    d = H.dynamics(s.select("score_id", "note_id", "onset_uq"), lv, hp, SC, "onset_uq",
                   SCORE_CHUNK)
    return rnd(d.select("score_id", "note_id", "level", "ramp", "inside"), 9, "ramp")


@query("greedy_phrase_ends", sql("notes", """
, c AS (SELECT performance_id, onset_us AS pos, value, row_number() OVER (PARTITION BY performance_id ORDER BY value DESC, onset_us) AS i FROM notes),
w AS (
  WITH RECURSIVE walk AS (
    SELECT DISTINCT performance_id, 0::BIGINT AS i, []::BIGINT[] AS acc, NULL::BIGINT AS pos FROM c
    UNION ALL
    SELECT w.performance_id, c.i, CASE WHEN len(list_filter(w.acc, lambda x: abs(x - c.pos) < 2000000)) = 0
        THEN list_append(w.acc, c.pos) ELSE w.acc END,
      CASE WHEN len(list_filter(w.acc, lambda x: abs(x - c.pos) < 2000000)) = 0 THEN c.pos END
    FROM walk w JOIN c ON c.performance_id = w.performance_id AND c.i = w.i + 1)
  SELECT performance_id, pos FROM walk WHERE pos IS NOT NULL)
SELECT * FROM w"""))
def greedy_phrase_ends(spark, sf):
    c = notes(spark, sf).select("performance_id", F.col("onset_us").alias("pos"), "value")
    return H.greedy_peaks(c, P, "pos", "value", 2_000_000).select("performance_id", "pos")


@query("beat_map_offsets", sql("score", """
, seg AS (SELECT DISTINCT score_id, onset_uq AS pos, (onset_uq // 400000000) * 1000000 AS off FROM score),
pt AS (SELECT score_id, note_id, onset_uq + CASE WHEN staff = 1 THEN 500000 ELSE 0 END AS q FROM score),
lo AS (SELECT pt.*, seg.pos AS p0, seg.off AS o0 FROM pt ASOF LEFT JOIN seg ON pt.score_id = seg.score_id AND pt.q >= seg.pos),
hi AS (SELECT lo.*, seg.off AS o1 FROM lo ASOF LEFT JOIN seg ON lo.score_id = seg.score_id AND lo.q < seg.pos)
SELECT score_id, note_id, CASE WHEN p0 = q OR o0 = o1 THEN q + o0 END AS ref_pos FROM hi"""))
def beat_map_offsets(spark, sf):
    s = score(spark, sf)
    seg = s.select("score_id", F.col("onset_uq").alias("pos"), F.expr(
        "(onset_uq div 400000000) * 1000000").alias("offset")).distinct()
    pt = s.select("score_id", "note_id", F.expr(
        "onset_uq + case when staff = 1 then 500000 else 0 end").alias("q"))
    return H.beat_map(pt, seg, SC, "q", SCORE_CHUNK).select("score_id", "note_id", "ref_pos")


@query("accent_excess", sql("notes", """
SELECT a.performance_id, a.note_id, round(a.velocity - median(b.velocity), 6) AS excess FROM notes a LEFT JOIN notes b
  ON a.performance_id = b.performance_id AND b.event_type <> 'signup' AND abs(a.onset_us - b.onset_us) <= 1000000
WHERE a.event_type = 'signup' GROUP BY 1, 2, a.velocity"""))
def accent_excess(spark, sf):
    n = notes(spark, sf).withColumn("marked", F.col("event_type") == "signup")
    out = H.accent_excess(n, P, "onset_us", "velocity", "marked", 1_000_000, NOTE_CHUNK)
    return rnd(out.select("performance_id", "note_id", "excess"), 6, "excess")


@query("snapped_events", sql("notes", """
, on_ AS (SELECT DISTINCT performance_id, onset_us AS o FROM notes WHERE event_type IN ('view', 'click')),
ev AS (SELECT performance_id, note_id, onset_us - onset_us % 500000 AS x FROM notes WHERE event_type NOT IN ('view', 'click')),
lo AS (SELECT ev.*, on_.o AS lo FROM ev ASOF LEFT JOIN on_ ON on_.performance_id = ev.performance_id AND ev.x >= on_.o),
hi AS (SELECT lo.*, on_.o AS hi FROM lo ASOF LEFT JOIN on_ ON on_.performance_id = lo.performance_id AND lo.x < on_.o),
n AS (SELECT *, CASE WHEN hi IS NULL OR x - lo <= hi - x THEN lo ELSE hi END AS nr FROM hi)
SELECT performance_id, note_id, CASE WHEN abs(nr - x) <= 200000 THEN nr ELSE x END AS snapped_pos,
  CASE WHEN nr = x THEN 'exact' WHEN abs(nr - x) <= 200000 THEN 'snapped' ELSE 'far' END AS outcome FROM n"""))
def snapped_events(spark, sf):
    n = notes(spark, sf)
    on = n.where("event_type in ('view', 'click')").select("performance_id", F.col(
        "onset_us").alias("onset"))
    ev = n.where("event_type not in ('view', 'click')").select(
        "performance_id", "note_id", F.expr("onset_us - onset_us % 500000").alias("x"))
    return H.snap_events(ev, on, P, "x", 200_000, NOTE_CHUNK).select(
        "performance_id", "note_id", "snapped_pos", "outcome")


@query("split_long_phrases", sql("notes", """
, s AS (SELECT DISTINCT performance_id, onset_us AS start FROM notes WHERE k < 20),
e AS (SELECT performance_id, max(onset_us) + 1000000 AS e FROM notes GROUP BY 1),
l AS (SELECT performance_id, start, coalesce(lead(start) OVER (PARTITION BY performance_id ORDER BY start), e) - start AS len
  FROM s JOIN e USING (performance_id)),
n AS (SELECT *, greatest(1, CAST(ceil(len / 1500000.0) AS BIGINT)) AS n FROM l)
SELECT performance_id, start + CAST(floor(i * len / n) AS BIGINT) AS start FROM (SELECT *, unnest(range(n)) AS i FROM n)"""))
def split_long_phrases(spark, sf):
    n = notes(spark, sf)
    st = n.where("k < 20").select("performance_id", F.col("onset_us").alias("start")).distinct()
    e = n.groupBy("performance_id").agg((F.max("onset_us") + 1_000_000).alias("end"))
    return H.split_long_phrases(st, P, e, 1_500_000, NOTE_CHUNK)


@query("phrase_anchors", sql("score", """
, a AS (SELECT DISTINCT score_id, regexp_replace(note_id, '-\\d+$', '') AS base FROM score WHERE quantity > 45)
SELECT DISTINCT s.score_id, s.onset_uq FROM score s JOIN a ON a.score_id = s.score_id
  AND a.base = regexp_replace(s.note_id, '-\\d+$', '')"""))
def phrase_anchors(spark, sf):
    s = score(spark, sf)
    return T.anchored_onsets(s, SC, s.where("quantity > 45"))


@query("channel_observations", sql("score", """
, l AS (SELECT score_id, regr_slope(price, onset_uq / 1e6) AS period FROM score GROUP BY 1)
SELECT score_id, note_id, round(least(greatest(ln(quantity / (duration_uq / 1e6 * abs(period))), -3), 3), 6) AS articulation,
  round(CAST(quantity AS DOUBLE), 6) AS velocity FROM score JOIN l USING (score_id)"""))
def channel_observations(spark, sf):
    s = T.log_articulation(score(spark, sf), SC, "quantity", F.col("onset_uq") / 1e6, "price",
                           F.col("duration_uq") / 1e6)
    return s.select("score_id", "note_id", F.round("articulation", 6).alias("articulation"),
                    F.col("quantity").cast("double").alias("velocity"))


# ------------------------------------------------------------------ report sections

ERR = """, er AS (SELECT event_type AS piece_id, performance_id, onset_us // 5000000 AS bar,
  CASE WHEN k < 80 THEN 'wrong_pitch' WHEN k < 92 THEN 'missed' ELSE 'extra' END || ':' || pitch AS key FROM notes WHERE k >= 70)"""


@query("recurring_errors", sql("notes", ERR + """
, t AS (SELECT piece_id, bar, key, count(DISTINCT performance_id) AS n_takes FROM er
  WHERE performance_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1, 2, 3 HAVING count(DISTINCT performance_id) >= 2),
x AS (SELECT piece_id, bar, key FROM er WHERE performance_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  GROUP BY 1, 2, 3 HAVING count(DISTINCT performance_id) >= 2)
SELECT t.* FROM t ANTI JOIN x USING (piece_id, bar, key)"""))
def recurring_errors(spark, sf):
    kind = F.when(F.col("k") < 80, "wrong_pitch").when(F.col("k") < 92, "missed").otherwise("extra")
    e = notes(spark, sf).where("k >= 70").select(
        F.col("event_type").alias("piece_id"), "performance_id",
        F.expr("onset_us div 5000000").alias("bar"),
        F.concat_ws(":", kind, F.col("pitch").cast("string")).alias("key"))
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias(
        "performance_id"))
    return R.recurring_errors(
        e.join(good, "performance_id", "left_anti"), ["piece_id", "bar"], "key", "performance_id",
        experts=e.join(good, "performance_id", "left_semi"))


@query("expert_check_status", sql("notes", LOO_LIMITS + """
, g AS (SELECT *, greatest(CASE WHEN n_wrong_pitch > 2 THEN 2 WHEN n_wrong_pitch > 1 THEN 1 ELSE 0 END,
  CASE WHEN rate IS NULL THEN 0 WHEN rate > 0.5 THEN 2 WHEN rate > 0.25 THEN 1 ELSE 0 END) AS gr FROM ti)
SELECT piece_id, performance_id, measure_idx, CASE WHEN n_score_notes > 0 AND n_missed / n_score_notes >= 0.8 THEN 'not_heard'
  WHEN gr = 0 THEN 'none' WHEN n_experts < 5 THEN 'unchecked' WHEN gr = tr THEN 'confirmed' WHEN tr = 0 THEN 'suppressed'
  ELSE 'down_tiered' END AS status FROM g"""))
def expert_check_status(spark, sf):
    b = checked_bars(spark, sf)
    g, _ = C.correctness_tier(F.col("n_wrong_pitch"), F.col("n_missed") + F.col("n_extra"),
                              F.col("n_score_notes"))
    lost = (F.col("n_score_notes") > 0) & (F.col("n_missed") / F.col("n_score_notes") >= 0.8)
    return b.select("piece_id", "performance_id", "measure_idx", R.check_status(
        g, F.col("tier"), F.col("n_experts"), lost).alias("status"))


@query("false_alarm_shares", sql("notes", LOO_LIMITS + """
SELECT piece_id, count(*) AS n_bars, round(avg((tr >= 1)::INT), 9) AS share_notable, round(avg((tr = 2)::INT), 9) AS share_strong
FROM ti WHERE n_score_notes > 0 GROUP BY 1"""))
def false_alarm_shares(spark, sf):
    b = checked_bars(spark, sf).where("n_score_notes > 0")
    r = S.tier_rank(F.col("tier"))
    return b.groupBy("piece_id").agg(
        F.count("*").alias("n_bars"), F.round(F.avg((r >= 1).cast("int")), 9).alias(
            "share_notable"), F.round(F.avg((r == 2).cast("int")), 9).alias("share_strong"))


@query("recall_by_repeat_gap", sql("notes", """
, g AS (SELECT *, onset_us - lag(onset_us) OVER (PARTITION BY performance_id, pitch ORDER BY onset_us, note_id) AS gap FROM notes),
b AS (SELECT event_type IN ('view', 'click', 'purchase') AS hit, velocity > 50 AS loud, CASE WHEN gap IS NULL OR gap >= 10000000 THEN 3 WHEN gap < 1000000 THEN 0
  WHEN gap < 4000000 THEN 1 ELSE 2 END AS bin FROM g),
r AS (SELECT loud, bin, count(*) AS n, avg(hit::INT) AS recall FROM b GROUP BY 1, 2)
SELECT loud, CAST(r.bin AS BIGINT) AS bin, n, round(recall, 9) AS recall, round(x.ref - recall, 9) AS drop
FROM r LEFT JOIN (SELECT loud, recall AS ref FROM r WHERE bin = 3) x USING (loud)"""))
def recall_by_repeat_gap(spark, sf):
    from ritardo.operators.ordered import chunk_of, scan

    n = scan(notes(spark, sf), [*P, "pitch"], ["onset_us", "note_id"],
             chunk_of("onset_us", NOTE_CHUNK), before=("prev", "onset_us"))
    n = n.withColumns({"gap": F.col("onset_us") - F.col("before"), "loud": F.col("velocity") > 50,
                       "hit": F.col("event_type").isin("view", "click", "purchase")})
    return rnd(R.recall_by_bin(n, ["loud"], "gap", [1e6, 4e6, 10e6], "hit"), 9, "recall", "drop")


@query("outcomes_by_density", sql("notes", """
, c AS (SELECT DISTINCT performance_id, onset_us FROM notes),
g AS (SELECT *, lead(onset_us) OVER (PARTITION BY performance_id ORDER BY onset_us) - onset_us AS gap FROM c),
l AS (SELECT performance_id, onset_us, quantile_cont(CAST(gap AS DOUBLE), 0.5) OVER (PARTITION BY performance_id ORDER BY onset_us
  ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS ioi FROM g)
SELECT CASE WHEN ioi IS NULL THEN 'none' WHEN ioi < 150000 THEN 'fast' WHEN ioi < 400000 THEN 'medium' ELSE 'slow' END AS density,
  label, count(*) AS n FROM notes JOIN l USING (performance_id, onset_us) GROUP BY 1, 2"""))
def outcomes_by_density(spark, sf):
    return T.outcomes_by_density(notes(spark, sf), P, NOTE_CHUNK, [
        ("fast", 150_000), ("medium", 400_000)], "slow")


@query("event_note_rows", sql("notes", REF_EST + """
, s AS (SELECT performance_id, onset_us // 500000 AS ev, pitch, note_id AS s_id, row_number() OVER (PARTITION BY performance_id,
  onset_us // 500000, pitch ORDER BY note_id) AS r FROM r),
p AS (SELECT performance_id, CAST(floor((onset_us - 250000) / 500000) AS BIGINT) AS ev, pitch, note_id AS p_id, row_number() OVER (PARTITION BY performance_id,
  CAST(floor((onset_us - 250000) / 500000) AS BIGINT), pitch ORDER BY note_id) AS r FROM e)
SELECT performance_id, ev AS event, CASE WHEN p_id IS NULL THEN 'deletion' WHEN s_id IS NULL THEN 'insertion' ELSE 'match' END AS label,
  s_id, p_id FROM s FULL JOIN p USING (performance_id, ev, pitch, r)"""))
def event_note_rows(spark, sf):
    s = reference_notes(spark, sf).withColumn("event", F.expr("onset_us div 500000"))
    p = estimated_notes(spark, sf).withColumn(
        "event", F.expr("cast(floor((onset_us - 250000) / 500000) as bigint)"))
    return J.event_note_rows(s, p, P, "event")


@query("chosen_reading", sql("notes", """
, rd AS (SELECT performance_id, event_type AS reading, count(*) AS n_score, count(*) FILTER (k < 60) AS n_match FROM notes GROUP BY 1, 2),
pl AS (SELECT performance_id, count(*) // 4 AS n_played FROM notes GROUP BY 1),
t AS (SELECT * FROM rd JOIN pl USING (performance_id)),
d AS (SELECT performance_id, reading, 2 * n_match / (n_score + n_played) AS dice FROM t)
SELECT performance_id, reading, round(dice, 9) AS dice FROM d QUALIFY row_number() OVER (PARTITION BY performance_id ORDER BY dice DESC, reading) = 1"""))
def chosen_reading(spark, sf):
    n = notes(spark, sf)
    rd = n.groupBy("performance_id", F.col("event_type").alias("reading")).agg(
        F.count("*").alias("n_score"), F.count(F.when(F.col("k") < 60, 1)).alias("n_match"))
    pl = n.groupBy("performance_id").agg(F.expr("count(*) div 4").alias("n_played"))
    return rnd(J.choose_reading(rd.drop("n_match").join(pl, "performance_id"), rd.select(
        "performance_id", "reading", "n_match"), P), 9, "dice")


@query("logistic_detection")
def logistic_detection(spark, sf):
    from ritardo.operators.models import logistic_fit

    n = notes(spark, sf).select(
        "performance_id", (F.col("k") / 100).alias("level"), (F.col("velocity") / 127).alias(
            "loudness"), (F.col("value") > 50).cast("double").alias("y"))
    return rnd(logistic_fit(n, ["level", "loudness"], "y", "performance_id"), 6, "coef", "se")


@query("heldout_reconstruction")
def heldout_reconstruction(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("piece_id"), "vec_id",
                                              "embedding")
    return rnd(V.heldout_r2_curve(e, "piece_id", "vec_id", "embedding", 64, [0, 1, 2, 4, 8], seed=3
                                  ), 6, "r2")


@query("structural_coherence")
def structural_coherence(spark, sf):
    from ritardo.operators.models import coherence

    n = notes(spark, sf).withColumns({
        "block": F.expr("onset_us div 1000000"), "ln_value": F.ln(F.col("value") + 1)})
    return rnd(coherence(n, P, "block", ["velocity", "k", "ln_value"], "value"), 6, "r2")


@query("gross_outliers", sql("notes", """
, b AS (SELECT performance_id, note_id AS pos, onset_us AS t FROM notes),
i AS (SELECT *, row_number() OVER (PARTITION BY performance_id ORDER BY pos) AS i, count(*) OVER (PARTITION BY performance_id) AS n FROM b),
s AS (SELECT unnest([-1, 1]) AS side),
c AS (SELECT a.performance_id, a.pos, a.t, a.n, s.side, x.pos AS xp, x.t AS xt, abs(x.pos - a.pos) <= 400 AS near, abs(x.i - a.i) <= 3 AS close
  FROM i a CROSS JOIN s JOIN i x ON x.performance_id = a.performance_id AND sign(x.pos - a.pos) = s.side AND (abs(x.pos - a.pos) <= 400 OR abs(x.i - a.i) <= 3)),
u AS (SELECT *, count(*) FILTER (near) OVER w >= 3 AS many FROM c WINDOW w AS (PARTITION BY performance_id, pos, side)),
m AS (SELECT * FROM u WHERE CASE WHEN many THEN near ELSE close END),
k AS (SELECT performance_id, pos, side FROM m GROUP BY 1, 2, 3 HAVING count(*) >= 3),
sl AS (SELECT p.performance_id, p.pos, p.side, quantile_cont((q.xt - p.xt) / (q.xp - p.xp), 0.5) AS s FROM m p JOIN k USING (performance_id, pos, side)
  JOIN m q ON q.performance_id = p.performance_id AND q.pos = p.pos AND q.side = p.side AND q.xp > p.xp GROUP BY 1, 2, 3),
pr AS (SELECT m.performance_id, m.pos, any_value(m.t) AS t, m.side, any_value(s) AS s, quantile_cont(xt - s * xp, 0.5) + any_value(s) * m.pos AS p FROM m
  JOIN sl ON sl.performance_id = m.performance_id AND sl.pos = m.pos AND sl.side = m.side WHERE s > 0 GROUP BY m.performance_id, m.pos, m.side),
o AS (SELECT performance_id, pos, bool_and(abs(t - p) > tol) AS out FROM (SELECT *, greatest(150000.0, 500000.0 * median(s) OVER w)
  * CASE WHEN count(*) OVER w = 1 THEN 2 ELSE 1 END AS tol FROM pr WINDOW w AS (PARTITION BY performance_id, pos)) GROUP BY 1, 2)
SELECT i.performance_id, i.pos, i.n >= 6 AND coalesce(out, false) AS gross FROM i LEFT JOIN o USING (performance_id, pos)"""))
def gross_outliers(spark, sf):
    b = notes(spark, sf).select("performance_id", F.col("note_id").alias("pos"), F.col(
        "onset_us").alias("time"))
    return Q.gross_outliers(b, P, 400, 4096).select("performance_id", "pos", "gross")


# ------------------------------------------------------------------ summaries

@query("mismatch_bootstrap", sql("score", """
, st AS (SELECT score_id, count(*) FILTER ((staff = 1) <> (pitch >= 60)) AS num, count(*) AS den FROM score GROUP BY 1),
ix AS (SELECT *, row_number() OVER (ORDER BY """ + uniform_sql(0, "score_id") + """, score_id) - 1 AS idx, count(*) OVER () AS kk FROM st),
b AS (SELECT unnest(range(200)) AS b),
d AS (SELECT b.b, CAST(floor(""" + uniform_sql(31, "b.b", "ix.idx") + """ * kk) AS BIGINT) AS idx FROM b CROSS JOIN ix),
r AS (SELECT d.b, sum(num) / sum(den) AS v FROM d JOIN ix USING (idx) GROUP BY 1)
SELECT 'mismatch' AS metric, round((SELECT sum(num) / sum(den) FROM st), 9) AS estimate, round(quantile_cont(v, 0.025), 9) AS low,
  round(quantile_cont(v, 0.975), 9) AS high, CAST(0 AS BIGINT) AS n_failed FROM r"""))
def mismatch_bootstrap(spark, sf):
    from ritardo.functions.keys import pitch_split_hand, staff_hand
    from ritardo.operators.resampling import bootstrap_ci

    bad = staff_hand(F.col("staff")) != pitch_split_hand(F.col("pitch"))
    st = score(spark, sf).groupBy("score_id").agg(
        F.count(F.when(bad, 1)).alias("num"), F.count("*").alias("den"))
    out = bootstrap_ci(st, "score_id", ["num", "den"], {"mismatch": F.col("num") / F.col("den")},
                       n_boot=200, seed=31)
    return rnd(out, 9, "estimate", "low", "high")


@query("take_rows", sql("notes", NOTE_BARS + """
SELECT piece_id, performance_id, sum(n_score_notes)::BIGINT AS n_score_notes,
  round((sum(n_score_notes) - sum(n_wrong_pitch) - sum(n_missed)) / nullif(sum(n_score_notes), 0), 9) AS accuracy,
  count(*) FILTER (n_wrong_pitch + n_missed + n_extra > 0) AS n_bars_with_errors FROM nb GROUP BY 1, 2"""))
def take_rows(spark, sf):
    return rnd(R.take_rows(note_bars(spark, sf), ["piece_id", "performance_id"]), 9, "accuracy")


@query("takes_with_errors_per_bar", sql("notes", NOTE_BARS + """
SELECT piece_id, measure_idx, count(*) AS n_takes, count(*) FILTER (n_wrong_pitch + n_missed + n_extra > 0) AS n_with_errors
FROM nb GROUP BY 1, 2"""))
def takes_with_errors_per_bar(spark, sf):
    err = F.col("n_wrong_pitch") + F.col("n_missed") + F.col("n_extra") > 0
    return note_bars(spark, sf).groupBy("piece_id", "measure_idx").agg(
        F.count("*").alias("n_takes"), F.count(F.when(err, 1)).alias("n_with_errors"))


@query("shape_and_amplitude", sql("curves", """
, s AS (SELECT piece_id, beat, sum(x) AS s, count(*) AS n FROM curves GROUP BY 1, 2),
l AS (SELECT c.*, (s - x) / (n - 1) AS loo FROM curves c JOIN s USING (piece_id, beat) WHERE n > 1)
SELECT piece_id, performance_id, round(corr(x, loo), 9) AS shape_r, round(stddev_pop(x) / stddev_pop(loo), 9) AS amplitude,
  round(1 - sum((x - loo) * (x - loo)) / (var_pop(x) * count(*)), 6) AS r2 FROM l GROUP BY 1, 2"""))
def shape_and_amplitude(spark, sf):
    d = C.loo_mean(curves(spark, sf), ["piece_id", "beat"], "x").where("loo_mean is not null")
    x, m = F.col("x"), F.col("loo_mean")
    return d.groupBy("piece_id", "performance_id").agg(
        F.round(S.pearson(x, m), 9).alias("shape_r"),
        F.round(F.stddev_pop(x) / F.stddev_pop(m), 9).alias("amplitude"),
        F.round(S.r2(x, m), 6).alias("r2"))


@query("tempo_summary", sql("curves", """
, p AS (SELECT piece_id, performance_id, exp(x) AS period FROM curves),
g AS (SELECT *, ln(period) - avg(ln(period)) OVER (PARTITION BY performance_id) AS lr FROM p)
SELECT piece_id, performance_id, count(*) AS n_beats, round(60 / exp(avg(ln(period))), 6) AS tempo_bpm,
  round(stddev_pop(lr), 9) AS log_sd, round(quantile_cont(lr, 0.9) - quantile_cont(lr, 0.1), 9) AS log_range FROM g GROUP BY 1, 2"""))
def tempo_summary(spark, sf):
    c = curves(spark, sf).withColumn("period", F.exp("x"))
    return rnd(rnd(Q.tempo_summary(c, ["piece_id", "performance_id"], "period"), 9, "log_sd",
                   "log_range"), 6, "tempo_bpm")


@query("covered_level_selection", sql("takes", """
, m AS (SELECT performance_id, performer_id AS piece_id, tier, price / 500000 AS coverage FROM takes),
k AS (SELECT * FROM m WHERE coverage >= 0.85),
s AS (SELECT piece_id FROM k GROUP BY 1 HAVING count(DISTINCT tier) >= 2)
SELECT performance_id, piece_id, tier FROM k WHERE piece_id IN (SELECT piece_id FROM s)"""))
def covered_level_selection(spark, sf):
    from ritardo.operators.resampling import shared_levels

    t = takes(spark, sf).select("performance_id", F.col("performer_id").alias("piece_id"), "tier", (
        F.col("price") / 500000).alias("coverage"))
    return shared_levels(t.where("coverage >= 0.85"), "piece_id", "tier", 2).drop("coverage")
