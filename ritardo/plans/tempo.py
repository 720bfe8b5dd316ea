"""Tempo queries: score positions, breaks, smooth time maps and beats of every performance."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ritardo.operators import tempo as T
from ritardo.plans.registry import query
from ritardo.plans.standins import MICRO, NOTE_CHUNK, notes, sql
from ritardo.session import cut_lineage

P = ["performance_id"]
WIN, WIDTH, PERIOD = 6 * MICRO, 64 * MICRO, 6.0


def _notes(spark, sf):
    """Half a second is a beat; notes are onsets of the beat they fall into."""
    return notes(spark, sf).withColumn("pos", F.expr("(onset_us div 500000) * 1000000"))


def _marks(spark, sf):
    n = _notes(spark, sf)
    kind = F.when((F.col("label") == "deletion") & (F.col("k") % 10 == 0), "fermata").when(
        (F.col("label") == "interpolated") & (F.col("k") % 7 == 0), "tempo_marking")
    return n.select(*P, "pos", kind.alias("kind")).where("kind is not null").distinct()


POS_SQL = """
, n2 AS (SELECT *, (onset_us // 500000) * 1000000 AS pos FROM notes),
pos AS (SELECT performance_id, pos, quantile_cont(CAST(onset_us AS DOUBLE), 0.5) AS time,
  count(*) AS n_notes, max(onset_us) - min(onset_us) AS spread FROM n2 GROUP BY 1, 2)"""

BREAKS_SQL = POS_SQL + """
, g0 AS (SELECT *, lead(pos) OVER w - pos AS db, lead(time) OVER w - time AS ioi,
  lead(pos) OVER w + pos AS mid2 FROM pos WINDOW w AS (PARTITION BY performance_id ORDER BY pos)),
gr AS (SELECT *, ioi / db AS rate FROM g0 WHERE db IS NOT NULL),
gm AS (SELECT a.performance_id, a.pos, a.ioi, a.db,
  CASE WHEN count(b.rate) >= 2 THEN quantile_cont(b.rate, 0.5) END AS med
  FROM gr a LEFT JOIN gr b ON a.performance_id = b.performance_id AND a.pos <> b.pos
    AND b.mid2 BETWEEN a.mid2 - 12000000 AND a.mid2 + 12000000 GROUP BY 1, 2, 3, 4),
mk AS (SELECT DISTINCT performance_id, pos, CASE WHEN label = 'deletion' THEN 'fermata'
    ELSE 'tempo_marking' END AS kind FROM n2
  WHERE (label = 'deletion' AND k % 10 = 0) OR (label = 'interpolated' AND k % 7 = 0)),
ends AS (SELECT performance_id, min(pos) AS lo, max(pos) AS hi FROM pos GROUP BY 1),
br AS (SELECT performance_id, pos, type, min(kind) AS kind FROM (
  SELECT performance_id, pos, 'pause' AS kind, 'gap' AS type FROM gm
    WHERE ioi >= 2.5 * med * db AND ioi - med * db >= 300000
  UNION ALL SELECT mk.performance_id, max(p.pos), 'fermata', 'gap' FROM mk JOIN pos p
    ON p.performance_id = mk.performance_id AND p.pos <= mk.pos JOIN ends e
    ON e.performance_id = mk.performance_id WHERE mk.kind = 'fermata'
    GROUP BY mk.performance_id, mk.pos HAVING max(p.pos) < max(e.hi)
  UNION ALL SELECT mk.performance_id, min(p.pos), 'tempo_marking', 'kink' FROM mk JOIN pos p
    ON p.performance_id = mk.performance_id AND p.pos >= mk.pos JOIN ends e
    ON e.performance_id = mk.performance_id WHERE mk.kind = 'tempo_marking'
    GROUP BY mk.performance_id, mk.pos HAVING min(p.pos) < max(e.hi) AND min(p.pos) > max(e.lo))
  GROUP BY 1, 2, 3)"""

FIT_SQL = BREAKS_SQL + """
, b1 AS (SELECT performance_id, pos, bool_or(type = 'gap') AS gap, bool_or(type = 'kink') AS kink
  FROM br GROUP BY 1, 2),
p1 AS (SELECT pos.*, coalesce(gap, false) AS gap, coalesce(kink, false) AS kink FROM pos
  LEFT JOIN b1 USING (performance_id, pos)),
p2 AS (SELECT *, coalesce(lag(gap) OVER (PARTITION BY performance_id ORDER BY pos), false) AS pg
  FROM p1),
p3 AS (SELECT performance_id, pos / 1e6 AS x, time / 1e6 AS y, kink AND NOT pg AS twin,
  sum((pg OR kink)::BIGINT) OVER (PARTITION BY performance_id ORDER BY pos) AS seg FROM p2),
pt AS (SELECT performance_id, seg, x, y, false AS shared FROM p3
  UNION ALL SELECT performance_id, seg - 1, x, y, true FROM p3 WHERE twin),
sg AS (SELECT performance_id, seg, count(*) AS n, min(x) AS lo, max(x) AS hi,
  greatest(1, ceil(max(x) - min(x) - 1e-9)::BIGINT) AS k FROM pt GROUP BY 1, 2),
s2 AS (SELECT *, n < 4 OR hi - lo < 1e-9 AS straight, (hi - lo) / k AS h FROM sg),
pw AS (SELECT pt.*, lag(x) OVER w AS x0, lead(x) OVER w AS x1 FROM pt
  WINDOW w AS (PARTITION BY performance_id, seg ORDER BY x)),
pu AS (SELECT performance_id, seg, x, y, lo, hi, k, h, straight,
  CASE WHEN x0 IS NULL AND x1 IS NULL THEN 1.0 ELSE least(greatest(coalesce((x1 - x0) / 2, x1 - x,
    x - x0), 0.001), 4.0) END AS w FROM pw JOIN s2 USING (performance_id, seg)),
pc AS (SELECT *, least(floor((x - lo) / h), k - 1)::BIGINT AS c FROM pu WHERE NOT straight),
pb AS (SELECT *, (x - lo) / h - c AS u FROM pc),
bs AS (SELECT performance_id, seg, c, w, y, [pow(1 - u, 3) / 6, (3 * pow(u, 3) - 6 * u * u + 4) / 6,
  (-3 * pow(u, 3) + 3 * u * u + 3 * u + 1) / 6, pow(u, 3) / 6] AS b FROM pb),
en AS (SELECT performance_id, seg, c + p AS i, q - p AS o, sum(w * b[p + 1] * b[q + 1]) AS v
  FROM bs, range(4) r1(p), range(4) r2(q) WHERE p <= q GROUP BY 1, 2, 3, 4),
rh AS (SELECT performance_id, seg, c + p AS i, sum(w * b[p + 1] * y) AS r FROM bs, range(4) r1(p)
  GROUP BY 1, 2, 3),
pe AS (SELECT performance_id, seg, i, o, pow(6.0 / (2 * pi()), 6) / pow(h, 5) * coalesce(sum(
    ([-1, 3, -3, 1])[t + 1] * ([-1, 3, -3, 1])[t + o + 1]) FILTER (t + o <= 3 AND i - t >= 0
      AND i - t <= k - 1), 0) + CASE WHEN o = 0 THEN 1e-10 ELSE 0 END AS v
  FROM (SELECT *, unnest(range(k + 3)) AS i FROM s2 WHERE NOT straight), range(4) r1(o), range(4) r2(t)
  GROUP BY performance_id, seg, i, o, h),
ba AS (SELECT performance_id, seg, i, o, pe.v + coalesce(en.v, 0) AS v FROM pe
  LEFT JOIN en USING (performance_id, seg, i, o)),
bd AS (SELECT ba.performance_id, ba.seg, ba.i + ba.o AS i, max(v) FILTER (o = 0) AS a0,
  coalesce(max(v) FILTER (o = 1), 0) AS a1, coalesce(max(v) FILTER (o = 2), 0) AS a2,
  coalesce(max(v) FILTER (o = 3), 0) AS a3 FROM ba GROUP BY 1, 2, 3),
sy AS (SELECT bd.*, coalesce(r, 0) AS r FROM bd JOIN s2 USING (performance_id, seg)
  LEFT JOIN rh USING (performance_id, seg, i) WHERE i < k + 3),
lu AS (WITH RECURSIVE f AS (
  SELECT performance_id, seg, i, a0 AS d, 1.0::DOUBLE AS d1, 1.0::DOUBLE AS d2, 0.0::DOUBLE AS l1,
    0.0::DOUBLE AS l2, 0.0::DOUBLE AS l3, 0.0::DOUBLE AS m1, r::DOUBLE AS z, 0.0::DOUBLE AS z1,
    0.0::DOUBLE AS z2 FROM sy WHERE i = 0
  UNION ALL
  SELECT performance_id, seg, i, a0 - l3 * l3 * d2 - l2 * l2 * d1 - l1 * l1 * d, d, d1, l1, l2, l3,
    m, r - l3 * z2 - l2 * z1 - l1 * z, z, z1
  FROM (SELECT *, (a1 - l3 * d2 * k2 - l2 * d1 * m) / d AS l1 FROM (
    SELECT *, (a2 - l3 * d2 * m1) / d1 AS l2 FROM (
      SELECT s.performance_id, s.seg, s.i, a0, a1, a2, r, a3 / d2 AS l3, d, d1, d2, f.l1 AS m, m1,
        f.l2 AS k2, z, z1, z2
      FROM f JOIN sy s ON s.performance_id = f.performance_id AND s.seg = f.seg AND s.i = f.i + 1))))
  SELECT performance_id, seg, i, d, z, l1, l2, l3 FROM f),
lb AS (SELECT *, coalesce(lead(l1) OVER w, 0) AS u1, coalesce(lead(l2, 2) OVER w, 0) AS u2,
  coalesce(lead(l3, 3) OVER w, 0) AS u3, max(i) OVER (PARTITION BY performance_id, seg) AS top
  FROM lu WINDOW w AS (PARTITION BY performance_id, seg ORDER BY i)),
co AS (WITH RECURSIVE g AS (
  SELECT performance_id, seg, i, z / d AS c, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM lb WHERE i = top
  UNION ALL
  SELECT b.performance_id, b.seg, b.i, b.z / b.d - u1 * c - u2 * c1 - u3 * c2, c, c1
  FROM g JOIN lb b ON b.performance_id = g.performance_id AND b.seg = g.seg AND b.i = g.i - 1)
  SELECT performance_id, seg, list(c ORDER BY i) AS c FROM g GROUP BY 1, 2),
li AS (SELECT performance_id, seg, sum(w) AS s, sum(w * (x - lo)) AS sx, sum(w * (x - lo) * (x - lo))
    AS sxx, sum(w * y) AS sy, sum(w * (x - lo) * y) AS sxy, avg(y) AS mean, max(lo) AS lo,
    count(*) >= 2 AND max(hi) - max(lo) > 1e-9 AS long FROM pu WHERE straight GROUP BY 1, 2),
l2 AS (SELECT performance_id, seg, CASE WHEN long THEN (s * sxy - sx * sy) / (s * sxx - sx * sx) END
    AS c1, s, sx, sy, mean, lo FROM li),
mp AS (SELECT s2.performance_id, seg, s2.lo, s2.hi, k, h, straight, c, mean, c1,
  CASE WHEN c1 IS NOT NULL THEN (sy - c1 * sx) / s - c1 * l2.lo END AS c0,
  CASE WHEN straight THEN c1 ELSE (c[3] - c[1]) / 2 / h END AS sl,
  CASE WHEN straight THEN c1 ELSE (c[-1] - c[-3]) / 2 / h END AS sh
  FROM s2 LEFT JOIN co USING (performance_id, seg) LEFT JOIN l2 USING (performance_id, seg)),
m2 AS (SELECT *, last_value(CASE WHEN sl IS NOT NULL THEN {'lo': lo, 'hi': hi, 's': sh} END
    IGNORE NULLS) OVER (PARTITION BY performance_id ORDER BY seg) AS b,
  first_value(CASE WHEN sl IS NOT NULL THEN {'lo': lo, 'hi': hi, 's': sl} END IGNORE NULLS) OVER (
    PARTITION BY performance_id ORDER BY seg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a
  FROM mp),
m3 AS (SELECT *, CASE WHEN sl IS NOT NULL THEN NULL ELSE coalesce(CASE WHEN a IS NULL
    OR least(abs(b.lo - lo), abs(b.hi - lo)) <= least(abs(a.lo - lo), abs(a.hi - lo)) THEN b.s
    ELSE a.s END, 1.0) END AS fs FROM m2),
maps AS (SELECT performance_id, seg, lo, hi, k, h, straight, c, coalesce(c0, mean - fs * lo) AS c0,
  coalesce(c1, fs) AS c1, coalesce(sl, fs) AS sl, coalesce(sh, fs) AS sh FROM m3)"""


def _eval(points: str) -> str:
    """``ev``: the points (performance_id, seg, x, ...) with smooth time and period."""
    return f"""
, e1 AS (SELECT q.*, m.* EXCLUDE (performance_id, seg), least(greatest(x, lo), hi) AS xc
  FROM {points} q JOIN maps m USING (performance_id, seg)),
e2 AS (SELECT *, CASE WHEN NOT straight THEN least(floor((xc - lo) / h), k - 1)::BIGINT END AS ci
  FROM e1),
e3 AS (SELECT *, (xc - lo) / h - ci AS u FROM e2),
ev AS (SELECT *, CASE WHEN straight THEN c0 + c1 * x ELSE pow(1 - u, 3) / 6 * c[ci + 1]
    + (3 * pow(u, 3) - 6 * u * u + 4) / 6 * c[ci + 2]
    + (-3 * pow(u, 3) + 3 * u * u + 3 * u + 1) / 6 * c[ci + 3] + pow(u, 3) / 6 * c[ci + 4]
    + least(x - lo, 0) * sl + greatest(x - hi, 0) * sh END AS smooth,
  CASE WHEN straight THEN c1 ELSE (-(1 - u) * (1 - u) / 2 * c[ci + 1]
    + (3 * u * u - 4 * u) / 2 * c[ci + 2] + (-3 * u * u + 2 * u + 1) / 2 * c[ci + 3]
    + u * u / 2 * c[ci + 4]) / h END AS period FROM e3)"""


@query("tempo_positions", sql("notes", POS_SQL + """
SELECT performance_id, pos, round(time, 3) AS time_us, n_notes, spread AS spread_us FROM pos"""))
def tempo_positions(spark, sf):
    """Median onset, number of notes and spread of every score position."""
    p = T.tempo_positions(_notes(spark, sf), P, "pos", "onset_us")
    return p.select(*P, "pos", F.round("time", 3).alias("time_us"), "n_notes",
                    F.col("spread").alias("spread_us"))


def _breaks(spark, sf):
    p = cut_lineage(T.tempo_positions(_notes(spark, sf), P, "pos", "onset_us"))
    return p, T.tempo_breaks(p, P, WIN, WIDTH, _marks(spark, sf))


@query("tempo_breaks", sql("notes", BREAKS_SQL + """
SELECT performance_id, pos, kind, type FROM br"""))
def tempo_breaks(spark, sf):
    """Pauses, fermatas and tempo marks at which the smooth curve is cut."""
    return _breaks(spark, sf)[1]


def _fit(spark, sf):
    p, b = _breaks(spark, sf)
    b = cut_lineage(b)
    s = T.tempo_segments(p, P, b, WIDTH)
    return (*T.tempo_fit(s, P, PERIOD, robust=0), b)


@query("time_map", sql("notes", FIT_SQL + _eval("(SELECT * FROM pt WHERE NOT shared)") + """
SELECT performance_id, seg::BIGINT AS seg, x AS beat, round(smooth, 5) AS smooth,
  round(period, 5) AS period, round(y - smooth, 5) AS dev FROM ev"""))
def time_map(spark, sf):
    """Smooth time and beat period at every position, all positions with the same say."""
    _, at, _ = _fit(spark, sf)
    return at.select(*P, "seg", "beat", *[F.round(c, 5).alias(c) for c in (
        "smooth", "period", "dev")])


@query("pause_excess", sql("notes", FIT_SQL + _eval("(SELECT * FROM pt WHERE NOT shared)") + """
, nx AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ev
  WINDOW w AS (PARTITION BY performance_id ORDER BY x))
SELECT br.performance_id, br.pos, kind, round(dy - period * dx, 5) AS excess FROM br JOIN nx
  ON nx.performance_id = br.performance_id AND nx.x = br.pos / 1e6 WHERE type = 'gap'"""))
def pause_excess(spark, sf):
    """How much longer each gap is than the smooth tempo before it."""
    _, at, b = _fit(spark, sf)
    e = T.pause_excess(at, P, b)
    return e.select(*P, "pos", "kind", F.round("excess", 5).alias("excess"))


@query("tempo_beats", sql("notes", FIT_SQL + """
, ea AS (SELECT performance_id, ceil(min(x) - 1e-9)::BIGINT AS a, floor(max(x) + 1e-9)::BIGINT AS z
  FROM p3 GROUP BY 1),
gd AS (SELECT performance_id, unnest(range(a, z + 1))::DOUBLE AS x FROM ea WHERE z > a
  UNION ALL SELECT performance_id, x FROM p3 JOIN ea USING (performance_id) WHERE z <= a),
gs AS (SELECT gd.performance_id, x, max(seg) AS seg FROM gd JOIN maps m
  ON m.performance_id = gd.performance_id AND m.lo <= x GROUP BY 1, 2)""" + _eval("gs") + """
SELECT performance_id, seg::BIGINT AS seg, x AS beat, round(period, 5) AS period,
  round(ln(exp(avg(CASE WHEN period > 0 THEN ln(period) END) OVER (PARTITION BY performance_id))
    / CASE WHEN period > 0 THEN period END), 4) AS log_ratio FROM ev"""))
def tempo_beats(spark, sf):
    """The smooth curve of every performance on whole beats."""
    maps, at, _ = _fit(spark, sf)
    g = T.tempo_beats(maps, at)
    return g.select(*P, "seg", "beat", F.round("period", 5).alias("period"),
                    F.round("log_ratio", 4).alias("log_ratio"))


JITTER_SQL = FIT_SQL + """
, zz AS (WITH RECURSIVE g AS (
  SELECT performance_id, seg, i, 1 / d AS q0, 0.0::DOUBLE AS q1, 0.0::DOUBLE AS q2, 0.0::DOUBLE AS q3,
    1 / d AS z11, 0.0::DOUBLE AS z12, 0.0::DOUBLE AS z13, 0.0::DOUBLE AS z22, 0.0::DOUBLE AS z23,
    0.0::DOUBLE AS z33 FROM lb WHERE i = top
  UNION ALL
  SELECT performance_id, seg, i, z0, a, b, c, z0, a, b, z11, z12, z22
  FROM (SELECT *, 1 / d - u1 * a - u2 * b - u3 * c AS z0 FROM (
    SELECT l.performance_id, l.seg, l.i, l.d, u1, u2, u3, z11, z12, z22,
      -(u1 * z11 + u2 * z12 + u3 * z13) AS a, -(u1 * z12 + u2 * z22 + u3 * z23) AS b,
      -(u1 * z13 + u2 * z23 + u3 * z33) AS c
    FROM g JOIN lb l ON l.performance_id = g.performance_id AND l.seg = g.seg AND l.i = g.i - 1)))
  SELECT performance_id, seg, i, [q0, q1, q2, q3] AS q FROM g),
ef AS (SELECT performance_id, seg, sum(CASE WHEN o = 0 THEN 1 ELSE 2 END * v * q[o + 1]) AS edf
  FROM en JOIN zz USING (performance_id, seg, i) GROUP BY 1, 2
  UNION ALL SELECT performance_id, seg, CASE WHEN c1 IS NULL THEN 1 ELSE 2 END FROM l2),
ep AS (SELECT performance_id, sum(edf) AS edf FROM ef GROUP BY 1)""" + _eval(
    "(SELECT * FROM pt WHERE NOT shared)") + """
, rs AS (SELECT performance_id, y - smooth AS r, (y - smooth) / period AS rb FROM ev),
md AS (SELECT performance_id, count(*) AS n, sum(r * r) AS ss, sum(rb * rb) AS sb,
  quantile_cont(r, 0.5) AS m, quantile_cont(rb, 0.5) AS mb FROM rs GROUP BY 1),
ma AS (SELECT performance_id, quantile_cont(abs(r - m), 0.5) AS a, quantile_cont(abs(rb - mb), 0.5) AS b
  FROM rs JOIN md USING (performance_id) GROUP BY 1),
al AS (SELECT *, greatest(n - edf, 1.0) AS dof FROM md JOIN ma USING (performance_id)
  JOIN ep USING (performance_id))
SELECT performance_id, n, round(edf, 5) AS edf, round(1000 * sqrt(ss / dof), 3) AS rms_ms,
  round(1000 * sqrt(n / dof) * 1.4826 * a, 3) AS mad_ms, round(sqrt(sb / dof), 5) AS rms_beats,
  round(sqrt(n / dof) * 1.4826 * b, 5) AS mad_beats FROM al"""


@query("tempo_jitter", sql("notes", JITTER_SQL))
def tempo_jitter(spark, sf):
    """Unevenness about the smooth curve, made up for the degrees of freedom the curve takes."""
    maps, at, _ = _fit(spark, sf)
    j = T.tempo_jitter(maps, at)
    return j.select(*P, "n", F.round("edf", 5).alias("edf"), F.round("rms_ms", 3).alias("rms_ms"),
                    F.round("mad_ms", 3).alias("mad_ms"), F.round("rms_beats", 5).alias("rms_beats"),
                    F.round("mad_beats", 5).alias("mad_beats"))


CTES = "sg s2 pw pu pc pb bs en rh pe ba bd sy lu lb co li l2 mp m2 m3 maps pt"


def _again(points: str, period: float) -> str:
    """The fit once more over other points, as ``maps_q``."""
    own = FIT_SQL[FIT_SQL.index("sg AS (SELECT"):].replace("pow(6.0 /", f"pow({period} /")
    return f"\n, pt_q AS ({points}),\n" + re.sub(
        rf"\b({'|'.join(CTES.split())})\b", r"\1_q", own)


GRID_SQL = """
, ea AS (SELECT performance_id, ceil(min(x) - 1e-9)::BIGINT AS a, floor(max(x) + 1e-9)::BIGINT AS z
  FROM p3 GROUP BY 1),
gd AS (SELECT performance_id, unnest(range(a, z + 1))::DOUBLE AS x FROM ea WHERE z > a
  UNION ALL SELECT performance_id, x FROM p3 JOIN ea USING (performance_id) WHERE z <= a),
gs AS (SELECT gd.performance_id, x, max(seg) AS seg FROM gd JOIN maps m
  ON m.performance_id = gd.performance_id AND m.lo <= x GROUP BY 1, 2)""" + _eval("gs") + """
, gr2 AS (SELECT performance_id, seg, x, period, avg(CASE WHEN period > 0 THEN ln(period) END) OVER (
  PARTITION BY performance_id) AS lg FROM ev),
sz AS (SELECT performance_id, seg, min(x) AS a, max(x) AS z FROM pt WHERE NOT shared GROUP BY 1, 2
  HAVING count(*) >= 6 AND max(x) - min(x) >= 8),
ex AS (SELECT performance_id, pos / 1e6 AS lo, pos / 1e6 + 2 AS hi FROM br WHERE kind = 'tempo_marking'),
gi AS (SELECT g.performance_id, g.seg, x, lg, lg - ln(period) AS lr FROM gr2 g JOIN sz USING (
    performance_id, seg) WHERE x BETWEEN a AND z AND period > 0 AND NOT EXISTS (SELECT 1 FROM ex e
    WHERE e.performance_id = g.performance_id AND e.lo <= x AND x < e.hi))"""

STABLE_SQL = FIT_SQL + GRID_SQL + _again(
    "SELECT p.* FROM pt p JOIN sz USING (performance_id, seg) WHERE NOT p.shared", 12.0) + re.sub(
    r"\b(e1|e2|e3|ev|maps)\b", r"\1_q", _eval("gi")) + """
, st AS (SELECT performance_id, seg, count(*) AS n, stddev_pop(lr) AS s, stddev_pop(lg - ln(period)) AS p,
  sqrt(avg(pow(lr - lg + ln(period), 2))) AS i, regr_slope(lr, x) * (max(x) - min(x)) AS d
  FROM ev_q WHERE period > 0 GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("tempo_stability", sql("notes", STABLE_SQL + """
SELECT performance_id, seg::BIGINT AS seg, n AS n_beats, round(s, 4) AS section_sd,
  round(p, 4) AS phrase_sd, round(i, 4) AS instability, round(d, 4) AS drift FROM st"""))
def tempo_stability(spark, sf):
    """Wobble of the tempo of every section beyond its phrases, marked changes left out."""
    return _stability(spark, sf).select(
        *P, "seg", "n_beats", *[F.round(c, 4).alias(c) for c in (
            "section_sd", "phrase_sd", "instability", "drift")])


def _stability(spark, sf):
    maps, at, b = _fit(spark, sf)
    at = cut_lineage(at)
    spans = b.where("kind = 'tempo_marking'").select(
        *P, (F.col("pos") / MICRO).alias("lo"), (F.col("pos") / MICRO + 2).alias("hi"))
    return T.tempo_stability(cut_lineage(T.tempo_beats(maps, at)), at, P, 12.0, spans=spans,
                             min_span=8.0, robust=0)


@query("stability_summary", sql("notes", STABLE_SQL + """
SELECT performance_id, count(*) AS n_sections, round(sqrt(sum(n * i * i) / sum(n)), 4) AS instability,
  round(sqrt(sum(n * s * s) / sum(n)), 4) AS section_sd, round(sqrt(sum(n * p * p) / sum(n)), 4)
  AS phrase_sd, round(sum(n * abs(d)) / sum(n), 4) AS drift FROM st GROUP BY 1"""))
def stability_summary(spark, sf):
    """The same of whole performances, sections weighed by their beats."""
    return T.stability_summary(_stability(spark, sf), P).select(
        *P, "n_sections", *[F.round(c, 4).alias(c) for c in (
            "instability", "section_sd", "phrase_sd", "drift")])


@query("grid_curves", sql("notes", FIT_SQL + GRID_SQL + """
, pg AS (SELECT performance_id % 7 AS piece, max(x)::BIGINT AS top FROM p3 GROUP BY 1),
gg AS (SELECT performance_id, unnest(range(0, top + 1))::DOUBLE AS x FROM (SELECT DISTINCT performance_id
  FROM p3) JOIN pg ON piece = performance_id % 7),
vl AS (SELECT performance_id, floor(pos / 1e6 + 1e-6) AS x, avg(velocity) AS v FROM n2 GROUP BY 1, 2)
SELECT performance_id, x AS beat, round(CASE WHEN period > 0 AND EXISTS (SELECT 1 FROM p3 q
    WHERE q.performance_id = gg.performance_id AND abs(q.x - gg.x) <= 4) THEN lg - ln(period) END, 4)
  AS tempo, round(v, 6) AS velocity
FROM gg LEFT JOIN gr2 USING (performance_id, x) LEFT JOIN vl USING (performance_id, x)"""))
def grid_curves(spark, sf):
    """Smooth tempo and mean velocity of all performances of a piece on the piece's beats."""
    maps, at, _ = _fit(spark, sf)
    at = cut_lineage(at)
    piece = F.pmod(F.col("performance_id"), F.lit(7)).alias("piece")
    top = at.groupBy(piece).agg(F.max("beat").cast("bigint").alias("top"))
    grid = at.select("performance_id", piece).distinct().join(top, "piece").select(*P, F.explode(
        F.sequence(F.lit(0).cast("bigint"), "top")).alias("beat")).withColumn(
        "beat", F.col("beat").cast("double"))
    n = _notes(spark, sf).withColumn("beat", F.col("pos") / MICRO)
    g = T.grid_curves(T.tempo_beats(maps, at), at, n, grid, P, 4.0)
    return g.select(*P, "beat", F.round("tempo", 4).alias("tempo"), F.round("velocity", 6).alias(
        "velocity"))


@query("tempo_flattened", sql("notes", FIT_SQL + _eval("(SELECT * FROM pt WHERE NOT shared)") + """
, ku AS (SELECT performance_id, x, max(smooth * 1e6) OVER (PARTITION BY performance_id ORDER BY x) AS t
  FROM ev),
kn AS (SELECT performance_id, t, max(x) AS b FROM ku GROUP BY 1, 2),
kl AS (SELECT *, lead(t) OVER w AS t2, lead(b) OVER w AS b2 FROM kn WINDOW w AS (
  PARTITION BY performance_id ORDER BY t)),
en2 AS (SELECT performance_id, min(x) AS b0, max(x) AS b1, arg_min(period, x) AS p0, arg_max(period, x)
  AS p1 FROM ev GROUP BY 1),
et AS (SELECT e.*, t0, t1 FROM en2 e JOIN (SELECT performance_id, min(t) AS t0, max(t) AS t1 FROM kn
  GROUP BY 1) USING (performance_id) WHERE b1 > b0 AND p0 > 0 AND p1 > 0),
tt AS (SELECT performance_id, note_id, 0 AS z, onset_us::DOUBLE AS t FROM notes
  UNION ALL SELECT performance_id, note_id, 1, onset_us + duration_us::DOUBLE FROM notes),
tb AS (SELECT tt.*, e.* EXCLUDE (performance_id), k.t AS ka, k.b AS kb, t2, b2 FROM tt
  JOIN et e USING (performance_id) ASOF LEFT JOIN kl k
  ON k.performance_id = tt.performance_id AND tt.t >= k.t),
tv AS (SELECT performance_id, note_id, z, t, t0, t1, b0, b1, CASE WHEN t < t0 THEN b0 + (t - t0) / (p0 * 1e6)
  WHEN t > t1 THEN b1 + (t - t1) / (p1 * 1e6) WHEN t2 IS NULL THEN kb
  ELSE kb + (t - ka) * (b2 - kb) / greatest(t2 - ka, 1e-3) END AS b FROM tb),
tw AS (SELECT performance_id, note_id, z, 0.4 * t + 0.6 * (t0 + (b - b0) * (t1 - t0) / (b1 - b0)) AS w FROM tv)
SELECT a.performance_id, a.note_id, round(greatest(0.0, a.w), 1) AS new_onset_us,
  round(greatest(20000.0, c.w - a.w), 1) AS new_duration_us FROM tw a JOIN tw c
  ON a.performance_id = c.performance_id AND a.note_id = c.note_id AND a.z = 0 AND c.z = 1"""))
def tempo_flattened(spark, sf):
    """Every performance with three fifths of its tempo changes taken out."""
    _, at, _ = _fit(spark, sf)
    f = T.tempo_flatten(cut_lineage(at), notes(spark, sf), P, 0.6, NOTE_CHUNK)
    return f.select(*P, "note_id", F.round("new_onset_us", 1).alias("new_onset_us"),
                    F.round("new_duration_us", 1).alias("new_duration_us"))
