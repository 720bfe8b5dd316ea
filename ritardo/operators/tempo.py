"""Smooth time maps of performances: robust penalised splines over segments, and what hangs on them.

A segment's time map is a cubic spline on even knots with a third-difference penalty. The normal
equations are sums over positions, made by a grouped aggregate per knot interval; the banded
system of every segment is solved in blocks (``blocksolve``), so that neither a long performance nor
a long segment needs one task. Positions are in beats, times in seconds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.operators import blocksolve as B
from ritardo.operators.ordered import asof, chunk_of, scan
from ritardo.operators.phrases import beat_map
from ritardo.operators.quantiles import exact_quantiles
from ritardo.operators.sequences import detect_pauses, interpolate
from ritardo.session import cut_lineage

MAD = 1.4826  # of a normal sample: deviation over median absolute deviation
WIDTH = 4096  # beats of a chunk of ordered scans
COEFS = B.SPAN * B.NODE  # coefficients of a span
BAND = [f"g{p}{q}" for p in range(4) for q in range(p, 4)]
RHS = [f"y{p}" for p in range(4)]


@dataclass(frozen=True)
class Maps:
    """``segments``: keys, seg, n, lo, hi, n_int, h, edf, straight (a line, no spline), c0, c1,
    slope_lo, slope_hi, one row each; ``coefs``: keys, seg, span, c, the spline coefficients of a
    span and the three that follow it."""

    keys: tuple[str, ...]
    segments: DataFrame
    coefs: DataFrame


def cutoff_to_lambda(period: Column | float, spacing: Column | float) -> Column | float:
    """Penalty with gain one half at waves of ``period`` beats."""
    return (period / (2 * math.pi)) ** 6 / spacing**5


def basis(u: str) -> list[str]:
    """The four cubic B-splines over a knot interval, at ``u`` in [0, 1]."""
    return [f"(pow(1 - {u}, 3) / 6)", f"((3 * pow({u}, 3) - 6 * {u} * {u} + 4) / 6)",
            f"((-3 * pow({u}, 3) + 3 * {u} * {u} + 3 * {u} + 1) / 6)", f"(pow({u}, 3) / 6)"]


def slopes(u: str) -> list[str]:
    """Their derivatives, per knot interval."""
    return [f"(-(1 - {u}) * (1 - {u}) / 2)", f"((3 * {u} * {u} - 4 * {u}) / 2)",
            f"((-3 * {u} * {u} + 2 * {u} + 1) / 2)", f"({u} * {u} / 2)"]


def spacing_weights(used: DataFrame, keys: Sequence[str], beat: str, out: str = "w0") -> DataFrame:
    """Beats each position stands for (trapezoid rule), between 0.001 and 4; alone: 1."""
    s = scan(used, keys, [beat], chunk_of(F.col(beat), WIDTH), __b0=("prev", beat),
             __b1=("lead", beat))
    w = F.when(F.col("__b0").isNotNull() & F.col("__b1").isNotNull(),
               (F.col("__b1") - F.col("__b0")) / 2)
    w = F.coalesce(w, F.col("__b1") - F.col(beat), F.col(beat) - F.col("__b0"), F.lit(1.0))
    alone = F.col("__b0").isNull() & F.col("__b1").isNull()
    w = F.when(alone, 1.0).otherwise(F.least(F.greatest(w, F.lit(1e-3)), F.lit(4.0)))
    return s.withColumn(out, w).drop("__b0", "__b1")


def fit_weighted(pos: DataFrame, keys: Sequence[str], period: float, spacing: float = 1.0) -> Maps:
    """Penalised fit of ``time`` on ``beat`` in each (keys, seg) with weights ``rw``.

    Positions of weight 0 take no part, unless their segment has no others. Segments of fewer than
    four positions or no length get a line; of one position, the slope of the nearest segment.
    Positions must be distinct inside a segment.
    """
    keys = list(keys)
    ks = [*keys, "seg"]
    some = F.count(F.when(F.col("rw") > 0, 1)) > 0
    live = F.col("rw") > 0
    seg = pos.groupBy(*ks).agg(
        some.alias("some"), F.count("*").alias("__all"), F.count(F.when(live, 1)).alias("__n"),
        *[F.expr(f"{f}({c})").alias(f"__{f}{i}") for f in ("min", "max")
          for i, c in enumerate(("beat", "case when rw > 0 then beat end"))])
    n = F.when(F.col("some"), F.col("__n")).otherwise(F.col("__all"))
    lo, hi = (F.when(F.col("some"), F.col(f"__{f}1")).otherwise(F.col(f"__{f}0"))
              for f in ("min", "max"))
    n_int = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / spacing - 1e-9)).cast("bigint")
    seg = seg.select(*ks, "some", n.alias("n"), lo.alias("lo"), hi.alias("hi")).withColumn(
        "straight", (F.col("n") < 4) | (F.col("hi") - F.col("lo") < 1e-9)).withColumn(
        "n_int", n_int).withColumn("h", (F.col("hi") - F.col("lo")) / F.col("n_int"))
    seg = cut_lineage(seg)
    shape = seg.agg(F.max(F.when(~F.col("straight"), F.col("n_int"))), F.count(F.when(
        F.col("straight"), 1))).first()
    used = pos.join(seg, ks).where(live | ~F.col("some")).withColumn(
        "rw", F.when(F.col("some"), F.col("rw")).otherwise(1.0))
    used = cut_lineage(spacing_weights(used, ks, "beat").withColumn("w", F.col("w0") * F.col("rw")))
    s, coefs = _splines(used.where("not straight"), seg.where("not straight"), ks, period, shape[0])
    if shape[1]:
        s = s.unionByName(_lines(used.where("straight"), ks))
    s = seg.drop("some").join(s, ks)
    return Maps(tuple(keys), cut_lineage(_slopes_filled(s, keys) if shape[1] else s), coefs)


def _lines(used: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Weighted lines, through sums about the first beat; mean and no slope at a single beat."""
    w, x = F.greatest("w", F.lit(1e-12)), F.col("beat") - F.col("lo")
    a = used.groupBy(*ks).agg(
        F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"),
        F.sum(w * F.col("time")).alias("sy"), F.sum(w * x * F.col("time")).alias("sxy"),
        F.avg("time").alias("mean"), F.first("lo").alias("__lo"),
        (F.count("*") >= 2).alias("two"), F.first(F.col("hi") - F.col("lo") > 1e-9).alias("long"))
    slope = F.when(F.col("two") & F.col("long"), (F.col("s") * F.col("sxy") - F.col("sx") * F.col(
        "sy")) / (F.col("s") * F.col("sxx") - F.col("sx") ** 2))
    c0 = (F.col("sy") - slope * F.col("sx")) / F.col("s") - slope * F.col("__lo")
    return a.select(*ks, F.coalesce(c0, F.col("mean")).alias("c0"), slope.alias("c1"),
                    slope.alias("slope_lo"), slope.alias("slope_hi"),
                    F.when(slope.isNull(), 1.0).otherwise(2.0).alias("edf"))


def _cells(used: DataFrame, ks: Sequence[str]) -> DataFrame:
    """Normal equations by knot interval: ten products of basis values and four right-hand sides."""
    d = used.withColumn("__u", (F.col("beat") - F.col("lo")) / F.col("h")).withColumn(
        "cell", F.least(F.floor("__u"), F.col("n_int") - 1)).withColumn(
        "__u", F.col("__u") - F.col("cell"))
    b = basis("__u")
    pairs = [(p, q) for p in range(4) for q in range(p, 4)]
    return d.groupBy(*ks, "cell").agg(
        *[F.expr(f"sum(w * {b[p]} * {b[q]})").alias(f"g{p}{q}") for p, q in pairs],
        *[F.expr(f"sum(w * {b[p]} * time)").alias(f"y{p}") for p in range(4)])


def _banded(pdf: pd.DataFrame, coefs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, penalty plus ridge, right-hand side) of the spans of a frame, as bands."""
    n, m = len(pdf), int(pdf["m"].max()) * B.NODE
    gram, rhs = np.zeros((n, m + 4, 4)), np.zeros((n, m + 4))
    for i, (span, cells, sums) in enumerate(zip(pdf["span"], pdf["cells"], pdf["sums"], strict=True)):
        if cells is None or not len(cells):
            continue
        at = np.asarray(cells) - span * coefs
        s = np.asarray(sums).reshape(len(at), len(BAND) + 4)
        for j, name in enumerate(BAND):
            p, q = int(name[1]), int(name[2])
            ok = (at + p >= 0) & (at + p < m)
            gram[i, at[ok] + p, q - p] += s[ok, j]
        for p in range(4):
            ok = (at + p >= 0) & (at + p < m)
            rhs[i, at[ok] + p] += s[ok, len(BAND) + p]
    size = pdf["n_coef"].to_numpy()[:, None]
    at = pdf["span"].to_numpy()[:, None] * coefs + np.arange(m)[None, :]
    c = (-1.0, 3.0, -3.0, 1.0)  # third difference
    stiff = np.zeros((n, m, 4))
    for q in range(4):
        for t in range(4 - q):
            stiff[:, :, q] += np.where((at - t >= 0) & (at - t <= size - 4), c[t] * c[t + q], 0.0)
    stiff *= pdf["lam"].to_numpy()[:, None, None]
    stiff[:, :, 0] += np.where(at < size, 1e-10, 1.0)  # unknowns past the end stand alone
    return gram[:, :m], stiff, rhs[:, :m]


def _blocks(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (k, k) and (k, k + 1) of symmetric bands (spans, unknowns, 4)."""
    n, m = band.shape[0], band.shape[1] // B.NODE
    d, e = np.zeros((n, m, 3, 3)), np.zeros((n, m, 3, 3))
    for a in range(3):
        for b in range(3):
            d[:, :, a, b] = band[:, min(a, b)::3, abs(a - b)]
            if b <= a:
                e[:, :, a, b] = band[:, a::3, 3 + b - a]
    return d, e


def _splines(used: DataFrame, seg: DataFrame, ks: list[str], period: float, most: int | None
             ) -> tuple[DataFrame, DataFrame]:
    """(keys, seg, c0, c1, slope_lo, slope_hi, edf) and coefficients of the spline segments."""
    cells = _cells(used, ks)
    node = f"div {B.NODE} div {B.SPAN}"
    both = cells.withColumn("span", F.explode(F.array_distinct(F.array(
        F.expr(f"cell {node}"), F.expr(f"(cell + 3) {node}")))))
    held = both.groupBy(*ks, "span").agg(F.collect_list(F.struct(
        "cell", F.array(*BAND, *RHS).alias("v"))).alias("a")).select(
        *ks, "span", F.col("a.cell").alias("cells"), F.flatten(F.col("a.v")).alias("sums"))
    s = seg.select(*ks, (F.col("n_int") + 3).alias("n_coef"), F.col("h"),
                   cutoff_to_lambda(F.lit(period), F.col("h")).alias("lam"))
    nodes = f"(n_coef + {B.NODE - 1}) div {B.NODE}"
    every = s.withColumn("__nodes", F.expr(nodes)).withColumn("span", F.explode(F.expr(
        f"sequence(0L, (__nodes - 1) div {B.SPAN})"))).withColumn("m", F.expr(
            f"cast(least({B.SPAN}, __nodes - span * {B.SPAN}) as int)")).withColumn(
        "more", F.expr(f"(span + 1) * {B.SPAN} < __nodes")).drop("__nodes")
    kinds = B._kinds(every, ks)
    coefs = COEFS

    def assemble(batches):
        for pdf in B._pieces(batches):
            gram, stiff, rhs = _banded(pdf, coefs)
            d, e = _blocks(gram + stiff)
            gd, ge = _blocks(gram)
            out = pdf[[*ks, "span", "m", "more"]].copy()
            for name, a in (("d", d), ("e", e), ("r", rhs.reshape(len(pdf), -1, 3)), ("gd", gd),
                            ("ge", ge)):
                out[name] = [x[:m].ravel() for x, m in zip(a, pdf["m"], strict=True)]
            yield out

    arrays = ", ".join(f"{c} array<double>" for c in ("d", "e", "r", "gd", "ge"))
    spans = cut_lineage(every.join(held, [*ks, "span"], "left").mapInPandas(
        assemble, f"{kinds}, span bigint, m int, more boolean, {arrays}"))
    if most is None:
        none = spans.select(*ks, *[F.lit(0.0).alias(c) for c in (
            "c0", "c1", "slope_lo", "slope_hi", "edf")])
        return none, spans.select(*ks, "span", F.col("d").alias("c"))
    ends = B.span_ends(spans, ks, -(-(int(most) + 3) // B.NODE))

    def fill(batches):
        for pdf in B._pieces(batches):
            x, v, u, xr, _ = B.opened(pdf)
            out = pdf[[*ks, "span"]].copy()
            edf, c = [], []
            for i, m in enumerate(pdf["m"]):
                gd = np.asarray(pdf["gd"].iloc[i]).reshape(m, 3, 3)
                ge = np.asarray(pdf["ge"].iloc[i]).reshape(m, 3, 3)
                edf.append(float((v[i, :m] * gd).sum() + 2 * (u[i, :m] * ge).sum()))
                c.append(np.concatenate([x[i, :m].ravel(), xr[i]]))
            yield out.assign(edf=edf, c=c)

    done = cut_lineage(ends.mapInPandas(fill, f"{kinds}, span bigint, edf double, c array<double>"))
    size = F.col("n_coef") - 1 - F.col("span") * COEFS  # last coefficient inside its span
    d = done.join(s, ks)
    first = (F.element_at("c", 3) - F.element_at("c", 1)) / 2
    # the last three coefficients may begin in the span before the last
    last = F.when((size >= 2) & (size < COEFS + 3), (F.element_at("c", (size + 1).cast("int"))
                  - F.element_at("c", (size - 1).cast("int"))) / 2)
    d = d.select(*ks, "edf", F.when(F.col("span") == 0, first / F.col("h")).alias("a"),
                 (last / F.col("h")).alias("z"))
    zero = F.lit(None).cast("double")
    segs = d.groupBy(*ks).agg(F.sum("edf").alias("edf"), F.max("a").alias("slope_lo"),
                              F.max("z").alias("slope_hi"))
    return segs.select(*ks, zero.alias("c0"), zero.alias("c1"), "slope_lo", "slope_hi",
                       "edf"), done.select(*ks, "span", "c")


def _slopes_filled(seg: DataFrame, keys: list[str]) -> DataFrame:
    """Single positions get the slope of the nearest segment that has one, else 1."""
    has = F.col("slope_lo").isNotNull()
    box = F.when(has, F.struct("lo", "hi", "slope_lo", "slope_hi"))
    s = scan(seg.withColumn("__box", box), keys, ["seg"], chunk_of(F.col("seg"), WIDTH),
             __p=("last", "__box"), __n=("next", "__box"))
    far = {x: F.least(F.abs(F.col(f"{x}.lo") - F.col("lo")), F.abs(F.col(f"{x}.hi") - F.col("lo")))
           for x in ("__p", "__n")}
    near = F.when(F.col("__n").isNull() | (far["__p"] <= far["__n"]), F.col("__p.slope_hi")).otherwise(
        F.col("__n.slope_lo"))
    slope = F.when(has, F.col("c1")).otherwise(F.coalesce(near, F.lit(1.0)))
    c0 = F.when(has, F.col("c0")).otherwise(F.col("c0") - slope * F.col("lo"))
    lone = ~has
    return s.withColumn("__slope", slope).withColumn("c0", c0).withColumn("c1", F.col("__slope")) \
        .withColumn("slope_lo", F.when(lone, F.col("__slope")).otherwise(F.col("slope_lo"))) \
        .withColumn("slope_hi", F.when(lone, F.col("__slope")).otherwise(F.col("slope_hi"))) \
        .drop("__box", "__p", "__n", "__slope")


def evaluate(maps: Maps, points: DataFrame, beat: str = "beat", seg: str = "seg") -> DataFrame:
    """``smooth`` (time) and ``period`` (seconds per beat) at points of known segments; beyond a
    segment's ends the end slope goes on. Points of unknown segments are left out."""
    ks = [*maps.keys, "seg"]
    p = points.withColumnRenamed(seg, "seg") if seg != "seg" else points
    info = maps.segments.select(*ks, "lo", "hi", "n_int", "h", "straight", "c0", "c1", "slope_lo",
                                "slope_hi")
    p = p.join(info.withColumnsRenamed({c: f"__{c}" for c in info.columns if c not in ks}), ks)
    x = F.least(F.greatest(F.col(beat), F.col("__lo")), F.col("__hi"))
    u = F.when(~F.col("__straight"), (x - F.col("__lo")) / F.col("__h"))
    p = p.withColumn("__u", u).withColumn("__cell", F.least(F.floor("__u"), F.col("__n_int") - 1)) \
        .withColumn("__u", F.col("__u") - F.col("__cell")) \
        .withColumn("span", F.expr(f"__cell div {COEFS}"))
    p = p.join(maps.coefs, [*ks, "span"], "left")
    at = F.expr(f"cast(__cell - span * {COEFS} as int)")
    b, d = basis("__u"), slopes("__u")
    c = [F.get("c", at + i) for i in range(4)]
    over = F.least(F.col(beat) - F.col("__lo"), F.lit(0.0)) * F.col("__slope_lo") + F.greatest(
        F.col(beat) - F.col("__hi"), F.lit(0.0)) * F.col("__slope_hi")
    line = F.col("__c0") + F.col("__c1") * F.col(beat)
    spline = sum((F.expr(b[i]) * c[i] for i in range(1, 4)), F.expr(b[0]) * c[0]) + over
    rate = sum((F.expr(d[i]) * c[i] for i in range(1, 4)), F.expr(d[0]) * c[0]) / F.col("__h")
    keep = [k for k in points.columns if k != seg]
    return p.select(*[F.col(k) for k in keep], F.col("seg").alias(seg),
                    F.when(F.col("__straight"), line).otherwise(spline).alias("smooth"),
                    F.when(F.col("__straight"), F.col("__c1")).otherwise(rate).alias("period"))


def fit_time_map(pos: DataFrame, keys: Sequence[str], period: float, *, spacing: float = 1.0,
                 robust: int = 6, bisquare: float = 4.685) -> tuple[Maps, DataFrame]:
    """Robust piecewise fit of ``time`` on ``beat``: (maps, positions with ``rw`` and ``smooth``).

    ``pos``: keys, seg, beat, time, use (false: never fitted). Bisquare weights follow the residuals
    over their scale (median absolute residual, made up for the degrees of freedom that the fit
    takes), for at most ``robust`` rounds; a performance whose weights stand still keeps its fit and
    leaves the rounds. ``rw`` is 0 where a position was rejected.
    """
    keys = list(keys)
    ks = [*keys, "seg"]
    base = cut_lineage(pos.select(*ks, "beat", "time", "use", F.when(F.col("use"), 1.0).otherwise(
        0.0).alias("rw")))
    done: list[tuple[Maps, DataFrame]] = []
    left = base
    for turn in range(robust + 1):
        maps = fit_weighted(left, keys, period, spacing)
        at = cut_lineage(evaluate(maps, left).withColumn("res", F.col("time") - F.col("smooth")))
        if turn == robust:
            done.append((maps, at))
            break
        ok = at.where("use and not isnan(res)").withColumn("__a", F.abs("res"))
        med = exact_quantiles(ok, keys, "__a", {"__m": 0.5}, count="__n")
        edf = maps.segments.groupBy(*keys).agg(F.sum("edf").alias("__edf"))
        factor = F.sqrt(F.col("__n") / F.greatest(F.col("__n") - F.col("__edf"), F.lit(1.0)))
        scale = med.join(edf, keys).select(*keys, (MAD * F.col("__m") * factor).alias("__scale"))
        u = F.col("res") / (bisquare * F.col("__scale"))
        new = F.when(F.col("use") & (F.abs(u) < 1), (1 - u * u) ** 2).otherwise(0.0)
        moved = F.abs(F.col("__rw") - F.col("rw")) > 1e-4 + 1e-5 * F.abs("rw")
        nxt = cut_lineage(at.join(scale, keys, "left").withColumn("__rw", new))
        going = cut_lineage(nxt.groupBy(*keys).agg(
            F.bool_or(moved).alias("__moved"), F.max("__scale").alias("__s")).where(
            "__moved and __s > 1e-6").select(*keys))
        done.append((maps, at.join(going, keys, "left_anti")))
        if going.isEmpty():
            break
        left = nxt.join(going, keys, "left_semi").select(
            *ks, "beat", "time", "use", F.col("__rw").alias("rw"))
    segs, coefs, out = None, None, None
    for maps, at in done:
        own = at.select(*keys).distinct()
        s, c, p = (maps.segments.join(own, keys, "left_semi"),
                   maps.coefs.join(own, keys, "left_semi"), at)
        segs, coefs, out = (s, c, p) if segs is None else (
            segs.unionByName(s), coefs.unionByName(c), out.unionByName(p))
    return Maps(tuple(keys), segs, coefs), out


MICRO = 1e6


def tempo_positions(notes: DataFrame, keys: Sequence[str], pos: str, time: str) -> DataFrame:
    """One row per score position: median time, number of notes, and their spread."""
    keys = list(keys)
    k = [*keys, pos]
    d = notes.where(F.col(pos).isNotNull() & F.col(time).isNotNull())
    med = exact_quantiles(d, k, time, {"time": 0.5})
    n = d.groupBy(*k).agg(F.count("*").alias("n_notes"),
                          (F.max(time) - F.min(time)).alias("spread"))
    return n.join(med, k).withColumnRenamed(pos, "pos")


def tempo_breaks(pos: DataFrame, keys: Sequence[str], win: int, width: int,
                 marks: DataFrame | None = None) -> DataFrame:
    """Where the smooth curve is cut: (keys, pos, kind, type).

    A ``gap`` stands after its position: a pause, or a fermata at or before which it is the last
    position. A ``kink`` stands at its position: the first at or after a mark of a new tempo. No
    break stands at the first position, and none after or at the last. ``marks``: keys, pos, kind
    (``fermata`` or ``tempo_marking``). ``pos`` has whole micro-beats and times in microseconds.
    """
    keys = list(keys)
    p = pos.select(*keys, "pos", F.col("time").cast("double").alias("time"))
    pauses = detect_pauses(p, keys, win, width).where("pause").select(
        *keys, "pos", F.lit("pause").alias("kind"), F.lit("gap").alias("type"))
    if marks is None:
        return pauses
    ends = p.groupBy(*keys).agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    m = marks.select(*keys, F.col("pos").alias("mark"), "kind")
    at = p.select(*keys, F.col("pos").alias("at"))
    before = asof(m.where("kind = 'fermata'"), at, keys, "mark", "at", [], width)
    after = asof(m.where("kind <> 'fermata'"), at, keys, "mark", "at", [], width,
                 direction="forward")
    found = before.withColumn("type", F.lit("gap")).unionByName(after.withColumn(
        "type", F.lit("kink"))).where("hit_at is not null").join(ends, keys)
    inside = (F.col("hit_at") < F.col("__hi")) & (
        (F.col("type") == "gap") | (F.col("hit_at") > F.col("__lo")))
    placed = found.where(inside).select(*keys, F.col("hit_at").alias("pos"), "kind", "type")
    # a fermata names the gap that a pause would
    return placed.unionByName(pauses).groupBy(*keys, "pos", "type").agg(F.min("kind").alias("kind")
                                                                        ).select(*keys, "pos", "kind", "type")


def tempo_segments(pos: DataFrame, keys: Sequence[str], breaks: DataFrame, width: int) -> DataFrame:
    """Positions with ``seg``, the number of breaks before or at them, and ``shared``: the copy of
    a kink's position that the segment before it ends with (not after a gap, where time may jump)."""
    keys = list(keys)
    b = breaks.groupBy(*keys, "pos").agg(
        F.bool_or(F.col("type") == "gap").alias("gap"), F.bool_or(F.col("type") == "kink").alias("kink"))
    p = pos.join(b, [*keys, "pos"], "left").withColumn("gap", F.coalesce("gap", F.lit(False)))
    s = scan(p, keys, ["pos"], chunk_of("pos", width), __g=("prev", "gap")).withColumn(
        "__g", F.coalesce("__g", F.lit(False))).withColumn("kink", F.coalesce("kink", F.lit(False)))
    s = s.withColumn("__o", (F.col("__g") | F.col("kink")).cast("bigint"))
    s = scan(s, keys, ["pos"], chunk_of("pos", width), seg=("sum", "__o")).drop("__o")
    twin = F.when(F.col("kink") & ~F.col("__g"), F.array(F.lit(False), F.lit(True))).otherwise(
        F.array(F.lit(False)))
    s = s.withColumn("shared", F.explode(twin))
    return s.withColumn("seg", F.col("seg") - F.col("shared").cast("bigint")).drop("__g", "kink")


def tempo_fit(seg: DataFrame, keys: Sequence[str], period: float, *, spacing: float = 1.0,
              robust: int = 6) -> tuple[Maps, DataFrame]:
    """Time maps of segmented positions, and the positions with ``smooth``, ``period``, ``rw`` and
    what is left: ``dev`` in seconds, ``dev_beats``. Positions with ``gross`` set are not fitted."""
    keys = list(keys)
    use = ~F.col("gross") if "gross" in seg.columns else F.lit(True)
    p = seg.select(*keys, "seg", "shared", (F.col("pos") / MICRO).alias("beat"),
                   (F.col("time") / MICRO).alias("time"), use.alias("use"))
    if robust:
        maps, at = fit_time_map(p.drop("shared"), keys, period, spacing=spacing, robust=robust)
        at = evaluate(maps, at.drop("smooth", "period", "res")).join(
            p.select(*keys, "seg", "beat", "shared"), [*keys, "seg", "beat"])
    else:
        p = cut_lineage(p.withColumn("rw", F.when(F.col("use"), 1.0).otherwise(0.0)))
        maps = fit_weighted(p, keys, period, spacing)
        at = evaluate(maps, p)
    dev = F.col("time") - F.col("smooth")
    return maps, at.where("not shared").select(
        *keys, "seg", "beat", "time", "rw", "smooth", "period", dev.alias("dev"),
        (dev / F.col("period")).alias("dev_beats"))


def pause_excess(at: DataFrame, keys: Sequence[str], breaks: DataFrame) -> DataFrame:
    """How much longer each gap is than the smooth tempo before it makes it, in seconds."""
    keys = list(keys)
    n = scan(at, keys, ["beat"], chunk_of(F.col("beat"), WIDTH), __t=("lead", "time"),
             __b=("lead", "beat"))
    n = n.withColumn("pos", F.round(F.col("beat") * MICRO).cast("bigint"))
    g = breaks.where("type = 'gap'").join(n, [*keys, "pos"])
    return g.select(*keys, "pos", "kind", (F.col("__t") - F.col("time") - F.col("period") * (
        F.col("__b") - F.col("beat"))).alias("excess"))


def tempo_beats(maps: Maps, at: DataFrame) -> DataFrame:
    """The smooth curve on whole beats (on positions where there are fewer than two): ``period``,
    ``bpm``, and the log of the geometric mean period over it."""
    keys = list(maps.keys)
    ends = at.groupBy(*keys).agg(F.ceil(F.min("beat") - 1e-9).cast("bigint").alias("a"), F.floor(
        F.max("beat") + 1e-9).cast("bigint").alias("z"))
    grid = ends.where("z > a").select(*keys, F.explode(F.sequence("a", "z")).alias("beat")) \
        .withColumn("beat", F.col("beat").cast("double"))
    few = at.join(ends.where("z <= a"), keys, "left_semi").select(*keys, "beat")
    g = asof(grid.unionByName(few), maps.segments.select(*keys, "lo", "seg"), keys, "beat", "lo",
             ["seg"], WIDTH, right_tie="seg")
    # before the first segment that has one: the first
    first = maps.segments.groupBy(*keys).agg(F.min("seg").alias("__f"))
    g = g.join(first, keys).select(*keys, "beat", F.coalesce("seg", "__f").alias("seg"))
    g = evaluate(maps, g)
    mean = g.where("period > 0").groupBy(*keys).agg(F.exp(F.avg(F.ln("period"))).alias("__p"))
    return g.join(mean, keys, "left").select(
        *keys, "seg", "beat", "smooth", "period", (60 / F.col("period")).alias("bpm"),
        F.when(F.col("period") > 0, F.ln(F.col("__p") / F.col("period"))).alias("log_ratio"))


def tempo_jitter(maps: Maps, at: DataFrame) -> DataFrame:
    """Unevenness of performances, in ms and beats, made up for the freedom the fit takes: root mean
    square over n - edf, and 1.4826 median absolute deviations times the root of n / (n - edf)."""
    keys = list(maps.keys)
    ok = at.where("rw > 0")
    edf = maps.segments.groupBy(*keys).agg(F.sum("edf").alias("edf"))
    a = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("dev") ** 2).alias("ss"),
        F.sum(F.col("dev_beats") ** 2).alias("sb")).join(edf, keys)
    out, dof = a, F.greatest(F.col("n") - F.col("edf"), F.lit(1.0))
    for v in ("dev", "dev_beats"):
        mid = exact_quantiles(ok, keys, v, {"__m": 0.5})
        d = ok.join(mid, keys).withColumn("__a", F.abs(F.col(v) - F.col("__m")))
        out = out.join(exact_quantiles(d, keys, "__a", {f"__{v}": 0.5}), keys)
    k = F.sqrt(F.col("n") / dof)
    return out.select(
        *keys, "n", "edf", (1000 * F.sqrt(F.col("ss") / dof)).alias("rms_ms"),
        (1000 * k * MAD * F.col("__dev")).alias("mad_ms"),
        F.sqrt(F.col("sb") / dof).alias("rms_beats"), (k * MAD * F.col("__dev_beats")).alias(
            "mad_beats"))


def covered(points: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str, width: float,
            out: str = "covered") -> DataFrame:
    """``points`` with whether a span (keys, ``lo``, ``hi``) has lo <= pos < hi: a sweep that adds one
    where a span begins and takes it away where it ends, whatever their number or overlap."""
    keys = list(keys)
    edge = spans.where("hi > lo").select(*keys, F.explode(F.array(
        F.struct(F.col("lo").cast("double").alias("__x"), F.lit(1).alias("__d")),
        F.struct(F.col("hi").cast("double").alias("__x"), F.lit(-1).alias("__d")))).alias("e")).select(
        *keys, "e.*")
    # one row for each place, so that the order is strict; points come after what begins or ends there
    edge = edge.groupBy(*keys, "__x").agg(F.sum("__d").alias("__d")).withColumn("__k", F.lit(0))
    rows = points.withColumn("__row", F.struct(*points.columns)).select(
        *keys, F.col(pos).cast("double").alias("__x"), "__row", F.lit(1).alias("__k"))
    both = rows.withColumn("__d", F.lit(0).cast("bigint")).unionByName(edge, allowMissingColumns=True)
    s = scan(both, keys, ["__x", "__k"], chunk_of(F.col("__x"), width), __open=("sum", "__d"))
    return s.where("__row is not null").select("__row.*", (F.col("__open") > 0).alias(out))


def tempo_stability(beats: DataFrame, at: DataFrame, keys: Sequence[str], phrase: float, *,
                    spans: DataFrame | None = None, min_span: float = 16.0, robust: int = 6
                    ) -> DataFrame:
    """Wobble of the smooth tempo beyond its phrases, by section (keys, seg).

    ``beats`` and ``at`` come from :func:`tempo_beats` and :func:`tempo_fit`. Each section of at least
    six positions over ``min_span`` beats gets a curve of its own at phrase level; on the whole
    beats inside, and outside ``spans`` (keys, lo, hi: marked changes of tempo), the two are
    compared: n_beats, section_sd and phrase_sd of the log tempo, instability (root mean square
    of their difference) and drift (of the line through the log tempo, from first to last beat).
    Sections with fewer than three such beats are left out.
    """
    keys = list(keys)
    ks = [*keys, "seg"]
    live = at.where("rw > 0")
    size = live.groupBy(*ks).agg(F.count("*").alias("__n"), F.min("beat").alias("__a"), F.max(
        "beat").alias("__z")).where((F.col("__n") >= 6) & (F.col("__z") - F.col("__a") >= min_span))
    size = cut_lineage(size)
    own = live.join(size, ks).select(*keys, F.col("seg").alias("section"), F.lit(0).cast(
        "bigint").alias("seg"), "beat", "time", F.lit(True).alias("use"))
    kp = [*keys, "section"]
    if robust:
        maps, _ = fit_time_map(own, kp, phrase, robust=robust)
    else:
        maps = fit_weighted(own.withColumn("rw", F.lit(1.0)), kp, phrase)
    inside = beats.join(size, ks).where(F.col("beat").between(F.col("__a"), F.col("__z")))
    if spans is not None:
        inside = covered(inside, spans, keys, "beat", WIDTH).where("not covered")
    g = inside.select(*keys, F.col("seg").alias("section"), F.lit(0).cast("bigint").alias("seg"), "beat",
                      "log_ratio", (F.col("log_ratio") + F.ln("period")).alias("__log"))
    g = evaluate(maps, g).where("period > 0 and log_ratio is not null").withColumn(
        "__ph", F.col("__log") - F.ln("period"))
    out = g.groupBy(*kp).agg(
        F.count("*").alias("n_beats"), F.stddev_pop("log_ratio").alias("section_sd"),
        F.stddev_pop("__ph").alias("phrase_sd"),
        F.sqrt(F.avg((F.col("log_ratio") - F.col("__ph")) ** 2)).alias("instability"),
        (F.regr_slope("log_ratio", "beat") * (F.max("beat") - F.min("beat"))).alias("drift"))
    return out.where("n_beats >= 3").withColumnRenamed("section", "seg")


def stability_summary(sections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each performance: sections pooled by their beats, mean square for spreads, mean size of
    the drift."""
    w = F.col("n_beats")
    return sections.groupBy(*keys).agg(
        F.count("*").alias("n_sections"),
        *[F.sqrt(F.sum(w * F.col(c) ** 2) / F.sum(w)).alias(c) for c in (
            "instability", "section_sd", "phrase_sd")],
        (F.sum(w * F.abs("drift")) / F.sum(w)).alias("drift"))


def grid_curves(beats: DataFrame, at: DataFrame, notes: DataFrame, grid: DataFrame,
                keys: Sequence[str], per_bar: float, beat: str = "beat", velocity: str = "velocity"
                ) -> DataFrame:
    """keys, beat, ``tempo``, ``velocity`` on a grid of whole beats that performances share.

    ``tempo`` is the smooth log ratio, null outside the performance and where no kept position lies
    within a bar of the beat; ``velocity`` the mean of the notes that begin in [beat, beat + 1), null
    where there are none. ``grid``: keys, beat. One long table; arrays can be made of it.
    """
    keys = list(keys)
    good = at.where("rw > 0").select(*keys, F.col("beat").alias("__b"))
    g = asof(grid.select(*keys, "beat", (F.col("beat") + per_bar + 1e-9).alias("__z")), good, keys,
             "__z", "__b", [], WIDTH)
    near = F.coalesce(F.col("hit___b") >= F.col("beat") - per_bar - 1e-9, F.lit(False))
    t = beats.select(*keys, F.round("beat").alias("beat"), "log_ratio").where(
        F.col("log_ratio").isNotNull())
    v = notes.groupBy(*keys, F.floor(F.col(beat) + 1e-6).cast("double").alias("beat")).agg(
        F.avg(velocity).alias("velocity"))
    k = [*keys, "beat"]
    return g.join(t, k, "left").join(v, k, "left").select(
        *k, F.when(near, F.col("log_ratio")).alias("tempo"), "velocity")


def references_on_target(curves: DataFrame, targets: DataFrame, offsets: DataFrame,
                         keys: Sequence[str], item: str, width: int) -> DataFrame:
    """Reference values at the target's positions: (keys, item, pos, value).

    ``curves``: keys, item, pos, value at the references' own positions; ``targets``: keys, pos;
    ``offsets``: keys, pos, offset, how the target's score lies in the references'. A target position
    between two mapped ones counts only where both have one offset; what is not mapped, or has no
    reference value, gives no row. Positions are whole micro-beats, so they meet exactly.
    """
    keys = list(keys)
    m = beat_map(targets.select(*keys, "pos").distinct(), offsets, keys, "pos", width).where(
        "ref_pos is not null")
    ref = curves.select(*keys, item, F.col("pos").alias("ref_pos"), "value").where(
        F.col("value").isNotNull())
    return m.join(ref, [*keys, "ref_pos"]).select(*keys, item, "pos", "value")


def tempo_flatten(at: DataFrame, notes: DataFrame, keys: Sequence[str], alpha: float, width: int, *,
                  least_us: float = 20_000.0) -> DataFrame:
    """``notes`` with ``new_onset_us`` and ``new_duration_us``: time warped towards a constant tempo.

    ``alpha`` 0 leaves them as they are, 1 gives every beat the same time between the first and
    the last position. Onsets and releases go from time to beat along the smooth curve of ``at``
    (its running maximum, so that it never turns back; end tempos go on beyond it) and are mixed
    with the even time of that beat. Durations are no shorter than ``least_us``; notes of performances
    without a curve of some length are left out.
    """
    keys = list(keys)
    up = scan(at.select(*keys, "beat", (F.col("smooth") * MICRO).alias("__s")), keys, ["beat"],
              chunk_of(F.col("beat"), WIDTH), kt=("max", "__s"))
    knots = cut_lineage(up.groupBy(*keys, "kt").agg(F.max("beat").alias("kb")))
    ends = at.groupBy(*keys).agg(
        F.min("beat").alias("__b0"), F.max("beat").alias("__b1"),
        F.min_by("period", "beat").alias("__p0"), F.max_by("period", "beat").alias("__p1")).join(
        knots.groupBy(*keys).agg(F.min("kt").alias("__t0"), F.max("kt").alias("__t1")), keys).where(
        "__b1 > __b0 and __p0 > 0 and __p1 > 0")
    out = notes.join(ends, keys).withColumn("__on", F.col("onset_us").cast("double")).withColumn(
        "__off", F.col("__on") + F.col("duration_us"))
    even = (F.col("__t1") - F.col("__t0")) / (F.col("__b1") - F.col("__b0"))
    for x in ("__on", "__off"):
        out = interpolate(out, knots, keys, x, "kt", "kb", width, f"{x}_b", extrapolate=False)
        t = F.col(x)
        b = F.when(t < F.col("__t0"), F.col("__b0") + (t - F.col("__t0")) / (F.col("__p0") * MICRO)).when(
            t > F.col("__t1"), F.col("__b1") + (t - F.col("__t1")) / (F.col("__p1") * MICRO)).otherwise(
            F.col(f"{x}_b"))
        out = out.withColumn(f"{x}_n", (1 - alpha) * t + alpha * (F.col("__t0") + (
            b - F.col("__b0")) * even))
    return out.select(
        *notes.columns, F.greatest(F.lit(0.0), F.col("__on_n")).alias("new_onset_us"),
        F.greatest(F.lit(least_us), F.col("__off_n") - F.col("__on_n")).alias("new_duration_us"))
