import math
import random

import numpy as np
import pytest

from ritardo.operators import blocksolve as B
from ritardo.operators import tempo as T


def dense_fit(x, y, w, period, spacing=1.0):
    """One segment by dense algebra: value and slope at any beat, and the degrees of freedom."""
    lo, hi, n = x.min(), x.max(), len(x)
    if n < 4 or hi - lo < 1e-9:
        if n >= 2 and hi - lo > 1e-9:
            b, a = np.polyfit(x, y, 1, w=np.sqrt(w))
            return lambda q: a + b * q, lambda q: b + 0 * q, 2.0
        return lambda q: y.mean() + 0 * q, None, 1.0
    k = max(1, math.ceil((hi - lo) / spacing - 1e-9))
    h = (hi - lo) / k

    def design(q, slope=False):
        u = (np.clip(q, lo, hi) - lo) / h
        c = np.minimum(np.floor(u), k - 1).astype(int)
        u = u - c
        b = [(1 - u) ** 3 / 6, (3 * u**3 - 6 * u**2 + 4) / 6,
             (-3 * u**3 + 3 * u**2 + 3 * u + 1) / 6, u**3 / 6]
        if slope:
            b = [-((1 - u) ** 2) / 2, (3 * u**2 - 4 * u) / 2, (-3 * u**2 + 2 * u + 1) / 2, u**2 / 2]
        m = np.zeros((len(u), k + 3))
        for i in range(4):
            m[np.arange(len(u)), c + i] = b[i]
        return m / (h if slope else 1)

    m = design(x)
    d = np.diff(np.eye(k + 3), n=3, axis=0)
    g = m.T @ (m * w[:, None])
    a = g + T.cutoff_to_lambda(period, h) * d.T @ d + 1e-10 * np.eye(k + 3)
    c = np.linalg.solve(a, m.T @ (w * y))

    def rate(q):
        return design(q, True) @ c

    def value(q):
        ends = np.array([lo, hi])
        r = rate(ends)
        return design(q) @ c + np.minimum(q - lo, 0) * r[0] + np.maximum(q - hi, 0) * r[1]

    return value, rate, float(np.trace(np.linalg.solve(a, g)))


def spacing(x):
    if len(x) == 1:
        return np.ones(1)
    d = np.diff(x)
    return np.clip(np.concatenate([[d[0]], (d[:-1] + d[1:]) / 2, [d[-1]]]), 1e-3, 4)


def robust_fit(x, y, seg, use, period, rounds=6):
    """Piecewise robust fit, round by round."""
    rw = use.astype(float)

    def fit():
        smooth, edf = np.full(len(x), np.nan), 0.0
        for s in np.unique(seg):
            m = (seg == s) & (rw > 0)
            m = m if m.any() else seg == s
            f, _, e = dense_fit(x[m], y[m], spacing(x[m]) * np.where(rw[m] > 0, rw[m], 1), period)
            smooth[seg == s] = f(x[seg == s])
            edf += e
        return smooth, edf

    smooth, edf = fit()
    for _ in range(rounds):
        r = y - smooth
        n = use.sum()
        scale = T.MAD * np.median(np.abs(r[use])) * math.sqrt(n / max(n - edf, 1))
        if scale <= 1e-6:
            break
        u = r / (4.685 * scale)
        new = np.where(use & (np.abs(u) < 1), (1 - u * u) ** 2, 0.0)
        if np.allclose(new, rw, atol=1e-4):
            break
        rw = new
        smooth, edf = fit()
    return smooth, rw, edf


@pytest.fixture
def short_spans(monkeypatch):
    """Spans of three nodes, so that small systems take several levels."""
    monkeypatch.setattr(B, "SPAN", 3)
    monkeypatch.setattr(T, "COEFS", 9)


def planted(n, rnd, gap=0.5, noise=0.01):
    x = np.arange(n) * gap
    return x, 2 + 0.5 * x + 0.3 * np.sin(x / 6) + np.array([rnd.gauss(0, noise) for _ in x])


def frame(spark, rows):
    return spark.createDataFrame(rows, "perf string, seg long, beat double, time double, rw double, "
                                       "use boolean")


def test_weighted_fit_is_the_dense_one(spark, short_spans):
    rnd = random.Random(2)
    rows, want = [], {}
    for perf, sizes in {"a": [90], "b": [5, 1, 40], "c": [1], "d": [3, 2], "e": [4]}.items():
        at = 0.0
        for seg, n in enumerate(sizes):
            x, y = planted(n, rnd)
            x = x + at + np.sort(np.array([rnd.random() for _ in x])) * 0.2
            w = np.array([rnd.choice([0.2, 0.7, 1.0, 0.0 if 5 < i < n - 5 else 1.0])
                          for i in range(n)])
            rows += [(perf, seg, float(a), float(b), float(c), True)
                     for a, b, c in zip(x, y, w, strict=True)]
            live = w > 0
            want[perf, seg] = (*dense_fit(x[live], y[live], spacing(x[live]) * w[live], 6.0), x, y)
            at = float(x[-1]) + 1.0
    maps = T.fit_weighted(frame(spark, rows), ["perf"], 6.0)
    got = {(r.perf, r.seg): r for r in maps.segments.collect()}
    probe = [(p, s, float(q)) for (p, s), w in want.items()
             for q in np.linspace(w[3][0] - 1, w[3][-1] + 1, 17)]
    out = T.evaluate(maps, spark.createDataFrame(probe, "perf string, seg long, beat double"))
    vals = {(r.perf, r.seg, r.beat): r for r in out.collect()}
    assert len(vals) == len(probe)
    for (p, s), (f, rate, edf, x, y) in want.items():
        assert got[p, s].edf == pytest.approx(edf, abs=1e-7)
        for q in (b for a, c, b in probe if (a, c) == (p, s)):
            v = vals[p, s, q]
            if rate is None:  # alone: the slope of its neighbour, through its mean
                near = 1.0
                if p == "b":
                    before, after = want["b", 0], want["b", 2]
                    late = after[3][0] - x[0] < x[0] - before[3][-1]
                    near = (after[1](after[3][:1]) if late else before[1](before[3][-1:]))[0]
                assert v.period == pytest.approx(near, abs=1e-8)
                assert v.smooth == pytest.approx(y[0] + near * (q - x[0]), abs=1e-8)
            else:
                assert v.smooth == pytest.approx(f(np.array([q]))[0], abs=1e-7)
                assert v.period == pytest.approx(rate(np.array([q]))[0], abs=1e-7)


def test_robust_fit_rejects_planted_errors(spark):
    rnd = random.Random(5)
    rows, truth = [], {}
    for perf in ("p", "q"):
        x, y = planted(120, rnd)
        seg = (np.arange(120) >= 70).astype(int)
        y = y + 3.0 * seg  # a held gap
        wrong = sorted(rnd.sample(range(3, 117), 6))
        y[wrong] += np.array([rnd.choice([-1, 1]) * 0.4 for _ in wrong])
        use = np.ones(120, bool)
        use[[10, 90]] = False
        truth[perf] = (x, y, seg, use, wrong)
        rows += [(perf, int(s), float(a), float(b), 1.0, bool(u))
                 for a, b, s, u in zip(x, y, seg, use, strict=True)]
    rows += [("exact", 0, float(i), 0.5 * i, 1.0, True) for i in range(20)]  # no scale to speak of
    maps, pos = T.fit_time_map(frame(spark, rows), ["perf"], 6.0, robust=3)
    got = {(r.perf, r.beat): r for r in pos.collect()}
    edf = {r.perf: r.e for r in maps.segments.groupBy("perf").agg({"edf": "sum"}).toDF(
        "perf", "e").collect()}
    assert len(got) == len(rows)
    for perf, (x, y, seg, use, wrong) in truth.items():
        smooth, rw, want_edf = robust_fit(x, y, seg, use, 6.0, 3)
        assert edf[perf] == pytest.approx(want_edf, abs=1e-6)
        for i, b in enumerate(x):
            r = got[perf, b]
            assert r.smooth == pytest.approx(smooth[i], abs=1e-6)
            assert r.rw == pytest.approx(rw[i], abs=1e-5)
        assert all(got[perf, x[i]].rw == 0 for i in wrong)
        clean = [i for i in range(120) if i not in wrong and use[i]]
        assert sum(got[perf, x[i]].rw > 0 for i in clean) >= 0.97 * len(clean)


def test_empty(spark):
    maps, pos = T.fit_time_map(frame(spark, []), ["perf"], 6.0)
    assert pos.count() == 0 and maps.segments.count() == 0


def test_covered_by_any_of_many_spans(spark):
    rnd = random.Random(3)
    spans = [(k, a, a + rnd.choice([0, 1, 4, 30])) for k in "ab" for a in (
        rnd.randrange(100) for _ in range(12))] + [("a", 10, 10), ("c", 1, 2)]
    points = [(k, i / 2) for k in "abd" for i in range(260)]
    s = spark.createDataFrame([(k, float(a), float(b)) for k, a, b in spans], "k string, lo double, hi double")
    p = spark.createDataFrame(points, "k string, beat double")
    for width in (4096, 16):
        got = {(r.k, r.beat): r.covered for r in T.covered(p, s, ["k"], "beat", width).collect()}
        assert got == {(k, x): any(q == k and a <= x < b for q, a, b in spans) for k, x in points}
    assert not any(r.covered for r in T.covered(p, s.limit(0), ["k"], "beat", 64).collect())


def test_steady_tempo_is_stable_and_a_wobble_is_not(spark):
    rows = []
    for perf, swing in (("even", 0.0), ("wobble", 0.08)):
        x = np.arange(80) * 0.5
        period = 0.5 * np.exp(swing * np.sin(2 * np.pi * x / 8))
        y = np.concatenate([[0.0], np.cumsum(period[:-1] * 0.5)])
        rows += [(perf, int(b * 1e6), float(t * 1e6)) for b, t in zip(x, y, strict=True)]
    pos = spark.createDataFrame(rows, "perf string, pos long, time double")
    none = spark.createDataFrame([], "perf string, pos long, kind string, type string")
    seg = T.tempo_segments(pos, ["perf"], none, 10**8)
    maps, at = T.tempo_fit(seg, ["perf"], 4.0, robust=0)
    sec = T.tempo_stability(T.tempo_beats(maps, at), at, ["perf"], 24.0, robust=0)
    got = {r.perf: r for r in T.stability_summary(sec, ["perf"]).collect()}
    assert got["even"].instability < 1e-3 < 0.02 < got["wobble"].instability
    assert abs(got["even"].drift) < 1e-3


def test_references_only_where_the_map_holds(spark):
    offs = spark.createDataFrame([("s", 0, 5), ("s", 10, 5), ("s", 20, 9), ("s", 30, None)],
                                 "k string, pos long, offset long").where("offset is not null")
    curves = spark.createDataFrame([("s", "r", p, float(p)) for p in (5, 10, 15, 29, 40)] + [
        ("s", "q", 15, None)], "k string, ref string, pos long, value double")
    target = spark.createDataFrame([("s", p) for p in (0, 5, 10, 15, 20, 10)], "k string, pos long")
    got = sorted((r.pos, r.ref, r.value) for r in T.references_on_target(
        curves, target, offs, ["k"], "ref", 100).collect())
    assert got == [(0, "r", 5.0), (5, "r", 10.0), (10, "r", 15.0), (20, "r", 29.0)]


def test_flattened_tempo_is_even(spark):
    beat = np.arange(41) * 0.5
    smooth = 1 + 0.5 * beat + 0.4 * np.sin(beat / 3)
    period = 0.5 + 0.4 / 3 * np.cos(beat / 3)
    at = spark.createDataFrame([("p", float(b), float(t), float(s)) for b, t, s in zip(
        beat, smooth, period, strict=True)], "perf string, beat double, smooth double, period double")
    on = np.concatenate([smooth[:-1] * 1e6, [0.0, 14e6]])
    off = np.concatenate([smooth[1:] * 1e6, [0.5e6, 15e6]])
    notes = spark.createDataFrame([("p", i, float(a), float(b - a)) for i, (a, b) in enumerate(zip(
        on, off, strict=True))] + [("none", 99, 0.0, 1.0)], "perf string, id long, onset_us double, "
                                                            "duration_us double")
    for alpha in (0.0, 0.6, 1.0):
        got = {r.id: r for r in T.tempo_flatten(at, notes, ["perf"], alpha, 10**6).collect()}
        assert set(got) == set(range(42))
        even = smooth[0] + beat * (smooth[-1] - smooth[0]) / 20
        want = ((1 - alpha) * smooth + alpha * even) * 1e6
        assert [got[i].new_onset_us for i in range(40)] == pytest.approx(want[:-1], abs=0.01)
        assert [got[i].new_duration_us for i in range(40)] == pytest.approx(np.diff(want), abs=0.01)
        if alpha == 0:
            assert got[40].new_onset_us == pytest.approx(0, abs=0.01)
            assert got[41].new_duration_us == pytest.approx(1e6, abs=0.01)


def test_one_performance_with_most_of_the_notes(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for perf, n in (("hot", 6000), ("x", 300), ("y", 200)):
        x, y = planted(n, rnd, noise=0.02)
        rows += [(perf, 0, float(a), float(b), 1.0, True) for a, b in zip(x, y, strict=True)]
        want[perf] = (x, *dense_fit(x, y, spacing(x), 6.0))
    df = spark.createDataFrame(rows, "perf string, seg long, beat double, time double, rw double, "
                                     "use boolean")
    maps = T.fit_weighted(df, ["perf"], 6.0)
    assert maps.coefs.where("perf = 'hot'").count() > 5  # many spans, no one array
    edf = {r.perf: r.edf for r in maps.segments.collect()}
    got = {(r.perf, r.beat): r for r in T.evaluate(maps, df).collect()}
    for perf, (x, f, rate, e) in want.items():
        assert edf[perf] == pytest.approx(e, rel=1e-8)
        assert np.abs(np.array([got[perf, b].smooth for b in x]) - f(x)).max() < 1e-6
        assert np.abs(np.array([got[perf, b].period for b in x]) - rate(x)).max() < 1e-6
