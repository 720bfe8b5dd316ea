import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from ritardo.operators import isotonic as I
from ritardo.operators import rowmatch as R
from ritardo.operators import schedule as S
from ritardo.operators import spans as SP


def sequential(y, w):
    pools = []
    for a, b in zip(y, w, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            m, v, n = pools.pop()
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + m * v) / (p[1] + v), p[1] + v, p[2] + n]
    return [m for m, _, n in pools for _ in range(n)]


@pytest.mark.parametrize("block", [4096, 4])
def test_isotonic_is_the_sequential_fit(spark, block, monkeypatch):
    monkeypatch.setattr(I, "BLOCK", block)
    rnd = random.Random(block)
    runs = {"up": [i + rnd.gauss(0, 3) for i in range(120)], "down": [-float(i) for i in range(70)],
            "flat": [2.0] * 30, "one": [5.0], "saw": [float(i % 7) for i in range(50)]}
    w = {k: [rnd.choice([1.0, 2.0, 5.0]) for _ in v] for k, v in runs.items()}
    df = spark.createDataFrame([(k, i, y, w[k][i]) for k, v in runs.items() for i, y in enumerate(v)],
                               "k string, i long, y double, w double")
    got = {}
    for r in sorted(I.isotonic(df, ["k"], "i", "y", "w", 16).collect(), key=lambda r: r.i):
        got.setdefault(r.k, []).append(r.fit)
    for k, v in runs.items():
        assert got[k] == pytest.approx(sequential(v, w[k]))
    assert I.isotonic(df.limit(0), ["k"], "i", "y", "w", 16).count() == 0


def brute_map(beats, times, outlier=0.25, edge=6, share=0.1):
    kb = sorted(set(beats))
    kt = [float(np.median([t for b, t in zip(beats, times, strict=True) if b == x])) for x in kb]
    kw = [float(beats.count(x)) for x in kb]
    most, dropped = max(1, int(share * len(kb))), 0
    fit = sequential(kt, kw)
    while len(kt) > 2 and dropped < most:
        res = [abs(a - b) for a, b in zip(kt, fit, strict=True)]
        i = res.index(max(res))
        if res[i] <= max(outlier, 4 * 1.4826 * float(np.median(res))):
            break
        for a in (kb, kt, kw):
            del a[i]
        fit = sequential(kt, kw)
        dropped += 1

    def slope(b, s):
        d = [(y1 - y0) / (x1 - x0) for x0, x1, y0, y1 in zip(b, b[1:], s, s[1:], strict=False)]
        v = float(np.median(d)) if d else 0
        return v if v > 0 else 0.5

    return (dict(zip(kb, fit, strict=True)), dropped, slope(kb[:edge + 1], fit[:edge + 1]),
            slope(kb[-edge - 1:], fit[-edge - 1:]))


def test_note_time_map_leaves_outliers_out(spark):
    rnd = random.Random(4)
    plays = {}
    for k, n, bad in (("a", 40, (7, 22)), ("b", 12, ()), ("c", 1, ())):
        beats = [float(i) for i in range(n) for _ in range(1 + i % 3)]
        times = [0.5 * b + rnd.gauss(0, 0.01) + (3.0 if b in bad else 0) for b in beats]
        plays[k] = (beats, times)
    rows = [(k, b, t) for k, (bs, ts) in plays.items() for b, t in zip(bs, ts, strict=True)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 1.0, None)],
                               "k string, beat double, t double")
    knots, ends = I.note_time_map(df, ["k"], "beat", "t", 64)
    fit = {(r.k, r.beat): r.fit for r in knots.collect()}
    end = {r.k: r for r in ends.collect()}
    for k, (bs, ts) in plays.items():
        want, dropped, before, after = brute_map(bs, ts)
        assert {b: v for (p, b), v in fit.items() if p == k} == pytest.approx(want)
        assert end[k].dropped == dropped
        assert (end[k].before, end[k].after) == pytest.approx((before, after))
    assert end["a"].dropped == 2 and ("a", 7.0) not in fit and ("a", 22.0) not in fit


def test_spans_against_walks(spark):
    rnd = random.Random(9)
    bars, spans, want = [], [], {}
    for k in range(60):
        n = rnd.randrange(1, 30)
        notes = [rnd.choice([0, 0, 3, 8, 20]) for _ in range(n)]
        missed = [rnd.randrange(x + 1) for x in notes]
        first = rnd.randrange(n)
        last = rnd.randrange(first, n)
        wf, wl = rnd.random() < 0.7, rnd.random() < 0.7
        f, z = first, last
        added = steps = 0
        while wf and f > 0 and (steps < 2 or added < 16):
            f, steps = f - 1, steps + 1
            added += notes[f]
        added = steps = 0
        while wl and z < n - 1 and (steps < 2 or added < 16):
            z, steps = z + 1, steps + 1
            added += notes[z]
        gone = [m == 0 or x >= 0.5 * m for m, x in zip(notes, missed, strict=True)]
        a, b = first, last
        while wf and a < b and gone[a]:
            a += 1
        while wl and b > a and gone[b]:
            b -= 1
        want[k] = (f, z, a, b)
        bars += [(k, i, x, y) for i, (x, y) in enumerate(zip(notes, missed, strict=True))]
        spans.append((k, first, last, wf, wl, wf, wl))
    bars = spark.createDataFrame(bars, "k long, row long, notes long, missed long")
    spans = spark.createDataFrame(spans, "k long, first long, last long, widen_first boolean, "
                                         "widen_last boolean, shrink_first boolean, shrink_last boolean")
    wide = {r.k: r for r in SP.widen_spans(bars, spans, ["k"], 8).collect()}
    tight = {r.k: r for r in SP.shrink_spans(bars, spans, ["k"]).collect()}
    assert {k: (wide[k].wide_first, wide[k].wide_last, tight[k].tight_first, tight[k].tight_last)
            for k in want} == want


@pytest.mark.parametrize("sizes,listeners,trials", [((5, 4, 1, 2), 9, 7), ((6,), 10, 3), ((1,), 3, 3)])
def test_every_pair_is_judged_about_equally_often(spark, sizes, listeners, trials):
    items = [(p, 100 * p + i) for p, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame([*items, items[0], (0, None)], "passage long, item long")
    got = S.pair_schedule(df, "passage", "item", listeners, trials, seed=2).collect()
    pairs = [(p, 100 * p + i, 100 * p + j) for p, n in enumerate(sizes)
             for i, j in combinations(range(n), 2)]
    assert len(got) == (listeners * trials if pairs else 0)
    seen = Counter((r.passage, min(r.first, r.second), max(r.first, r.second)) for r in got)
    assert set(seen) <= set(pairs)
    if pairs:
        counts = [seen[p] for p in pairs]
        assert max(counts) - min(counts) <= 1
        assert len({(r.listener, r.trial) for r in got}) == len(got)
        ahead = Counter((r.passage, r.first, r.second) for r in got)
        assert all(abs(ahead[p, i, j] - ahead[p, j, i]) <= 1 for p, i, j in pairs)


ROW = ("page long, row long, text array<string>, targets array<string>, bars array<long>, kind string")


def jaccard(x, y):
    x, y = set(x or ()) - {None}, set(y or ()) - {None}
    return len(x & y) / len(x | y) if x and y else 0.0


def brute_rows(a, b):
    cands = []
    for p, i, ta, ga, ba, ka in a:
        for q, j, tb, gb, bb, kb in b:
            ba_, bb_ = set(ba or ()), set(bb or ())
            if p != q or not (ba_ & bb_ or not ba_ and not bb_):
                continue
            score, why = max((jaccard(ta, tb), "text"), (jaccard(ga, gb), "targets"))
            if score < 0.5:
                if ka is None or ka != kb:
                    continue
                score, why = max(len(ba_ & bb_) / max(1, len(ba_ | bb_)), 0.01), ka
            cands.append((-score, i, j, p, why))
    used, out = set(), []
    for s, i, j, p, why in sorted(cands):
        if (p, "a", i) not in used and (p, "b", j) not in used:
            used |= {(p, "a", i), (p, "b", j)}
            out.append((p, i, j, round(-s, 9), why))
    return sorted(out)


def test_rows_of_two_annotators(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(12)]

    def rows(base):
        out = []
        for i in range(40):
            text = ["the", *rnd.sample(words, rnd.randrange(0, 5))]  # one word is everywhere
            out.append((i % 3, base + i, rnd.choice([text, [], None, ["the"]]),
                        rnd.choice([None, [], rnd.sample(["x", "y", "z"], 2)]),
                        rnd.choice([[], None, [rnd.randrange(4)], [1, 2]]),
                        rnd.choice([None, None, "digits", "labels"])))
        return out

    a, b = rows(0), rows(100)
    fa, fb = (spark.createDataFrame(x, ROW) for x in (a, b))
    got = R.match_rows(fa, fb, ["page"], "row", "text", "bars", "targets", "kind").collect()
    assert sorted((r.page, r.a, r.b, round(r.score, 9), r.why) for r in got) == brute_rows(a, b)


def test_overlaps_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "MATCHES", 50)
    monkeypatch.setattr(R, "PAIRS", 3)
    rnd = random.Random(8)
    sides = []
    for _ in "ab":
        sides.append({i: (i % 2, {f"w{min(int(rnd.expovariate(0.2)), 30)}" for _ in range(rnd.randint(0, 12))})
                      for i in range(90)})
    want = {(x[0], i, j): len(x[1] & y[1]) / len(x[1] | y[1]) for i, x in sides[0].items()
            for j, y in sides[1].items() if x[0] == y[0] and x[1] and y[1]}
    want = {k: v for k, v in want.items() if v >= 0.5}
    df = [spark.createDataFrame([(p, i, sorted(t)) for i, (p, t) in s.items()],
                                "page int, row bigint, t array<string>") for s in sides]
    o = R.overlapping(*df, ["page"], "row", "t")
    got = {(r.page, r.a, r.b): r.score for r in o.collect()}
    assert got == want and len(want) > 50
    assert o.count() == len(want)
    # no pair of rows goes through a shuffle: only rows, once for each block of the other side
    plan = o._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "array_intersect" not in plan


def test_kappas(spark):
    rows = [("x", 0, 0)] * 5 + [("x", 1, 2)] * 2 + [("x", 2, 2)] * 3 + [("y", 1, 1)] * 4
    got = {r.k: r for r in R.kappas(spark.createDataFrame(rows, "k string, a long, b long"), ["k"],
                                    "a", "b", 3).collect()}
    po, pe = 0.8, (5 * 5 + 3 * 5) / 100
    assert got["x"].kappa == pytest.approx((po - pe) / (1 - pe))
    exp = (5 * 5 * 1.0 + 2 * 5 * 0.5 + 2 * 5 * 0.5 + 3 * 5 * 1.0) / 10
    assert got["x"].weighted_kappa == pytest.approx(1 - 2 * 0.5 / exp)
    assert got["y"].kappa is None and got["y"].weighted_kappa is None
    assert not math.isnan(got["x"].kappa)


def test_overlaps_go_to_few_tasks(spark, monkeypatch):
    """Rows were sent to as many tasks as the other side had blocks of 8,192 rows."""
    monkeypatch.setattr(R, "BLOCK", 4)
    tasks, real = spark.sparkContext.accumulator(0), R._similar

    def counted(*x):
        tasks.add(1)
        return real(*x)

    monkeypatch.setattr(R, "_similar", counted)
    df = spark.range(200).selectExpr("1 as page", "id as row", "array(concat('w', id), concat('v', id)) as t")
    o = R.overlapping(df, df, ["page"], "row", "t")
    assert sorted((r.a, r.b, r.score) for r in o.collect()) == [(i, i, 1.0) for i in range(200)]
    assert 0 < tasks.value <= 16


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_against_brute_force(monkeypatch, least):
    monkeypatch.setattr(R, "MATCHES", 300)
    monkeypatch.setattr(R, "PAIRS", 3)
    rnd = random.Random(9)
    base = [rnd.sample(range(400), rnd.choice([1, 2, 5, 20, 60, 150])) for _ in range(12)]

    def near():
        t = set(rnd.choice(base))
        gone = set(rnd.sample(sorted(t), rnd.randint(0, len(t) // 2)))
        return sorted(t - gone | set(rnd.sample(range(400), rnd.randint(0, len(gone)))))

    a, b = ([near() for _ in range(80)] for _ in "ab")

    def flat(sets):
        return np.array([len(t) for t in sets]), np.array([v for t in sets for v in t], np.int32)

    i, j, score = R._similar(*flat(a), *flat(b), least)
    got = dict(zip(zip(i.tolist(), j.tolist(), strict=True), score.tolist(), strict=True))
    want = {(i, j): len(set(x) & set(y)) / len(set(x) | set(y)) for i, x in enumerate(a)
            for j, y in enumerate(b)}
    assert got == {k: v for k, v in want.items() if v >= least} and len(got) == len(i) > 5


def test_numbers_of_tokens_that_share_a_half(spark, monkeypatch):
    t = [(1 << 32) + 1, (1 << 32) + 2, (2 << 32) + 1, -5, -6, (2 ** 31 - 1 << 32) + 7, 2 ** 62]
    n = R._numbers([spark.createDataFrame([(t,)], "t array<bigint>")] * 2)
    out = n.of(np.array(t, np.int64))
    assert out.dtype == np.int32 and len(set(out.tolist())) == len(t)
    assert n.often.sum() == 2 * len(t)
    monkeypatch.setattr(R, "ODD", 2)
    assert n.of(np.array(t, np.int64)).tolist() == t
