"""Folds in blocks: a run much longer than a block equals the plain walk."""

import random
import time

from ritardo.operators import folds
from ritardo.operators import matching as M
from ritardo.operators import sequences as S


def walk(ref, est, tol):
    i = j = 0
    out = []
    while i < len(ref) and j < len(est):
        if est[j][0] < ref[i][0] - tol:
            j += 1
        elif est[j][0] > ref[i][0] + tol:
            i += 1
        else:
            out.append((ref[i][1], est[j][1]))
            i += 1
            j += 1
    return out


def test_one_long_chain_of_notes(spark):
    rnd = random.Random(2)
    n = 20_000
    ref = sorted((i * 40_000 + rnd.randrange(30_000), i) for i in range(n))
    est = sorted((t + rnd.randrange(-45_000, 45_000), 10**6 + i) for t, i in ref if rnd.random() < 0.9)
    schema = "performance_id bigint, onset_us bigint, note_id bigint, pitch bigint"
    df = [spark.createDataFrame([(1, t, i, 60) for t, i in rows], schema) for rows in (ref, est)]
    t0 = time.time()
    got = M.match_notes(*df, ["performance_id"], 60_000, 8_000_000).collect()
    assert sorted((r.ref_id, r.est_id) for r in got) == sorted(walk(ref, est, 60_000))
    assert time.time() - t0 < 120


def test_one_long_stretch_of_onsets(spark):
    rnd = random.Random(3)
    at, onsets = 0, []
    for _ in range(12_000):
        at += rnd.randrange(1, 60_000)
        onsets.append(at)
    df = spark.createDataFrame([(1, t) for t in onsets], "performance_id bigint, onset_us bigint")
    got = {r.onset_us: r.chord_us for r in S.chord_clusters(df, ["performance_id"], 70_000, 8_000_000).collect()}
    chord, want = None, {}
    for t in onsets:
        chord = chord if chord is not None and t - chord <= 70_000 else t
        want[t] = chord
    assert got == want


def test_no_window_over_the_rows_of_a_block(spark, monkeypatch):
    plans, cut = [], folds.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(folds, "cut_lineage", seen)
    df = spark.range(5000).selectExpr("1L as performance_id", "id * 25000 as onset_us")
    got = S.chord_clusters(df, ["performance_id"], 30_000, 8_000_000)
    assert got.select("chord_us").distinct().count() == 2500
    rounds = [p for p in plans if "Window" in p and "__acc" in p]
    assert rounds
    for p in rounds:
        below = p[p.index("Window"):].splitlines()[1]
        assert below.strip().startswith("+- Project") and "items" not in below


def test_null_keys_keep_their_chain(spark):
    rows = [(None, i * 25_000) for i in range(3000)] + [(1, i * 25_000) for i in range(3000)]
    df = spark.createDataFrame(rows, "performance_id bigint, onset_us bigint")
    got = S.chord_clusters(df, ["performance_id"], 30_000, 8_000_000).collect()
    assert len(got) in (3000, 6000)
    assert len({(r.performance_id, r.chord_us) for r in got}) == len(got) // 2
