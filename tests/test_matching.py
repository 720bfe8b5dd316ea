import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ritardo.operators import matching as M
from ritardo.operators.phrases import greedy_peaks


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(s), int(p), float(rng.integers(0, 5))) for g in range(6)
            for s, p in {tuple(x) for x in rng.integers(0, 9, (25, 2))}]
    df = spark.createDataFrame(rows, "g int, s bigint, p bigint, cost double")
    got = {(r["g"], r["s"], r["p"]) for r in M.greedy_one_to_one(
        df, ["g"], [("s", "s"), ("p", "p")], ["cost", "s", "p"]).collect()}
    want = set()
    for g in range(6):
        us, up = set(), set()
        for _, s, p, c in sorted((r for r in rows if r[0] == g), key=lambda r: (r[3], r[1], r[2])):
            if s not in us and p not in up:
                us.add(s)
                up.add(p)
                want.add((g, s, p))
    assert got == want


def test_match_notes_has_maximum_cardinality(spark):
    rng = np.random.default_rng(4)
    ref = [("x", i, int(t), 60) for i, t in enumerate(np.sort(rng.integers(0, 400, 18)))]
    est = [("x", i, int(t), 60) for i, t in enumerate(np.sort(rng.integers(0, 400, 18)))]
    sch = "k string, note_id bigint, onset_us bigint, pitch bigint"
    got = M.match_notes(spark.createDataFrame(ref, sch), spark.createDataFrame(est, sch), ["k"],
                        12, 50).collect()
    for r in got:
        assert abs(r["est_us"] - r["ref_us"]) <= 12
    assert len({r["ref_id"] for r in got}) == len({r["est_id"] for r in got}) == len(got)
    # augmenting-path matching as the independent answer
    adj = {i: [j for _, j, u, _ in est if abs(u - t) <= 12] for _, i, t, _ in ref}
    owner: dict[int, int] = {}

    def place(i, seen):
        for j in adj[i]:
            if j not in seen:
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    assert len(got) == sum(place(i, set()) for i in adj)


def test_note_f1_clock_offset(spark):
    sch = "k string, note_id bigint, onset_us bigint, pitch bigint"
    ref = [("x", i, i * 500_000, 60 + i % 5) for i in range(20)]
    est = [("x", i, i * 500_000 + 130_000, 60 + i % 5) for i in range(19)] + [("x", 99, 77, 90)]
    r = M.note_f1(spark.createDataFrame(ref, sch), spark.createDataFrame(est, sch), ["k"], 50_000,
                  10**6, first_tol_us=200_000).first()
    assert (r["n_match"], r["n_ref"], r["n_est"]) == (19, 20, 20)
    assert r["onset_err_mean_ms"] == 0


def test_resolve_duplicates_keeps_unique_pairs_first(spark):
    # p1 is claimed by s0 and s1; s2-p2 is alone at both ends
    rows = [("x", 0, 1, 0, 60, 100, 62), ("x", 1, 1, 10, 60, 100, 60), ("x", 2, 2, 20, 64, 200, 64)]
    df = spark.createDataFrame(
        rows, "k string, s_id bigint, p_id bigint, pos_uq bigint, s_pitch bigint, onset_us bigint,"
        " p_pitch bigint")
    got = {(r["s_id"], r["p_id"]) for r in M.resolve_duplicates(df, ["k"], 50).collect()}
    assert got == {(1, 1), (2, 2)}


def test_reassign_moves_to_the_note_where_it_was_due(spark):
    q = 1_000_000
    m = [("x", i, i, i * q, 60 + i, i * 500_000, False) for i in range(5)]
    m[2] = ("x", 2, 2, 2 * q, 62, 1_090_000, False)
    sch = "k string, s_id bigint, p_id bigint, pos_uq bigint, pitch bigint, onset_us bigint, frozen boolean"
    free = spark.createDataFrame([("x", 77, 62, 1_010_000), ("x", 78, 63, 1_500_000)],
                                 "k string, p_id bigint, pitch bigint, onset_us bigint")
    got = M.reassign_same_pitch(spark.createDataFrame(m, sch), free, ["k"], 8 * q).collect()
    assert [(r["s_id"], r["p_id"], r["new_id"]) for r in got] == [(2, 2, 77)]


@pytest.mark.parametrize("gap", [3, 10])
def test_greedy_peaks(spark, gap):
    rng = np.random.default_rng(6)
    rows = [("x", int(p), float(rng.integers(0, 20))) for p in np.sort(rng.choice(200, 60, False))]
    df = spark.createDataFrame(rows, "k string, pos bigint, s double")
    got = sorted(r["pos"] for r in greedy_peaks(df, ["k"], "pos", "s", gap).collect())
    acc: list[int] = []
    for _, p, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(abs(p - a) >= gap for a in acc):
            acc.append(p)
    assert got == sorted(acc)


def test_range_join_is_complete(spark):
    a = spark.createDataFrame([("k", i, int(t)) for i, t in enumerate((0, 5, 9, 30))],
                              "k string, i int, x bigint")
    b = spark.createDataFrame([("k", j, int(t)) for j, t in enumerate((-4, 4, 12, 33))],
                              "k string, j int, y bigint")
    got = {(r["i"], r["j"]) for r in M.range_join(a, b, ["k"], "x", "y", 4, 3).collect()}
    want = {(i, j) for (i, x), (j, y) in itertools.product(
        enumerate((0, 5, 9, 30)), enumerate((-4, 4, 12, 33))) if x - 4 <= y <= x + 3}
    assert got == want


def test_false_extras_with_clocks_apart(spark):
    rnd = random.Random(21)
    schema = "performance_id bigint, onset_us bigint, note_id bigint, pitch bigint"
    ref = [(1, i * 500_000, i, 60 + i % 5) for i in range(80)]
    est = [(p, t + 130_000 + rnd.randrange(-20_000, 20_000), 1000 + i, q) for p, t, i, q in ref]
    extra = [(1, 500_000 * i + 330_000, 2000 + i, 90) for i in range(6)]
    ref, est = (spark.createDataFrame(x, schema) for x in (ref, est + extra))
    got = {r.note_id: r.false_extra for r in M.false_extras(ref, est, ["performance_id"], 8_000_000).collect()}
    assert {i for i, x in got.items() if x} == {2000 + i for i in range(6)}


@pytest.mark.parametrize("limit", [1 << 18, 20])
def test_greedy_with_equal_candidates(spark, monkeypatch, limit):
    """Two boundaries of one time give equal candidates; the choice ends and takes one of them."""
    monkeypatch.setattr(M, "IN_ORDER", limit)
    rnd = random.Random(4)
    rows = [(k, rnd.randint(0, 9), rnd.randint(0, 9)) for k in (1, 2, None) for _ in range(60 if k == 1 else 15)]
    df = spark.createDataFrame(rows, "k int, p bigint, t bigint").withColumn("d", F.abs(F.expr("p - t")))
    want, used = set(), set()
    for k, d, p, t in sorted(((k, abs(p - t), p, t) for k, p, t in rows), key=lambda x: (str(x[0]), *x[1:])):
        if {(k, "p", p), (k, "t", t)}.isdisjoint(used):
            used |= {(k, "p", p), (k, "t", t)}
            want.add((k, p, t))
    got = [(r.k, r.p, r.t) for r in M.greedy_one_to_one(df, ["k"], [("p", "p"), ("t", "t")], ["d", "p", "t"]).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("small", [1, 4096])
def test_expected_onsets_of_small_and_large_positions(spark, monkeypatch, small):
    from ritardo.operators import quantiles as Q
    from ritardo.operators import sequences as S

    monkeypatch.setattr(Q, "SMALL", small, raising=False)
    if small > 1:  # positions of few notes take one shuffle
        for module in (M, S):
            monkeypatch.setattr(module, "exact_quantiles", None)
    notes = [(1, i, i * 7 % 5 * 10, 1000 * (i * 7 % 5) + i * 37 % 90) for i in range(14)] + [(2, 0, 5, 77)]
    df = spark.createDataFrame(notes, "k long, n long, pos_uq long, onset_us long")
    more = spark.createDataFrame([(1, 90, 15), (1, 91, 20), (1, 92, -3), (3, 9, 1)], "k long, n long, pos_uq long")
    points = df.select("k", "n", "pos_uq").unionByName(more)
    got = {(r.k, r.n): r.expected_us for r in M.loo_expected_onsets(points, df, ["k"], "n", 20).collect()}
    at = {}
    for k, n, p, t in notes:
        at.setdefault((k, p), {})[n] = t
    knots = {p: float(np.median(list(v.values()))) for (k, p), v in at.items() if k == 1}
    for k, n, p, _ in notes:
        others = [t for m, t in at[k, p].items() if m != n]
        assert got[k, n] == (float(np.median(others)) if others else None)
    assert got[1, 90] == (knots[10] + knots[20]) / 2 and got[1, 91] == knots[20]
    assert got[1, 92] == knots[0] and got[3, 9] is None and len(got) == len(notes) + 4
    kn = {(r.k, r.pos_uq): r.median_us for r in S.expected_onsets(df, ["k"], 20).collect()}
    assert {p: m for (k, p), m in kn.items() if k == 1} == knots
