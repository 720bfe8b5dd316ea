import random
from collections import Counter

import numpy as np
import pytest

from ritardo.operators import offsets as O

SCHEMA = "piece string, pos long, pitch long"


def brute_path(src, ref, most=8, penalty=3 * O.UNIT):
    votes = Counter(r - s for s, p in src for r, q in ref if p == q)
    cands = [o for o, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0]))[:most]]
    there = set(ref)
    at = sorted({p for p, _ in src})
    rew = []
    for p in at:
        own = [q for x, q in src if x == p]
        rew.append([O.UNIT * sum((p + c, q) in there for q in own) // len(own) - O.UNIT // 2
                    for c in cands] + [0])
    score, back = list(rew[0]), []
    for r in rew[1:]:
        best = max(score)
        back.append([score.index(best) if best - penalty > s else i for i, s in enumerate(score)])
        score = [max(s, best - penalty) + x for s, x in zip(score, r, strict=True)]
    state = score.index(max(score))
    out = [state]
    for b in reversed(back):
        state = b[state]
        out.append(state)
    return {p: cands[s] if s < len(cands) else None for p, s in zip(at, reversed(out), strict=True)}


def reading(rnd, n):
    """A score and one that repeats its first third, then goes on; bars of it are foreign."""
    src = [(i * 500, 40 + rnd.randrange(30)) for i in range(n) for _ in range(2)]
    cut = n // 3 * 500
    ref = [(p, q) for p, q in src if p < cut]
    ref += [(p + cut + 250, q) for p, q in src if not n // 2 * 500 <= p < n // 2 * 500 + 15_000]
    return src, ref


@pytest.mark.parametrize("chunk,block", [(4096, 4096), (7, 5)])
def test_planted_readings(spark, chunk, block, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", chunk)
    monkeypatch.setattr(O, "BLOCK", block)
    rnd = random.Random(8)
    sizes = {"a": 150, "b": 40, "c": 90}
    read = {k: reading(rnd, n) for k, n in sizes.items()}
    read["alien"] = ([(i * 10, 5) for i in range(20)], [(3, 6)])
    read["silent"] = ([(0, 60), (10, 61)], [])
    frames = [spark.createDataFrame([(k, p, q) for k, v in read.items() for p, q in v[i]], SCHEMA)
              for i in (0, 1)]
    got = {}
    for r in O.map_positions(*frames, ["piece"], 4000).collect():
        got.setdefault(r.piece, {})[r.pos] = r.offset
    for k, (src, ref) in read.items():
        assert got[k] == brute_path(src, ref), k
    a, n = got["a"], sizes["a"]
    foreign = [p for p in a if n // 2 * 500 <= p < n // 2 * 500 + 15_000]
    assert foreign and all(a[p] is None for p in foreign)
    assert all(a[p] == n // 3 * 500 + 250 for p in a if p > n // 2 * 500 + 15_000)
    assert set(got["alien"].values()) == set(got["silent"].values()) == {None}


@pytest.mark.parametrize("step,span", [(1, 3000), (1000, 3000), (1, 10**9), (7, 40)])
def test_correlation_is_the_count_of_pairs(step, span):
    rnd = np.random.default_rng(span)
    ps, pr = (np.unique(rnd.integers(0, span, 300)) * step + o for o in (5, 11 * step + 5))
    ns, nr = rnd.integers(1, 4, len(ps)), rnd.integers(1, 4, len(pr))
    want = Counter()
    for p, a in zip(ps, ns, strict=True):
        for r, b in zip(pr, nr, strict=True):
            want[int(r - p)] += int(a * b)
    at, votes = O.correlate(ps, ns, pr, nr)
    assert dict(zip(at.tolist(), votes.tolist(), strict=True)) == want


def test_blocks_shuffle_notes_once(spark):
    df = spark.createDataFrame([(1, p * 7 % 50, 60 + p % 2) for p in range(90)], "k int, pos bigint, pitch int")
    b = O._blocks(df, ["k"], "s", 8)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = Counter((r.pitch, p, n) for r in b.collect() for p, n in zip(r.p_s, r.n_s, strict=True))
    want = Counter((60 + p % 2, p * 7 % 50) for p in range(90))
    assert got == Counter((*k, n) for k, n in want.items())


@pytest.mark.parametrize("small,pairs", [(0, 99), (150, 99), (5000, 1 << 20)])
def test_scores_of_any_size_are_mapped_alike(spark, monkeypatch, small, pairs):
    monkeypatch.setattr(O, "SMALL", small)
    monkeypatch.setattr(O, "PAIRS", pairs)
    rnd = random.Random(3)
    read = {str(n): reading(rnd, n) for n in (3, 30, 60, 90)}
    read["odd"] = ([(-5, 60), (-5, 60), (7, None)], [(2, 60), (9, 60), (9, 60)])
    frames = [spark.createDataFrame([(k, p, q) for k, v in read.items() for p, q in v[i]], SCHEMA)
              for i in (0, 1)]
    got = {}
    for r in O.map_positions(*frames, ["piece"], 4000).collect():
        got.setdefault(r.piece, {})[r.pos] = r.offset
    assert got.keys() == read.keys()
    for k, (src, ref) in read.items():
        assert got[k] == brute_path(src, ref), k


def test_small_scores_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, p * 7 % 50, 60 + p % 2) for p in range(90)], "k int, pos bigint, pitch int")
    m = O.map_positions(df, df, ["k"], 8)
    assert m._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert all(r.offset == 0 for r in m.collect())
