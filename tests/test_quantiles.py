import numpy as np
import pytest

from ritardo.operators.agreement import pair_counts, spearman
from ritardo.operators.quantiles import average_rank, exact_quantiles, loo_quantiles, robust_sd


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(0)
    g = {
        "hot": np.r_[rng.normal(0, 1, 400), np.full(200, 0.25)],
        "neg": -np.exp(rng.normal(0, 3, 31)), "zero": np.zeros(5), "one": np.array([2.5]),
        "two": np.array([1.0, 4.0]),
    }
    rows = [(k, i, float(x)) for k, v in g.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows + [("hot", -1, None)], "k string, i int, x double"), g


def test_exact_quantiles(groups):
    df, g = groups
    out = exact_quantiles(df, ["k"], "x", {"a": 0.1, "m": 0.5, "z": 0.99}, count="n").collect()
    assert {r["k"] for r in out} == set(g)
    for r in out:
        v = g[r["k"]]
        assert r["n"] == len(v)
        np.testing.assert_allclose([r["a"], r["m"], r["z"]], np.quantile(v, [0.1, 0.5, 0.99]))


def test_global_quantile(groups):
    df, g = groups
    r = exact_quantiles(df, [], "x", {"m": 0.37}).first()
    assert r["m"] == pytest.approx(np.quantile(np.concatenate(list(g.values())), 0.37))


def test_robust_sd(groups):
    df, g = groups
    for r in robust_sd(df, ["k"], "x").collect():
        v = g[r["k"]]
        assert r["robust_sd"] == pytest.approx(1.4826 * np.median(np.abs(v - np.median(v))))


def test_loo_quantiles(groups):
    df, g = groups
    for r in loo_quantiles(df, ["k"], "x", {"m": 0.5, "q": 0.8}).collect():
        v = g[r["k"]]
        rest = v if r["i"] < 0 else np.delete(v, r["i"])
        assert r["n_others"] == len(rest)
        if len(rest) == 0:
            assert r["m"] is None
        else:
            np.testing.assert_allclose([r["m"], r["q"]], np.quantile(rest, [0.5, 0.8]))


def test_average_rank(groups):
    df, g = groups
    got = {(r["k"], r["i"]): r["rank"] for r in average_rank(df, ["k"], "x").collect()}
    for k, v in g.items():
        want = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
        assert [got[(k, i)] for i in range(len(v))] == want


def test_pair_counts_and_spearman(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(rng.integers(0, 6)), float(rng.integers(0, 7))) for _ in range(60)]
    rows += [("b", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, t double, p double")
    got = {r["g"]: r for r in pair_counts(df, ["g"], "t", "p").collect()}
    x = np.array([r[1:] for r in rows[:60]])
    i, j = np.triu_indices(60, 1)
    st, sp = np.sign(x[i, 0] - x[j, 0]), np.sign(x[i, 1] - x[j, 1])
    assert got["a"]["concordant"] == (st * sp > 0).sum()
    assert got["a"]["discordant"] == (st * sp < 0).sum()
    assert got["a"]["tied_both"] == ((st == 0) & (sp == 0)).sum()
    assert got["b"]["concordant"] == 0
    s = {r["g"]: r["spearman"] for r in spearman(df, ["g"], "t", "p").collect()}
    rk = [np.array([(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c]) for c in x.T]
    assert s["a"] == pytest.approx(np.corrcoef(*rk)[0, 1])
    assert s["b"] is None
