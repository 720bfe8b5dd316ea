"""Chunked ordered operators equal the plain definition for any chunk width, also on a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ritardo.operators.ordered import asof, chunk_of, islands, scan
from ritardo.operators.sequences import chord_clusters, interpolate, local_ioi


@pytest.fixture(scope="module")
def stream(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("hot", 300), ("a", 20), ("b", 1), ("c", 7)):
        t = np.sort(rng.choice(2000, size=n, replace=False))
        v = rng.integers(0, 9, size=n).astype(float)
        v[rng.random(n) < 0.3] = np.nan
        rows += [(key, int(x), None if np.isnan(y) else float(y)) for x, y in zip(t, v)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    return spark.createDataFrame(rows, "k string, t bigint, v double"), pdf


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_scan(stream, width):
    df, pdf = stream
    out = scan(df, ["k"], ["t"], chunk_of("t", width), s=("sum", "v"), m=("max", "v"),
               last=("last", "v"), nxt=("next", "v"), p=("prev", "v"), le=("lead", "t")
               ).toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    by = g.groupby("k")["v"]
    np.testing.assert_allclose(out["s"], by.cumsum().groupby(g["k"]).ffill())
    np.testing.assert_allclose(out["m"], by.cummax().groupby(g["k"]).ffill())
    np.testing.assert_allclose(out["last"], by.ffill())
    np.testing.assert_allclose(out["nxt"], by.bfill())
    np.testing.assert_allclose(out["p"], by.shift(1))
    np.testing.assert_allclose(out["le"], g.groupby("k")["t"].shift(-1))


@pytest.mark.parametrize("width", [5, 400])
def test_islands(stream, width):
    df, pdf = stream
    out = islands(df, ["k"], ["t"], chunk_of("t", width), lambda p, c: c("t") - p("t") > 6, ["t"])
    out = out.toPandas().sort_values(["k", "t"])
    g = pdf.sort_values(["k", "t"])
    want = 1 + (g.groupby("k")["t"].diff() > 6).groupby(g["k"]).cumsum()
    assert out["island"].tolist() == want.tolist()


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True),
                                              ("forward", False), ("forward", True)])
def test_asof(spark, direction, strict):
    rng = np.random.default_rng(1)
    left = [("x", int(a), i) for i, a in enumerate(rng.integers(0, 60, 80))]
    right = [("x", int(a)) for a in sorted(set(rng.integers(0, 60, 12)))]
    lf = spark.createDataFrame(left, "k string, q bigint, i int")
    rf = spark.createDataFrame(right, "k string, r bigint")
    got = {r["i"]: r["hit_r"] for r in asof(lf, rf, ["k"], "q", "r", [], 7, direction=direction,
                                            strict=strict).collect()}
    rs = [r for _, r in right]
    for _, q, i in left:
        if direction == "backward":
            ok = [r for r in rs if (r < q if strict else r <= q)]
            want = max(ok) if ok else None
        else:
            ok = [r for r in rs if (r > q if strict else r >= q)]
            want = min(ok) if ok else None
        assert got[i] == want


def test_anchor_rule_is_not_chained(spark):
    df = spark.createDataFrame([("x", t) for t in (0, 20, 40, 60, 200)], "k string, onset_us bigint")
    out = {r["onset_us"]: r["chord_us"] for r in chord_clusters(df, ["k"], 30, 50).collect()}
    assert out == {0: 0, 20: 0, 40: 40, 60: 40, 200: 200}


def test_local_ioi_single_chord_is_null(spark):
    df = spark.createDataFrame([("x", 0), ("y", 0), ("y", 10), ("y", 40)],
                               "k string, chord_us bigint")
    out = {(r["k"], r["chord_us"]): r["local_ioi_us"] for r in local_ioi(df, ["k"], 100).collect()}
    assert out == {("x", 0): None, ("y", 0): 20.0, ("y", 10): 20.0, ("y", 40): 20.0}


@pytest.mark.parametrize("extrapolate", [True, False])
def test_interpolate(spark, extrapolate):
    xp, fp = [0, 10, 30, 50], [5.0, 7.0, 8.0, 20.0]
    kn = spark.createDataFrame([("a", x, f) for x, f in zip(xp, fp)] + [("one", 3, 4.0)],
                               "k string, x bigint, f double")
    qs = [-20, 0, 4, 10, 29, 50, 70]
    pts = spark.createDataFrame([(k, q) for k in ("a", "one") for q in qs], "k string, q bigint")
    out = interpolate(pts, kn, ["k"], "q", "x", "f", 8, "v", extrapolate=extrapolate)
    got = {(r["k"], r["q"]): r["v"] for r in out.collect()}
    for q in qs:
        want = np.interp(q, xp, fp)
        if extrapolate and q < 0:
            want = 5 + q * 0.2
        if extrapolate and q > 50:
            want = 20 + (q - 50) * 0.6
        assert got[("a", q)] == pytest.approx(want)
        assert got[("one", q)] == 4.0


def test_chunk_of_negative_positions(spark):
    got = spark.range(1).select(chunk_of(F.lit(-1), 10).alias("c")).first()["c"]
    assert got == -1
