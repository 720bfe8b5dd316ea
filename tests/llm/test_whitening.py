import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ritardo.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType()))])


def ints(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)


def check(rows, got, most):
    """Every contract of the result against exact integers and a dense eigenproblem."""
    ok = [(i, ints(v)) for i, v in rows if v is not None
          and all(c is not None and math.isfinite(c) for c in v)]
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, r.deviation, r.n), []).append(r)
    seen = 0
    for d in {len(x) for _, x in ok}:
        fit = sorted({x for _, x in ok if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        m = (np.array(fit, dtype=float) * n - np.array(s)) / n if d else np.zeros((n, 0))
        v = m.T @ m / n
        e, u = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
        order = np.argsort(-e)[:most]
        order = [k for k in order if e[k] > 1e-9 * e.max()]
        for i, x in (r for r in ok if len(r[1]) == d and r[0] != 7):
            far = [n * a - b for a, b in zip(x, s, strict=True)]
            own = sorted(by_row.get((i, sum(f * f for f in far), n), []), key=lambda r: r.component)
            own = own[:len(order)]
            assert [r.component for r in own] == list(range(1, len(order) + 1))
            seen += len(order)
            for r, k in zip(own, order, strict=True):
                want = np.dot(np.array(far, dtype=float) / n, u[:, k]) / math.sqrt(e[k])
                assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-7)
                assert r.explained == pytest.approx(e[k] / e.sum(), rel=1e-8)
                assert r.identity_error < 1e-9
    assert seen == len(got)


@pytest.mark.parametrize("block", [W.BLOCK, 16])
def test_against_dense_eigenvectors(spark, block, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", block)
    rnd = random.Random(6)
    rows = [(i, [rnd.gauss(0, 2.0 / (1 + j)) for j in range(12)]) for i in range(200)]
    rows += [(300 + i, [0.5] * 12) for i in range(150)]  # one vector many times, fitted once
    rows += [(600, None), (601, [None] * 12), (602, [float("nan")] + [0.0] * 11),
             (603, [float("inf")] * 12), (None, [0.1] * 12), (7, rows[7][1]), (604, []),
             (605, [1.0, 2.0]), (606, [2.0, 1.0]), (607, [4.0, 3.5]), (608, [1.5, 0.0, 2.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({
        "x": F.lit("x"), "n": F.lit(1), "component": F.lit(2), "d": F.lit(3)})
    got = [r for r in W.whiten(df, 5).collect()]
    ids = {r.vec_id for r in got}
    assert not ids & {600, 601, 602, 603, 604, 608} and {605, 606, 607, None, 7} <= ids
    check(rows, [r for r in got if r.vec_id != 7], 5)
    assert len([r for r in got if r.vec_id == 7]) == 10  # a row that is there twice


def test_no_spread_and_empty(spark):
    same = [(i, [0.25, 0.5]) for i in range(9)]
    assert W.whiten(spark.createDataFrame(same, SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def matrices():
    rnd = np.random.default_rng(3)
    q = np.linalg.qr(rnd.normal(size=(24, 24)))[0]
    yield "plain", rnd.normal(size=(300, 24))
    yield "few rows", rnd.normal(size=(9, 24))
    yield "low rank", rnd.normal(size=(300, 4)) @ rnd.normal(size=(4, 24))
    yield "equal values", np.eye(24) @ q
    yield "close values", np.diag(1 + 1e-9 * np.arange(24)) @ q
    yield "graded", np.diag(np.logspace(0, -5, 24)) @ q
    yield "one column", np.array([[3.0], [4.0]])
    yield "zero columns", np.hstack([rnd.normal(size=(50, 5)), np.zeros((50, 3))])


@pytest.mark.parametrize("name,x", list(matrices()), ids=lambda v: v if isinstance(v, str) else "")
def test_directions_are_eigenvectors(name, x):
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((d - len(r), d))])
    a, b, w = W.bidiagonal(r)
    m = np.diag(a) + np.diag(b, 1)
    assert (a >= 0).all() and (b >= 0).all() and np.allclose(w.T @ w, np.eye(d), atol=1e-13)
    assert np.allclose(w @ m.T @ m @ w.T, x.T @ x, atol=1e-12 * np.abs(x.T @ x).max())
    e, v = W.directions(r, len(x), d)
    want = (np.linalg.svd(x, compute_uv=False) ** 2 / len(x))[:len(e)]
    assert len(e) == np.linalg.matrix_rank(x)
    assert np.allclose(np.sqrt(e), np.sqrt(want), rtol=1e-9, atol=1e-14 * math.sqrt(want[0]))
    assert np.allclose(v @ v.T, np.eye(len(e)), atol=1e-11)
    c = x.T @ x / len(x)
    assert np.abs(c @ v.T - v.T * e).max() < 1e-13 * e[0]


def test_values_of_a_graded_bidiagonal_keep_relative_accuracy():
    a = np.logspace(0, -12, 13)
    b = np.full(12, 1e-30)
    assert np.allclose(W.squared_values(a, b), a**2, rtol=1e-13, atol=0)


def test_whole_numbers_past_64_bits():
    m = W.Model(1 << 50, np.array([1 << 60, 5], dtype=object), np.zeros(0), np.zeros((0, 2)), 0.0)
    x = np.array([[1 << 20, 7]])
    assert m.times_n(x).tolist() == [[(1 << 70) - (1 << 60), 7 * (1 << 50) - 5]]
