import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ritardo.llm import top_k as tk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()),
                       T.StructField("embedding", T.ArrayType(T.FloatType()))])


def brute(rows, every, k):
    ok = {(i, tuple(float(math.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows
          if i is not None and v is not None
          and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in ok:
        if i % every == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in ok
                       if j != i and len(v) == len(q))
            out += [(i, r + 1, j, int(-x)) for r, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("part", [tk.PART, 40])
def test_against_brute_force(spark, part):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 8) for i in range(200)]  # one common vector
    rows += [(i, [x + rnd.gauss(0, 0.001) for x in rows[i][1]]) for i in range(2000, 2000)]
    rows += [(5000, None), (5050, [None] * 8), (5100, [float("nan")] + [0.0] * 7),
             (5150, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (5200, [0.1, 0.2]),
             (5201, [0.3, -0.2]), (5250, []), (5251, []), (0, rows[0][1]), (7, rows[7][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({
        "cell": F.lit("x"), "v": F.lit(1), "rank": F.lit(2), "label": F.lit(3)})
    got = tk.top_k(df, 50, 5, part=part, sample=64).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 50, 5)


def test_empty(spark):
    assert tk.top_k(spark.createDataFrame([], SCHEMA), 50, 5).count() == 0


def test_pruning_leaves_nodes_out():
    rnd = np.random.default_rng(1)
    x = np.floor(np.vstack([c + rnd.normal(0, 2, (500, 6)) for c in rnd.normal(0, 90, (8, 6))]))
    q, ids = x[::40].copy(), np.arange(len(x))
    got, score = tk.dual_tree(q, ids[::40], np.full(len(q), -np.inf), x, ids, 5)
    s = q @ x.T
    s[ids[::40, None] == ids[None, :]] = -np.inf
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
    assert (got == want).all() and (score == np.take_along_axis(s, want, 1)).all()
