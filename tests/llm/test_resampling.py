import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from ritardo.llm import resampling as R


def features(text, runs):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=25, min_words=20, runs=2, k=10000, seed=7):
    own = [[crc32(f.encode()) % k for f in features(t, runs)[1]] for _, t in docs]
    tgt = [crc32(f.encode()) % k for t in target for f in features(t, runs)[1]]
    s, t = [0] * k, [0] * k
    for b in (x for bs in own for x in bs):
        s[b] += 1
    for b in tgt:
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + k) / ((s[i] + 1) * (sum(t) + k))))
            for i in range(k)]
    rows = []
    for (i, x), bs in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, x, len(features(x, runs)[0]), len(bs), weight, score, None])
    able = [r for r in rows if r[2] >= min_words]
    able.sort(key=lambda r: (-r[5], r[0] is None, r[0] or 0))
    for n, r in enumerate(able[:percent * len(able) // 100]):
        r[6] = n + 1
    return sorted(((r[0], r[2], r[3], r[4], r[5], r[6]) for r in rows), key=str)


@pytest.fixture
def words():
    rnd = random.Random(4)
    vocab = ["Alpha", "beta", "gämma", "дельта", "eps7", "zeta", "eta", "theta"]
    return lambda n: rnd.choice([" ", ", ", "\n", "_"]).join(rnd.choice(vocab) for _ in range(n))


@pytest.mark.parametrize("runs,k", [(2, 10000), (3, 7)])
def test_against_brute_force(spark, docs_of, words, runs, k, monkeypatch):
    monkeypatch.setattr(R, "WORTH", 20)  # keys are written anew on the way
    docs = [(i, words(15 + i % 30)) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " ,;"), (503, "q" * 50_000 + " w" * 30_000)]
    docs += [(700, docs[30][1])] * 60  # one row many times
    docs += [(None, docs[40][1]), (None, docs[41][1])]
    target = [docs[3][1], "beta beta eps7", None, ""]
    df = docs_of(docs, k0=F.lit("x"), tie=F.lit(1), score=F.lit(2), rank=F.lit(3))
    got = R.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs,
                     buckets=k).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, target, runs=runs, k=k)


def test_bounded_blocks_of_features(monkeypatch, words):
    t = words(300)
    whole = np.concatenate(list(R.hashed(R.words_of(t), 3)))
    assert sorted(whole.tolist()) == sorted(crc32(f.encode()) for f in features(t, 3)[1])
    monkeypatch.setattr(R, "BLOCK", 16)
    parts = list(R.hashed(R.words_of(t), 3))
    assert len(parts) > 10 and np.concatenate(parts).tolist() == whole.tolist()


@pytest.mark.parametrize("k", [1, 2, 57, 399, 400])
def test_cutoff_key(spark, k):
    rnd = random.Random(k)
    rows = [(rnd.randrange(5), rnd.randrange(2), rnd.randrange(4), rnd.randrange(-3, 3), i)
            for i in range(400)]
    keys = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in R.KEYS)).repartition(7)
    assert R.cutoff_key(keys, k) == sorted(rows)[k - 1]
    assert R.cutoff_key(keys, 401) is None and R.cutoff_key(keys, 0) is None


def test_weighted_median_leaves_a_quarter_on_either_side():
    rnd = random.Random(1)
    for _ in range(50):
        parts = [sorted((rnd.randrange(50), 0, 0, 0, rnd.random()) for _ in range(rnd.randrange(1, 40)))
                 for _ in range(9)]
        pivot = R._weighted_median([(p[(len(p) - 1) // 2], len(p)) for p in parts])
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) * 4 >= len(every) - 4 * len(parts)
        assert sum(x >= pivot for x in every) * 4 >= len(every)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert R.resample(docs_of([]), none).count() == 0
    assert [r["rank"] for r in R.resample(docs_of([(1, "a b")]), none).collect()] == [None]
