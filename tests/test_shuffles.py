"""What is shuffled, by the plan."""

import re

from pyspark.sql import functions as F

from ritardo.operators import music as M
from ritardo.operators import phrases as H
from ritardo.operators import repeats as P
from ritardo.operators import resampling as R
from ritardo.operators.ordered import asof


def steps(df):
    """Names of the plan's operators, the last first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?:^|[-:] |\n)[ :+\-]*(?:\*\(\d+\) )?(\w+)", plan)


def notes(spark, n=300):
    return spark.range(n).select(
        (F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 40 * 1_000_000 - 9_000_000).alias("onset_uq"),
        ((F.col("id") % 11) * 900_000).alias("duration_uq"), (F.col("id") % 50 + 21).alias("pitch"),
        F.concat(F.lit("n"), "id").alias("note_id"))


def test_harmony_windows_shuffle_notes_not_sums(spark):
    n = notes(spark)
    kept, M.WINDOWS = M.WINDOWS, 4
    try:
        w = M.harmony_windows(n, ["s"], 4_000_000)
        names = steps(w)
        got = {(r.s, r.w): (r.bass, r.first_onset) for r in w.collect()}
    finally:
        M.WINDOWS = kept
    assert names.count("Exchange") == 1
    below = names[names.index("Exchange"):]
    assert "HashAggregate" not in below and "ObjectHashAggregate" not in below
    want = {}
    for r in n.where("duration_uq > 0").collect():
        for i in range(r.onset_uq // 4_000_000, (r.onset_uq + r.duration_uq - 1) // 4_000_000 + 1):
            low, first = want.get((r.s, i), (999, None))
            if r.onset_uq >= i * 4_000_000:
                first = r.onset_uq if first is None else min(first, r.onset_uq)
            want[r.s, i] = min(low, r.pitch), first
    assert got == {k: (low % 12, first) for k, (low, first) in want.items()}


def test_beat_map_shuffles_points_once(spark, monkeypatch):
    pt = notes(spark).select("s", "note_id", F.col("onset_uq").alias("q"))
    seg = spark.createDataFrame([(s, p * 10_000_000, p // 2) for s in range(2) for p in range(4)],
                                "s long, pos long, offset long")
    sought = []
    monkeypatch.setattr(H, "asof", lambda *a, **k: sought.append(a) or asof(*a, **k))
    out = H.beat_map(pt, seg, ["s"], "q", 8_000_000)
    assert len(sought) == 1
    for r in out.collect():
        i = r.q // 10_000_000
        same = 0 <= i < 3 and i // 2 == (i + 1) // 2
        known = r.s < 2 and r.q >= 0 and (r.q == i * 10_000_000 or same) and i <= 3
        assert r.ref_pos == (r.q + i // 2 if known else None)


def test_draws_are_counted_after_their_shuffle(spark):
    ix = spark.range(500).select(F.col("id").alias("idx"), F.lit(500).cast("long").alias("k"))
    w = R.bootstrap_weights(ix, 20, 3)
    names = steps(w)
    below = names[names.index("Exchange"):]
    assert "HashAggregate" not in below
    per = w.groupBy("b").agg(F.sum("w").alias("n")).collect()
    assert sorted((r.b, r.n) for r in per) == [(b, 500) for b in range(20)]


def test_runs_and_their_notes_are_shuffled_once(spark):
    fp = spark.range(400).select((F.col("id") % 4).alias("s"), (F.col("id") / 4).cast("long").alias("bar"),
                                 (F.col("id") * 7919 % 3).alias("fp"))
    runs = P.repeat_runs(fp, ["s"], 2)
    assert steps(runs).count("Exchange") == 1
    a = P.repeat_agreement(runs, fp.withColumn("v", F.col("bar") * 1.0), ["s"], "bar", ["fp"], "v")
    names = steps(a)
    assert names.count("Exchange") <= 3 and "Generate" not in names
