"""Listening schedules: every pair inside a passage about equally often."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.operators.ordered import asof, chunk_of, scan
from ritardo.operators.sequences import running_index


def spread_step(n: int, seed: int) -> int:
    """A step without a common divisor with ``n``, near the golden section of it: its multiples
    visit all of 0 .. n - 1 and lie far apart."""
    step = max(1, round(n * 0.6180339887498949) + seed % 7)
    while gcd(step, n) != 1:
        step += 1
    return step


def pair_schedule(items: DataFrame, passage: str, item: str, listeners: int, trials: int, *,
                  seed: int = 0, width: int = 65536) -> DataFrame:
    """listener, trial, passage, ``first``, ``second``: what each listener compares, in order.

    The pairs of a passage stand in the rounds of a tournament (one item stays, the others turn
    about it), so the pair of a place follows from its number and no pairs are built. The schedule
    runs through all places of all passages with a step that visits each once, as often as it
    takes; so two pairs never differ by more than one in how often they are judged. Which of a
    pair comes first alternates from one time to the next. Passages of one item take no part.
    """
    x = items.select(passage, item).where(F.col(item).isNotNull()).distinct()
    x = running_index(x, [passage], [item], chunk_of(item, width))
    n = x.groupBy(passage).agg(F.count("*").alias("n")).where("n > 1")
    # rounds of an odd number of items have one more, who sits out: its places are left out
    n = n.withColumn("pairs", F.expr("n * (n - 1) div 2")).withColumn("__one", F.lit(0))
    n = scan(n, ["__one"], [passage], chunk_of(passage, width), __upto=("sum", "pairs"))
    n = n.withColumn("base", F.col("__upto") - F.col("pairs"))
    total = n.agg(F.sum("pairs")).first()[0] or 0
    spark = items.sparkSession
    need = listeners * trials if total else 0
    step, t = (spread_step(total, seed), total) if total else (1, 1)
    seq = spark.range(need).select(
        F.col("id").alias("slot"), F.expr(f"id div {t}").alias("time"),
        F.expr(f"((id % {t}) * {step}L + {seed}L) % {t}").alias("at"), F.lit(0).alias("__one"))
    p = asof(seq, n.select("__one", "base", F.col(passage).alias("__p"), "n"), ["__one"], "at",
             "base", ["__p", "n"], width)
    # place k of a passage of n items: m players, of whom the last stays and the others turn
    k = "(at - hit_base)"
    p = p.withColumn("m", F.expr("n - 1 + n % 2")).withColumn("half", F.expr("n div 2"))
    p = p.withColumn("r", F.expr(f"{k} div half")).withColumn("b", F.expr(f"{k} % half"))
    odd = F.col("n") % 2 == 1
    i = F.when(odd, F.expr("(r + b + 1) % m")).when(F.col("b") == 0, F.col("n") - 1).otherwise(
        F.expr("(r + b) % m"))
    j = F.when(odd, F.expr("(r + m - b - 1) % m")).when(F.col("b") == 0, F.col("r")).otherwise(
        F.expr("(r + m - b) % m"))
    p = p.withColumn("i", F.least(i, j)).withColumn("j", F.greatest(i, j))
    turn = F.col("time") % 2 == 1
    p = p.select("slot", "__p", F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"),
                 F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"))
    for end, name in (("i", "first"), ("j", "second")):
        own = x.select(F.col(passage).alias("__p"), F.col("idx").alias(end), F.col(item).alias(name))
        p = p.join(own, ["__p", end])
    return p.select(F.expr(f"slot div {trials}").alias("listener"), F.expr(
        f"slot % {trials}").alias("trial"), F.col("__p").alias(passage), "first", "second")
