"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.llm.common import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """Each neighbour ``v`` of ``u`` with the least of u's closed neighbourhood, ``m``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each linked node's component.

    Every round links nodes to the least neighbour (larger neighbours first, then smaller ones),
    so that each component ends as one star; edges never outnumber those of the input, minima are
    combined before they are shuffled, and a hub is split by the adaptive join. Null ends and
    self-links give nothing.
    """
    e = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u > v")
    e = stored(e.distinct(), "edges")
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large")
        s = _stars(large)
        small = s.select(F.inline(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u > v")
        e = stored(small.distinct(), "small")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", "v").distinct())
