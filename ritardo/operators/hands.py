"""Hand rules and their disagreement with labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.functions.keys import staff_hand


def voice_hand(notes: DataFrame, keys: Sequence[str], name: str = "hand") -> DataFrame:
    """Hand of the modal staff of a note's voice; ties keep the note's own staff."""
    k = [*keys, "voice"]
    n = notes.where("staff in (1, 2)").groupBy(*k).agg(
        F.count(F.when(F.col("staff") == 1, 1)).alias("__n1"),
        F.count(F.when(F.col("staff") == 2, 1)).alias("__n2"))
    modal = F.when(F.col("__n1") > F.col("__n2"), 1).when(F.col("__n2") > F.col("__n1"), 2)
    hand = F.when(F.col("staff").isin(1, 2), staff_hand(F.coalesce(modal, F.col("staff"))))
    return notes.join(n, k, "left").withColumn(name, F.coalesce(hand, F.lit(""))).drop(
        "__n1", "__n2")


def event_mismatch(notes: DataFrame, event: Sequence[str], rule: str, label: str) -> DataFrame:
    """Events with both staves, and whether any of their notes has rule <> label."""
    g = notes.where("staff in (1, 2)").groupBy(*event).agg(
        F.min("staff").alias("__a"), F.max("staff").alias("__b"),
        F.bool_or(F.col(rule) != F.col(label)).alias("affected"))
    return g.where("__a <> __b").drop("__a", "__b")
