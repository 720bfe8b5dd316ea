"""Small tables that reports and checks start from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.functions.keys import base_note_id
from ritardo.operators.quantiles import exact_quantiles
from ritardo.operators.sequences import local_ioi


def ratings_matrix(
    ratings: DataFrame, ids: Sequence[str], dimension: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Mean rating of every item in one column per dimension; dimensions are given, not searched."""
    return ratings.groupBy(*ids).pivot(dimension, list(names)).agg(F.avg(value))


def crosswalk(sources: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows per piece of several data sets in one table: data set, ``piece_id``, ``n_performances``.

    Each source is a table and the column that names its pieces.
    """
    out = None
    for name, (df, key) in sources.items():
        one = df.groupBy(key.alias("piece_id")).agg(F.count("*").alias("n_performances")).select(
            F.lit(name).alias("dataset"), "piece_id", "n_performances")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no source given")
    return out


def curve_completeness(beats: DataFrame, keys: Sequence[str], beat: str) -> DataFrame:
    """Rows of each curve, and whether every beat occurs once."""
    return beats.groupBy(*keys).agg(
        F.count("*").alias("n_beats"), (F.count("*") == F.countDistinct(beat)).alias("complete"))


def hand_label_summary(
    notes: DataFrame, keys: Sequence[str], hand: Column, known: Column, candidate: str
) -> DataFrame:
    """Notes of the right (1) and left (2) hand and without a hand, and how many candidates."""
    return notes.groupBy(*keys).agg(
        F.count(F.when(known & (hand == 1), 1)).alias("n_right"),
        F.count(F.when(known & (hand == 2), 1)).alias("n_left"),
        F.count(F.when(~known, 1)).alias("n_none"), F.countDistinct(candidate).alias("n_candidates"))


def outcomes_by_density(
    notes: DataFrame, keys: Sequence[str], width: int, limits: Sequence[tuple[str, int]],
    beyond: str, outcome: str = "label",
) -> DataFrame:
    """Outcomes by the local time between onsets: the first class whose limit it stays below."""
    keys = list(keys)
    chords = notes.select(*keys, F.col("onset_us").alias("chord_us")).distinct()
    ioi = local_ioi(chords, keys, width).select(
        *keys, F.col("chord_us").alias("onset_us"), "local_ioi_us")
    i = F.col("local_ioi_us")
    name = F.when(i.isNull(), "none")
    for label, limit in limits:
        name = name.when(i < limit, label)
    return notes.join(ioi, [*keys, "onset_us"]).groupBy(
        name.otherwise(beyond).alias("density"), outcome).agg(F.count("*").alias("n"))


def expert_band(
    curves: DataFrame, keys: Sequence[str], value: str, probs: tuple[float, float, float],
    min_refs: int,
) -> DataFrame:
    """Low, middle and high quantile of the references at every place with enough of them."""
    q = exact_quantiles(curves, keys, value, dict(zip(
        ("band_lo", "band_mid", "band_hi"), probs, strict=True)), count="n_refs")
    return q.where(F.col("n_refs") >= min_refs)


def anchored_onsets(notes: DataFrame, keys: Sequence[str], anchor_ids: DataFrame) -> DataFrame:
    """Score onsets of the anchor notes, whatever repeat the anchor's id names.

    ``notes``: keys, ``note_id``, ``onset_uq``; ``anchor_ids``: keys, ``note_id``.
    """
    keys = list(keys)
    base = base_note_id(F.col("note_id"))[0]
    a = anchor_ids.select(*keys, base.alias("__base"))
    return notes.withColumn("__base", base).join(a, [*keys, "__base"], "left_semi").select(
        *keys, "onset_uq").distinct()


def log_articulation(
    notes: DataFrame, keys: Sequence[str], held: str, position: Column, time: str, written: Column,
    limit: float = 3.0,
) -> DataFrame:
    """Adds ``articulation``: log of the held time over the written one at the key's mean tempo,
    within ``limit`` either way."""
    keys = list(keys)
    tempo = notes.groupBy(*keys).agg(F.regr_slope(time, position).alias("__period"))
    art = F.ln(F.col(held) / (written * F.abs("__period")))
    return notes.join(tempo, keys).withColumn("articulation", F.least(F.greatest(
        art, F.lit(-limit)), F.lit(limit))).drop("__period")
