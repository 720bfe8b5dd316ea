"""Matched notes and their expression, alignment scores, bar error tables, pedal depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.operators.matching import set_prf
from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.sequences import interpolate


def matched_pairs(
    score: DataFrame, played: DataFrame, pairs: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Matched notes: one per score onset and pitch, and one per played note.

    ``score``: keys, ``s_id``, ``onset_uq``, ``duration_uq``, ``pitch``; ``played``: keys,
    ``p_id``, ``onset_us``, ``played_us``, ``velocity``; ``pairs``: keys, ``s_id``, ``p_id``.
    Both tests look at the same joined rows, in the order of onset, pitch and ids.
    """
    keys = list(keys)
    j = pairs.select(*keys, "s_id", "p_id").join(score.select(
        *keys, "s_id", "onset_uq", "duration_uq", "pitch"), [*keys, "s_id"]).join(played.select(
            *keys, "p_id", "onset_us", "played_us", "velocity"), [*keys, "p_id"])
    slot = W.partitionBy(*keys, "onset_uq", "pitch").orderBy("s_id", "p_id")
    note = W.partitionBy(*keys, "p_id").orderBy("onset_uq", "pitch", "s_id")
    j = j.withColumns({"__a": F.row_number().over(slot), "__b": F.row_number().over(note)})
    return j.where("__a = 1 and __b = 1").drop("__a", "__b")


def note_expression(
    matched: DataFrame, keys: Sequence[str], width: int, min_duration_uq: int = 62_500
) -> DataFrame:
    """``log_ioi`` and ``log_art`` of matched notes, free of the rendition's overall tempo.

    Chord onsets are means over the chord; the tempo is the least-squares slope of chord onset on
    score onset. ``log_ioi`` belongs to the chord and is null for the last; ``log_art`` compares
    key-down time with the written duration and is null for grace and very short notes.
    """
    keys = list(keys)
    chord = matched.groupBy(*keys, "onset_uq").agg(F.avg("onset_us").alias("__t"))
    slope = chord.groupBy(*keys).agg(F.regr_slope("__t", F.col("onset_uq").cast("double")).alias(
        "us_per_uq"))
    step = scan(chord, keys, ["onset_uq"], chunk_of("onset_uq", width), __nq=("lead", "onset_uq"),
                __nt=("lead", "__t"))
    step = step.join(slope, keys)
    ratio = (F.col("__nt") - F.col("__t")) / ((F.col("__nq") - F.col("onset_uq")) * F.col(
        "us_per_uq"))
    step = step.select(*keys, "onset_uq", "us_per_uq", F.when(ratio > 0, F.ln(ratio)).alias("log_ioi"))
    art = F.col("played_us") / (F.col("duration_uq") * F.col("us_per_uq"))
    ok = (F.col("duration_uq") >= min_duration_uq) & (F.col("played_us") > 0) & (art > 0)
    return matched.join(step, [*keys, "onset_uq"]).withColumn("log_art", F.when(ok, F.ln(art)))


def onset_curves(expression: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean velocity and log IOI of every chord."""
    return expression.groupBy(*keys, "onset_uq").agg(
        F.avg("velocity").alias("velocity"), F.avg("log_ioi").alias("log_ioi"))


def alignment_scores(pred: DataFrame, true: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of an alignment: keys, ``label``, ``s_id``, ``p_id`` on both sides.

    Set-wise precision, recall and F1 of matches, insertions and deletions, and the share of true
    notes, played and written, whose partner (or lack of one) is the same. Other labels are not
    looked at. Nothing to find counts as 1.
    """
    keys = list(keys)
    every = pred.select(*keys).unionByName(true.select(*keys)).distinct()
    out = every
    for label, on in (("match", ["s_id", "p_id"]), ("insertion", ["p_id"]), ("deletion", ["s_id"])):
        s = set_prf(pred.where(F.col("label") == label), true.where(F.col("label") == label), keys,
                    on, every)
        out = out.join(s.select(*keys, *[F.col(c).alias(f"{label}_{c}") for c in (
            "precision", "recall", "f1")]), keys)
    for name, note, other, lone in (("played", "p_id", "s_id", "insertion"),
                                    ("written", "s_id", "p_id", "deletion")):
        def partner(d: DataFrame, to: str, note=note, other=other, lone=lone) -> DataFrame:
            d = d.where(F.col("label").isin("match", lone)).select(*keys, note, F.when(
                F.col("label") == "match", F.col(other)).alias("__x"))
            # a note named twice keeps the entry without partner, else the largest
            return d.groupBy(*keys, note).agg(
                F.when(F.count("*") == F.count("__x"), F.max("__x")).alias(to))

        j = partner(true, "__t").join(partner(pred, "__p").withColumn("__in", F.lit(True)),
                                      [*keys, note], "left")
        same = F.col("__in").isNotNull() & F.col("__t").eqNullSafe(F.col("__p"))
        acc = j.groupBy(*keys).agg(F.avg(same.cast("double")).alias(f"{name}_accuracy"))
        out = out.join(acc, keys, "left").withColumn(f"{name}_accuracy", F.coalesce(
            f"{name}_accuracy", F.lit(1.0)))
    return out


def bar_error_table(
    bars: DataFrame, notes: DataFrame, keys: Sequence[str], label: str = "printed"
) -> DataFrame:
    """Error counts of bars by printed label, so that renditions that repeat differently meet.

    ``bars``: keys, ``measure_idx``, the label; ``notes``: keys, ``measure_idx``, ``label`` and
    ``fast_repeat``. Missed notes on fast repeats are counted apart as well. Bars without notes
    have zeros.
    """
    keys = list(keys)

    def n(cond: str, name: str):
        return F.count(F.when(F.expr(cond), 1)).alias(name)

    c = notes.groupBy(*keys, "measure_idx").agg(
        n("label in ('correct', 'wrong_pitch', 'missed')", "n_score_notes"),
        n("label = 'wrong_pitch'", "n_wrong_pitch"), n("label = 'missed'", "n_missed"),
        n("label = 'extra'", "n_extra"), n("label = 'missed' and fast_repeat", "n_missed_fast_repeat"))
    names = ("n_score_notes", "n_wrong_pitch", "n_missed", "n_extra", "n_missed_fast_repeat")
    return bars.select(*keys, "measure_idx", label).join(c, [*keys, "measure_idx"], "left").fillna(
        0, list(names))


def pedal_depth(
    pedal: DataFrame, spans: DataFrame, keys: Sequence[str], width: int, full: int = 127
) -> DataFrame:
    """Mean pedal depth over time in each key's ``[start_us, end_us]``; 0 before the first event.

    ``pedal``: keys, ``time_us``, ``pedal_value``. Each value holds until the next event; the step function
    is integrated exactly. Null for an empty span.
    """
    keys = list(keys)
    held = scan(pedal, keys, ["time_us", "pedal_value"], chunk_of("time_us", width),
                __next=("lead", "time_us"))
    j = held.join(spans, keys)
    to = F.least(F.coalesce("__next", "end_us"), "end_us")
    part = F.greatest(to - F.greatest("time_us", "start_us"), F.lit(0)) * F.col("pedal_value")
    s = j.groupBy(*keys).agg(F.sum(part).alias("__a"))
    span = F.col("end_us") - F.col("start_us")
    return spans.join(s, keys, "left").withColumn("depth_mean", F.when(
        span > 0, F.coalesce("__a", F.lit(0)) / (span * full))).drop("__a")


def matched_onsets(
    score: DataFrame, played: DataFrame, pairs: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Pairs usable for timing, and what was left out, counted per key.

    Only ``match`` pairs count; the first row (smallest position) stands for an id that a side has
    twice; pairs whose ids are missing and grace notes go. ``score``: keys, ``s_id``, ``onset_uq``,
    ``is_grace``; ``played``: keys, ``p_id``, ``onset_us``, ``pitch``, ``velocity``; ``pairs``:
    keys, ``s_id``, ``p_id``, ``label``.
    """
    keys = list(keys)
    s = score.groupBy(*keys, "s_id").agg(F.min(F.struct("onset_uq", "is_grace")).alias("s"))
    p = played.groupBy(*keys, "p_id").agg(F.min(F.struct("onset_us", "pitch", "velocity")).alias("p"))
    j = pairs.where("label = 'match'").join(s, [*keys, "s_id"], "left").join(
        p, [*keys, "p_id"], "left")
    ok = F.col("s").isNotNull() & F.col("p").isNotNull()
    kept = j.where(ok & ~F.col("s.is_grace")).select(
        *keys, "s_id", "p_id", "s.onset_uq", "p.onset_us", "p.pitch", "p.velocity")
    left_out = j.groupBy(*keys).agg(
        F.count(F.when(~ok, 1)).alias("n_missing_ids_skipped"),
        F.count(F.when(ok & F.col("s.is_grace"), 1)).alias("n_grace_skipped"))
    by_label = pairs.groupBy(*keys).agg(*[
        F.count(F.when(F.col("label") == label, 1)).alias(name) for label, name in (
            ("match", "n_match"), ("interpolated", "n_interpolated_skipped"),
            ("insertion", "n_insertion"), ("deletion", "n_deletion"))])
    counts = by_label.join(left_out, keys, "left").join(score.groupBy(*keys).agg(
        F.count("*").alias("n_score_notes")), keys, "left").join(played.groupBy(*keys).agg(
            F.count("*").alias("n_perf_notes")), keys, "left").fillna(0)
    return kept, counts


def steady_edges(
    points: DataFrame, knots: DataFrame, keys: Sequence[str], pos: str, knot_pos: str,
    knot_val: str, width: int, k: int, name: str = "value",
) -> DataFrame:
    """Piecewise-linear value at ``pos``; beyond the end knots the slope is the median of the
    first (last) ``k`` segments, so one odd segment at the edge does not carry on."""
    keys = list(keys)
    inner = interpolate(points, knots, keys, pos, knot_pos, knot_val, width, name, extrapolate=False)
    seg = scan(knots.select(*keys, knot_pos, knot_val), keys, [knot_pos, knot_val], chunk_of(
        knot_pos, width), __np=("lead", knot_pos), __nv=("lead", knot_val))
    seg = seg.withColumn("__slope", (F.col("__nv") - F.col(knot_val)) / (
        F.col("__np") - F.col(knot_pos)))

    def edge(order, end: str) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(order)  # the limit is applied before the shuffle
        near = seg.where("__slope is not null").withColumn("__r", F.row_number().over(w)).where(
            F.col("__r") <= k)
        return near.groupBy(*keys).agg(F.median("__slope").alias(f"__{end}_slope"))

    ends = knots.groupBy(*keys).agg(
        F.min(F.struct(knot_pos, knot_val)).alias("__lo"), F.max(F.struct(knot_pos, knot_val)).alias("__hi"))
    ends = ends.join(edge(F.asc(knot_pos), "lo"), keys, "left").join(edge(
        F.desc(knot_pos), "hi"), keys, "left")
    j = inner.join(ends, keys, "left")

    def beyond(end: str):
        return F.col(f"__{end}.{knot_val}") + (F.col(pos) - F.col(f"__{end}.{knot_pos}")) * F.coalesce(
            f"__{end}_slope", F.lit(0.0))

    return j.withColumn(name, F.when(F.col(pos) < F.col(f"__lo.{knot_pos}"), beyond("lo")).when(
        F.col(pos) > F.col(f"__hi.{knot_pos}"), beyond("hi")).otherwise(F.col(name))).drop(
        "__lo", "__hi", "__lo_slope", "__hi_slope")
