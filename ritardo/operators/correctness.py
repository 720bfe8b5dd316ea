"""Note correctness: label every score note and every played note of many performances at once.

The steps follow each other as DataFrame jobs keyed by performance: initial labels, one-to-one
resolution, same-pitch reassignment, expected onsets, ornament tolerance, wrong-pitch pairing,
bars and summary. Greedy steps run in rounds (``matching.greedy_one_to_one``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.operators.matching import (
    greedy_one_to_one, loo_expected_onsets, range_join, reassign_same_pitch, resolve_duplicates,
)
from ritardo.operators.ordered import CHUNK, asof, chunk_of, with_halo
from ritardo.operators.sequences import (
    expected_onsets, frame_halo, interpolate, place_in_bars, running_index,
)
from ritardo.session import cut_lineage

# fixed values: tolerances in microseconds and semitones
BASE_WINDOW_US = 100_000
WIDE_WINDOW_US = 200_000
MAX_WINDOW_US = 300_000
ORNAMENT_LEAD_US = 250_000
GRACE_TAIL_US = 100_000
ORNAMENT_SEMITONES = 2
MAX_SEMITONES = 2
OCTAVE_COST_SEMITONES = 3
SUSPECT_MATCH_RATIO = 0.8


def tempo_windows(
    knots: DataFrame, keys: Sequence[str], width: int, *, quarters: float = 0.4, around: int = 3,
    base_us: int = BASE_WINDOW_US,
) -> DataFrame:
    """Pairing window from the local tempo: slope over +-3 knots times 0.4 quarter, clipped."""
    k = running_index(knots, keys, ["pos_uq"], chunk_of("pos_uq", width))
    halo, w = frame_halo(k, keys, "idx", around, around)
    halo = halo.withColumns({
        "__q0": F.first("pos_uq").over(w), "__q1": F.last("pos_uq").over(w),
        "__t0": F.first("knot_us").over(w), "__t1": F.last("knot_us").over(w),
    }).where("__home")
    dq = F.col("__q1") - F.col("__q0")
    win = F.when(dq > 0, quarters * (F.col("__t1") - F.col("__t0")) / dq * 1e6).otherwise(0.0)
    return halo.withColumn(
        "window_us", F.least(F.greatest(win, F.lit(float(base_us))), F.lit(float(MAX_WINDOW_US)))
    ).drop("__q0", "__q1", "__t0", "__t1", "__home", CHUNK)


def error_windows(
    score: DataFrame, matched: DataFrame, keys: Sequence[str], note: str, width: int, *,
    factor: float = 2.0, around: int = 3, base_us: int = BASE_WINDOW_US,
) -> DataFrame:
    """Pairing window from the alignment error: twice the largest leave-one-out residual within
    +-3 onset ranks, clipped. One row per score position."""
    from pyspark.sql import Window as W

    keys = list(keys)
    pos = running_index(score.select(*keys, "pos_uq").distinct(), keys, ["pos_uq"],
                        chunk_of("pos_uq", width), "rank")
    res = loo_expected_onsets(matched, matched, keys, note, width).join(
        matched.select(*keys, note, "onset_us"), [*keys, note])
    worst = res.groupBy(*keys, "pos_uq").agg(
        F.max(F.abs(F.col("onset_us") - F.col("expected_us"))).alias("__r"))
    p = pos.join(worst, [*keys, "pos_uq"], "left")
    halo = with_halo(p, "rank", 4096, around, around)
    w = W.partitionBy(*keys, CHUNK).orderBy("rank").rangeBetween(-around, around)
    win = factor * F.coalesce(F.max("__r").over(w), F.lit(0.0))
    return halo.withColumn(
        "window_us", F.least(F.greatest(win, F.lit(float(base_us))), F.lit(float(MAX_WINDOW_US)))
    ).where("__home").select(*keys, "pos_uq", "window_us")


def initial_pairs(
    score: DataFrame, played: DataFrame, pairs: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Each listed pair with its kind: candidate, dissolved, ornament, unknown or none.

    A match of another pitch holds only at a grace or ornamented note within two semitones.
    """
    s = score.select(*keys, "s_id", "pos_uq", F.col("pitch").alias("s_pitch"), "is_grace",
                     "is_orn", F.lit(True).alias("__hs"))
    p = played.select(*keys, "p_id", "onset_us", F.col("pitch").alias("p_pitch"),
                      F.lit(True).alias("__hp"))
    j = pairs.join(s, [*keys, "s_id"], "left").join(p, [*keys, "p_id"], "left")
    hs, hp = F.coalesce("__hs", F.lit(False)), F.coalesce("__hp", F.lit(False))
    both = hs & hp
    dp = F.col("p_pitch") - F.col("s_pitch")
    allowed = (F.col("is_grace") | F.col("is_orn")) & (F.abs(dp) <= ORNAMENT_SEMITONES)
    kind = (
        F.when((F.col("label") == "match") & both & (dp != 0) & ~allowed, "dissolved")
        .when((F.col("label") == "match") & both, "correct")
        .when((F.col("label") == "interpolated") & both, "interpolated")
        .when((F.col("label") == "ornament") & hp, "ornament")
    )
    unknown = (F.col("s_id").isNotNull() & ~hs) | (F.col("p_id").isNotNull() & ~hp)
    return j.withColumns({"kind": kind, "unknown": unknown}).drop("__hs", "__hp")


@dataclass
class Correctness:
    """Labelled score notes, labelled played notes, per-performance counters of the steps."""

    score: DataFrame
    played: DataFrame
    steps: DataFrame


def pair_wrong_pitches(
    missed: DataFrame, extra: DataFrame, keys: Sequence[str], max_window_us: int = MAX_WINDOW_US
) -> DataFrame:
    """Greedy wrong-pitch pairs of missed score notes and extra played notes, closest first.

    ``missed``: keys, ``s_id``, ``s_pitch``, ``expected_us``, ``window_us``; ``extra``: keys,
    ``p_id``, ``p_pitch``, ``onset_us``.
    """
    keys = list(keys)
    m = missed.where("expected_us is not null").withColumn(
        "__e", F.round("expected_us").cast("bigint"))
    c = range_join(m, extra, keys, "__e", "onset_us", max_window_us + 1, max_window_us + 1)
    dp = F.abs(F.col("p_pitch") - F.col("s_pitch"))
    dt = F.abs(F.col("onset_us") - F.col("expected_us"))
    semis = F.when(dp <= MAX_SEMITONES, dp).otherwise(OCTAVE_COST_SEMITONES)
    c = c.where((dt <= F.col("window_us")) & (((dp >= 1) & (dp <= MAX_SEMITONES)) | (dp == 12)))
    c = c.withColumn("cost", dt / float(BASE_WINDOW_US) + semis / 12.0)
    return greedy_one_to_one(c, keys, [("s", "s_id"), ("p", "p_id")], ["cost", "s_id", "p_id"]
                             ).select(*keys, "s_id", "p_id")


def correctness(
    score: DataFrame, played: DataFrame, pairs: DataFrame, keys: Sequence[str], width: int, *,
    window_rule: str = "fixed", reassign: bool = True, resolve: bool = True,
) -> Correctness:
    """Label all notes. ``score``: keys, ``s_id``, ``pos_uq``, ``dur_uq``, ``pitch``,
    ``is_grace``, ``is_orn``; ``played``: keys, ``p_id``, ``onset_us``, ``pitch``; ``pairs``:
    keys, ``seq``, ``label``, ``s_id``, ``p_id`` (null for a missing side).
    """
    keys = list(keys)
    ks, kp = [*keys, "s_id"], [*keys, "p_id"]
    listed = cut_lineage(initial_pairs(score, played, pairs, keys))
    cand = listed.where("kind in ('correct', 'interpolated')")
    cols = [*keys, "s_id", "p_id", "pos_uq", "s_pitch", "onset_us", "p_pitch"]
    kept = resolve_duplicates(cand.select(*cols), keys, width) if resolve else cand.select(*cols)
    # the tag of a pair is that of its last listing
    tag = cand.groupBy(*keys, "s_id", "p_id").agg(F.max_by("kind", "seq").alias("label"))
    kept = cut_lineage(kept.distinct().join(tag, [*keys, "s_id", "p_id"]))
    orn = listed.where("kind in ('correct', 'interpolated', 'ornament')").groupBy(*kp).agg(
        F.max_by("kind", "seq").alias("__last")).where("__last = 'ornament'").select(*kp)
    orn = orn.withColumn("__orn", F.lit(True))

    s = score.join(kept.select(*ks, F.col("p_id").alias("partner"), "label"), ks, "left")
    p = played.join(kept.select(*kp, F.col("s_id").alias("partner"), "label"), kp, "left").join(
        orn, kp, "left")
    s = s.withColumn("label", F.coalesce("label", F.lit("missed")))
    p = p.withColumn("label", F.when(F.col("__orn"), "ornament").otherwise(
        F.coalesce("label", F.lit("extra")))).drop("__orn")
    s, p = cut_lineage(s), cut_lineage(p)

    n_swaps = None
    if reassign:
        m = s.where("label = 'correct'").join(
            p.select(*keys, F.col("p_id").alias("partner"), "onset_us",
                     F.col("pitch").alias("__pp")), [*keys, "partner"])
        m = m.where("__pp = pitch").select(
            *keys, "s_id", F.col("partner").alias("p_id"), "pos_uq", "pitch", "onset_us",
            (F.col("is_grace") | F.col("is_orn")).alias("frozen"))
        free = p.where("label = 'extra'").select(*keys, "p_id", "pitch", "onset_us")
        swaps = cut_lineage(reassign_same_pitch(m, free, keys, width))
        n_swaps = swaps.groupBy(*keys).agg(F.count("*").alias("n_reassigned"))
        s = s.join(swaps.select(*ks, "new_id"), ks, "left").withColumn(
            "partner", F.coalesce("new_id", "partner")).drop("new_id")
        moved = swaps.select(*kp, F.lit(-1).alias("__to"), F.lit(None).cast(
            s.schema["s_id"].dataType).alias("__s")).unionByName(
            swaps.select(*keys, F.col("new_id").alias("p_id"), F.lit(1).alias("__to"),
                         F.col("s_id").alias("__s")))
        p = p.join(moved, kp, "left").withColumns({
            "label": F.when(F.col("__to") == -1, "extra").when(F.col("__to") == 1, "correct")
            .otherwise(F.col("label")),
            "partner": F.when(F.col("__to").isNotNull(), F.col("__s")).otherwise(
                F.col("partner"))}).drop("__to", "__s")
        s, p = cut_lineage(s), cut_lineage(p)

    on = p.select(*keys, F.col("p_id").alias("partner"), "onset_us")
    matched = s.where("label = 'correct'").join(on, [*keys, "partner"]).select(
        *ks, "pos_uq", "onset_us")
    knots = cut_lineage(expected_onsets(matched, keys, width))
    kn = knots.withColumnRenamed("pos_uq", "kpos")
    s = interpolate(s, kn, keys, "pos_uq", "kpos", "knot_us", width, "expected_us")
    s = s.withColumn("__end", F.col("pos_uq") + F.col("dur_uq"))
    s = interpolate(s, kn, keys, "__end", "kpos", "knot_us", width, "expected_end_us").drop("__end")
    if window_rule == "fixed":
        s = s.withColumn("window_us", F.lit(float(BASE_WINDOW_US)))
    elif window_rule == "wide":
        s = s.withColumn("window_us", F.lit(float(WIDE_WINDOW_US)))
    elif window_rule == "error":
        s = s.join(error_windows(s, matched, keys, "s_id", width), [*keys, "pos_uq"], "left")
    elif window_rule == "tempo":
        # the knot at or after the note, else the last one
        tw = tempo_windows(knots, keys, width).select(*keys, F.col("pos_uq").alias("__kq"), "window_us")
        last = tw.groupBy(*keys).agg(F.max_by("window_us", "__kq").alias("__last"))
        s = asof(s, tw, keys, "pos_uq", "__kq", ["window_us"], width, direction="forward")
        s = s.join(last, keys, "left").withColumn("window_us", F.coalesce(
            "window_us", "__last", F.lit(float(BASE_WINDOW_US)))).drop("__last", "hit___kq")
    else:
        raise ValueError(f"unknown window rule {window_rule!r}")
    s = cut_lineage(s.withColumn(
        "label", F.when((F.col("label") == "missed") & F.col("is_grace"),
                        "ornament_skipped").otherwise(F.col("label"))))

    # ornament tolerance: extras near a grace or ornamented note
    special = s.where("(is_grace or is_orn) and expected_us is not null").select(
        *keys, F.col("pitch").alias("__sp"),
        (F.col("expected_us") - ORNAMENT_LEAD_US).alias("__lo"),
        F.when(F.col("is_grace"), F.col("expected_us") + GRACE_TAIL_US).otherwise(
            F.greatest("expected_end_us", "expected_us")).alias("__hi"))
    size = 1_000_000
    special = special.withColumn(CHUNK, F.explode(F.sequence(
        chunk_of("__lo", size), chunk_of("__hi", size))))
    near = (
        p.where("label = 'extra'").withColumn(CHUNK, chunk_of("onset_us", size))
        .join(special, [*keys, CHUNK])
        .where((F.col("onset_us") >= F.col("__lo")) & (F.col("onset_us") <= F.col("__hi"))
               & (F.abs(F.col("pitch") - F.col("__sp")) <= ORNAMENT_SEMITONES))
        .select(*kp).distinct().withColumn("__near", F.lit(True)))
    p = cut_lineage(p.join(near, kp, "left").withColumn(
        "label", F.when(F.col("__near"), "ornament").otherwise(F.col("label"))).drop("__near"))

    missed = s.where("label = 'missed'").select(
        *ks, F.col("pitch").alias("s_pitch"), "expected_us", "window_us")
    extra = p.where("label = 'extra'").select(*kp, F.col("pitch").alias("p_pitch"), "onset_us")
    wp = cut_lineage(pair_wrong_pitches(missed, extra, keys))
    left_over = listed.where("kind = 'dissolved'").select(*keys, "seq", "s_id", "p_id").join(
        missed.select(*ks), ks, "left_semi").join(extra.select(*kp), kp, "left_semi").join(
        wp.select(*ks), ks, "left_anti").join(wp.select(*kp), kp, "left_anti")
    wp2 = greedy_one_to_one(left_over, keys, [("s", "s_id"), ("p", "p_id")], ["seq"])
    wp = cut_lineage(wp.unionByName(wp2.select(*keys, "s_id", "p_id")))
    s = s.join(wp.select(*ks, F.col("p_id").alias("__w")), ks, "left").withColumns({
        "label": F.when(F.col("__w").isNotNull(), "wrong_pitch").otherwise(F.col("label")),
        "partner": F.coalesce("__w", "partner")}).drop("__w")
    p = p.join(wp.select(*kp, F.col("s_id").alias("__w")), kp, "left").withColumns({
        "label": F.when(F.col("__w").isNotNull(), "wrong_pitch").otherwise(F.col("label")),
        "partner": F.coalesce("__w", "partner")}).drop("__w")

    # place of a played note: its partner's position, else by the inverse time map
    sp = s.select(*keys, F.col("s_id").alias("partner"), F.col("pos_uq").alias("__pq"))
    inv = knots.select(*keys, F.col("knot_us").cast("bigint").alias("__kt"),
                       F.col("pos_uq").alias("__kq"))
    p = interpolate(p, inv, keys, "onset_us", "__kt", "__kq", width, "__iq")
    p = p.join(sp, [*keys, "partner"], "left").withColumn(
        "pos_uq", F.coalesce("__pq", F.round("__iq").cast("bigint"))).drop("__pq", "__iq")

    steps = listed.groupBy(*keys).agg(
        F.count(F.when(F.col("unknown"), 1)).alias("n_unknown_ids"),
        F.count(F.when(F.col("kind") == "dissolved", 1)).alias("n_pitch_dissolved"))
    if n_swaps is not None:
        steps = steps.join(n_swaps, keys, "left").withColumn(
            "n_reassigned", F.coalesce("n_reassigned", F.lit(0).cast("bigint")))
    return Correctness(s, p, steps)


def add_bars(res: Correctness, bars: DataFrame, keys: Sequence[str], width: int) -> Correctness:
    """Measure of every score note and played note (null outside the score)."""
    return Correctness(place_in_bars(res.score, bars, keys, "pos_uq", width),
                       place_in_bars(res.played, bars, keys, "pos_uq", width), res.steps)


def bar_table(res: Correctness, bars: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-bar counts from both sides, zero-filled over all bars; accuracy null if ungraded."""
    k = [*keys, "measure_idx"]

    def cnt(*labels: str):
        return F.count(F.when(F.col("label").isin(*labels), 1))

    a = res.score.where("measure_idx is not null").groupBy(*k).agg(
        cnt("correct", "wrong_pitch", "missed").alias("n_score_notes"),
        cnt("correct").alias("n_correct"), cnt("wrong_pitch").alias("n_wrong_pitch"),
        cnt("missed").alias("n_missed"), cnt("interpolated").alias("n_interpolated"))
    b = res.played.where("measure_idx is not null").groupBy(*k).agg(
        cnt("extra").alias("n_extra"), cnt("ornament").alias("n_ornament"))
    out = bars.select(*k).join(a, k, "left").join(b, k, "left").na.fill(0)
    return out.withColumns({
        "n_errors": F.col("n_wrong_pitch") + F.col("n_missed") + F.col("n_extra"),
        "accuracy": F.when(F.col("n_score_notes") > 0,
                           F.col("n_correct") / F.col("n_score_notes"))})


def summary(score: DataFrame, played: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, accuracy, error rate, match ratio and the suspect flag per performance."""
    keys = list(keys)

    def cnt(*labels: str):
        return F.count(F.when(F.col("label").isin(*labels), 1))

    a = score.groupBy(*keys).agg(
        cnt("correct", "wrong_pitch", "missed").alias("n_score_notes"),
        cnt("correct").alias("n_correct"), cnt("wrong_pitch").alias("n_wrong_pitch"),
        cnt("missed").alias("n_missed"), cnt("ornament_skipped").alias("n_ornament_skipped"),
        cnt("interpolated").alias("n_interpolated"))
    b = played.groupBy(*keys).agg(
        F.count(F.when(F.col("label") != "interpolated", 1)).alias("n_performed_notes"),
        cnt("extra").alias("n_extra"), cnt("ornament").alias("n_ornament"))
    j = a.join(b, keys, "full").na.fill(0)
    g = F.nullif(F.col("n_score_notes"), F.lit(0))
    ratio = 2.0 * F.col("n_correct") / F.greatest(
        F.lit(1), F.col("n_score_notes") + F.col("n_performed_notes"))
    return j.withColumns({
        "accuracy": F.col("n_correct") / g,
        "error_rate": (F.col("n_wrong_pitch") + F.col("n_missed") + F.col("n_extra")) / g,
        "match_ratio": ratio, "alignment_suspect": ratio < SUSPECT_MATCH_RATIO})
