"""Note-stream operators: events, chords, gaps, runs, pauses, profiles.

Positions and times are 64-bit integers in micro-units. Every function takes the key columns of a
stream (for example ``performance_id``) and works chunk by chunk (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.operators.folds import blocks_of, carried_fold
from ritardo.operators.ordered import CHUNK, asof, chunk_of, islands, scan, with_halo
from ritardo.operators.quantiles import exact_quantiles, group_values, median_sql
from ritardo.session import cut_lineage

INDEX_WIDTH = 4096
"""Rows per chunk when a stream is cut by its running row number."""


def tempo_from_beats(
    beats: DataFrame, keys: Sequence[str], pos: str, time: str, width: int, per_minute: float = 60e6
) -> DataFrame:
    """Beats per minute to the next beat; null for the last beat and for non-positive gaps."""
    gap = F.col("__t1") - F.col(time)
    return (
        scan(beats, keys, [pos], chunk_of(pos, width), __t1=("lead", time))
        .withColumn("tempo_bpm", F.when(gap > 0, F.lit(per_minute) / gap))
        .drop("__t1")
    )


def pitch_mask(high: bool, pitch: str = "pitch") -> Column:
    """Bit set of the pitches 0-63 (low word) or 64-127 (high word) of a group."""
    test = ">= 64" if high else "< 64"
    return F.expr(
        f"coalesce(bit_or(case when {pitch} {test} then"
        f" shiftleft(1L, cast({pitch} % 64 as int)) end), 0L)"
    )


def performed_events(
    notes: DataFrame, keys: Sequence[str], chord_us: int, width: int
) -> DataFrame:
    """Played events: a gap of more than ``chord_us`` to the note before starts a new one."""
    ev = islands(
        notes,
        keys,
        ["onset_us", "note_id"],
        chunk_of("onset_us", width),
        lambda p, c: c("onset_us") - p("onset_us") > chord_us,
        ["onset_us"],
        "event",
    )
    return ev.groupBy(*keys, "event").agg(
        F.min("onset_us").alias("onset_us"),
        F.count("*").alias("n_notes"),
        pitch_mask(False).alias("lo"),
        pitch_mask(True).alias("hi"),
    )


def score_events(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score events: notes of equal onset."""
    return notes.groupBy(*keys, "onset_uq").agg(
        F.count("*").alias("n_notes"),
        pitch_mask(False).alias("lo"),
        pitch_mask(True).alias("hi"),
    )


def chord_clusters(onsets: DataFrame, keys: Sequence[str], window_us: int, width: int) -> DataFrame:
    """Anchor-rule chords: an onset joins while within ``window_us`` of the chord's first onset.

    A gap wider than the window always starts a chord, so the fold runs only inside such
    stretches, over their distinct onsets, in blocks that hand on the open chord. Returns one row
    per distinct onset with its ``chord_us`` (first onset of the chord).
    """
    keys = list(keys)
    distinct = onsets.select(*keys, "onset_us").distinct()
    st = islands(
        distinct,
        keys,
        ["onset_us"],
        chunk_of("onset_us", width),
        lambda p, c: c("onset_us") - p("onset_us") > window_us,
        ["onset_us"],
        "stretch",
    )
    blocks = blocks_of(st, [*keys, "stretch"], ["onset_us"], chunk_of("onset_us", width))
    none = F.expr("cast(array() as array<struct<onset_us:bigint,chord_us:bigint>>)")

    def step(acc: Column, x: Column) -> Column:
        t = x["onset_us"]
        chord = F.when(t - acc["carry"] <= window_us, acc["carry"]).otherwise(t)
        return F.struct(chord.alias("carry"), F.concat(acc["out"], F.array(F.struct(
            t.alias("onset_us"), chord.alias("chord_us")))).alias("out"))

    def fold(carry: Column) -> Column:
        return F.aggregate("items", F.struct(carry.alias("carry"), none.alias("out")), step)

    return carried_fold(blocks, [*keys, "stretch"], fold, F.lit(None).cast("bigint")).drop("stretch")


def running_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "idx"
) -> DataFrame:
    """Row number from 0 inside the key."""
    out = scan(df.withColumn("__one", F.lit(1).cast("bigint")), keys, order, chunk,
               **{name: ("sum", "__one")})
    return out.withColumn(name, F.col(name) - 1).drop("__one")


def frame_halo(df: DataFrame, keys: Sequence[str], idx: str, before: int, after: int):
    """Halo copies for a ROWS frame over a running index, and its window."""
    halo = with_halo(df, idx, INDEX_WIDTH, before, after)
    w = W.partitionBy(*keys, CHUNK).orderBy(idx).rangeBetween(-before, after)
    return halo, w


def local_ioi(
    chords: DataFrame, keys: Sequence[str], width: int, back: int = 2, ahead: int = 1
) -> DataFrame:
    """Median gap between consecutive chord onsets around each chord (up to 4 gaps).

    ``chords`` has one row per chord (``chord_us``). Null for a single chord.
    """
    keys = list(keys)
    idx = scan(
        chords.withColumn("__one", F.lit(1).cast("bigint")),
        keys,
        ["chord_us"],
        chunk_of("chord_us", width),
        idx=("sum", "__one"),
        __next=("lead", "chord_us"),
    ).withColumn("gap_us", F.col("__next") - F.col("chord_us")).drop("__one", "__next")
    halo, w = frame_halo(idx, keys, "idx", back, ahead)
    return (
        halo.withColumn("local_ioi_us", F.percentile(F.col("gap_us").cast("double"), 0.5).over(w))
        .where("__home")
        .drop("__home", CHUNK)
    )


def expected_onsets(matched: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Monotone score-position -> time knots: median onset per position, then running maximum."""
    at = [*keys, "pos_uq"]
    values = group_values(matched, at, "onset_us", "__v")
    med = cut_lineage(exact_quantiles(matched, at, "onset_us", {"median_us": 0.5}) if values is None else
                      values.select(*at, F.expr(median_sql("__v")).alias("median_us")))
    return scan(
        med, keys, ["pos_uq"], chunk_of("pos_uq", width), knot_us=("max", "median_us")
    )


def interpolate(
    points: DataFrame,
    knots: DataFrame,
    keys: Sequence[str],
    pos: str,
    knot_pos: str,
    knot_val: str,
    width: int,
    name: str = "value",
    extrapolate: bool = True,
) -> DataFrame:
    """Piecewise-linear value at ``pos``; linear extrapolation from (or clamping to) end knots.

    One knot gives its value everywhere. The slopes of the first and last segment come from a
    per-key aggregate, so a point outside needs only the nearest knot.
    """
    keys = list(keys)
    segs = scan(
        knots.select(*keys, F.col(knot_pos).alias("__kp"), F.col(knot_val).alias("__kv")),
        keys,
        ["__kp", "__kv"],
        chunk_of("__kp", width),
        __np=("lead", "__kp"),
        __nv=("lead", "__kv"),
        __pp=("prev", "__kp"),
        __pv=("prev", "__kv"),
    )
    # a knot carries the segment to its right; the last knot the segment to its left
    fwd = (F.col("__nv") - F.col("__kv")) / F.greatest(F.col("__np") - F.col("__kp"), F.lit(1e-3))
    bwd = (F.col("__kv") - F.col("__pv")) / F.greatest(F.col("__kp") - F.col("__pp"), F.lit(1e-3))
    end_slope = bwd if extrapolate else F.lit(0.0)
    segs = segs.select(
        *keys,
        "__kp",
        F.col("__kv").cast("double").alias("__kv"),
        F.coalesce(fwd, end_slope, F.lit(0.0)).alias("__slope"),
    )
    segs = cut_lineage(segs)
    first = segs.groupBy(*keys).agg(
        F.min_by(F.struct("__kp", "__kv", "__slope"), F.struct("__kp", "__kv")).alias("__first")
    )
    hit = asof(points, segs, keys, pos, "__kp", ["__kv", "__slope"], width, right_tie="__kv")
    lead_slope = F.col("__first.__slope") if extrapolate else F.lit(0.0)
    return (
        hit.join(first, keys, "left")
        .withColumn(
            name,
            F.when(
                F.col("hit___kp").isNotNull(),
                F.col("__kv") + (F.col(pos) - F.col("hit___kp")) * F.col("__slope"),
            ).otherwise(
                F.col("__first.__kv") + (F.col(pos) - F.col("__first.__kp")) * lead_slope
            ),
        )
        .drop("__first", "__kv", "__slope", "hit___kp")
    )


def fast_repeats(
    score: DataFrame, keys: Sequence[str], time: str, max_ioi_us: int, width: int
) -> DataFrame:
    """Same-pitch predecessor with strictly earlier onset, due less than ``max_ioi_us`` before."""
    k = [*keys, "pitch"]
    first = score.groupBy(*k, "onset_uq").agg(F.min(time).alias("__t"))
    prev = scan(first, k, ["onset_uq"], chunk_of("onset_uq", width), __pt=("prev", "__t"))
    return (
        score.join(prev.select(*k, "onset_uq", "__pt"), [*k, "onset_uq"], "left")
        .withColumn(
            "fast_repeat", F.coalesce(F.col(time) - F.col("__pt") < max_ioi_us, F.lit(False))
        )
        .drop("__pt")
    )


def not_heard_runs(
    bars: DataFrame,
    keys: Sequence[str],
    *,
    min_bars: int = 3,
    share: float = 0.8,
    merge_gap: int = 0,
    gap_share: float = 0.5,
    width: int = 4096,
) -> DataFrame:
    """Runs of at least ``min_bars`` graded bars with ``share`` of their notes missed.

    ``bars``: key, ``measure_idx``, ``n_notes``, ``n_missed``. Bars without graded notes neither
    break nor extend a run. ``merge_gap`` joins runs (and reaches the edges) over at most that
    many graded bars when each of them has ``gap_share`` missed. Returns one row per run:
    first and last bar and the number of graded bars.
    """
    keys = list(keys)
    frac = F.col("n_missed") / F.col("n_notes")
    g = bars.where("n_notes > 0").select(
        *keys,
        "measure_idx",
        (frac >= share).alias("hit"),
        F.lit(1).cast("bigint").alias("__one"),
        F.when(frac >= gap_share, 0).otherwise(1).cast("bigint").alias("__bad"),
    )
    g = scan(g, keys, ["measure_idx"], chunk_of("measure_idx", width),
             idx=("sum", "__one"), bad=("sum", "__bad"))
    g = islands(g, keys, ["idx"], chunk_of("idx", width),
                lambda p, c: p("hit") != c("hit"), ["hit"], "run")
    runs = (
        g.where("hit")
        .groupBy(*keys, "run")
        .agg(
            F.min("measure_idx").alias("first_bar"),
            F.max("measure_idx").alias("last_bar"),
            F.min("idx").alias("i0"),
            F.max("idx").alias("i1"),
            F.max("bad").alias("bad"),
        )
        .where(F.col("i1") - F.col("i0") + 1 >= min_bars)
    )
    if merge_gap > 0:
        # bars in a gap are all missing when the count of heard bars does not change across it
        runs = islands(
            runs, keys, ["i0"], chunk_of("i0", width),
            lambda p, c: (c("i0") - p("i1") - 1 > merge_gap) | (c("bad") != p("bad")),
            ["i0", "i1", "bad"], "merged",
        )
        runs = runs.groupBy(*keys, "merged").agg(
            F.min("first_bar").alias("first_bar"), F.max("last_bar").alias("last_bar"),
            F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.max("bad").alias("bad"),
        )
        ends = g.groupBy(*keys).agg(
            F.min("measure_idx").alias("g0"), F.max("measure_idx").alias("g1"),
            F.max("idx").alias("n"), F.max("bad").alias("all_bad"),
        )
        runs = runs.join(ends, keys)
        head = (F.col("i0") - 1 <= merge_gap) & (F.col("bad") == 0)
        tail = (F.col("n") - F.col("i1") <= merge_gap) & (F.col("bad") == F.col("all_bad"))
        runs = runs.select(
            *keys,
            F.when(head, F.col("g0")).otherwise(F.col("first_bar")).alias("first_bar"),
            F.when(tail, F.col("g1")).otherwise(F.col("last_bar")).alias("last_bar"),
            F.when(head, F.lit(1)).otherwise(F.col("i0")).alias("i0"),
            F.when(tail, F.col("n")).otherwise(F.col("i1")).alias("i1"),
        )
    return runs.select(
        *keys, "first_bar", "last_bar", (F.col("i1") - F.col("i0") + 1).alias("n_bars")
    )


def even_runs(score: DataFrame, keys: Sequence[str], width: int, min_notes: int = 6) -> DataFrame:
    """Runs of equal-duration, rest-free onsets of one (staff, voice) stream.

    One row per run onset with ``run_start_uq``, ``pos`` and the sorted pitch set.
    """
    k = [*keys, "staff", "voice"]
    on = score.where("duration_uq > 0").groupBy(*k, "onset_uq").agg(
        F.min("duration_uq").alias("duration_uq"),
        F.sort_array(F.collect_list("pitch")).alias("pitches"),
    )
    run = islands(
        on, k, ["onset_uq"], chunk_of("onset_uq", width),
        lambda p, c: (c("onset_uq") != p("onset_uq") + p("duration_uq"))
        | (c("duration_uq") != p("duration_uq")),
        ["onset_uq", "duration_uq"], "run",
    )
    size = run.groupBy(*k, "run").agg(
        F.min("onset_uq").alias("run_start_uq"), F.count("*").alias("n_onsets")
    ).where(F.col("n_onsets") >= min_notes)
    # inside a run all durations are equal, so the place of an onset is plain arithmetic
    return run.join(size, [*k, "run"]).withColumn(
        "pos", F.expr("(onset_uq - run_start_uq) div duration_uq")
    ).drop("run")


def strict_runs(
    runs: DataFrame, keys: Sequence[str], min_notes: int = 6, max_period: int = 4
) -> DataFrame:
    """Monotone stretches or repeated figures inside even runs, merged where they touch.

    ``runs`` is the output of :func:`even_runs`. All tests (period 0 = melodic direction, 1 to
    ``max_period`` = equal to the pitch set that many onsets before) run as one long table.
    """
    k = [*keys, "staff", "voice", "run_start_uq"]
    runs = cut_lineage(runs.select(*k, "pos", "pitches"))
    tests = runs.select(*k, "pos", "pitches").withColumn(
        "period", F.explode(F.sequence(F.lit(0), F.lit(max_period)))
    )
    step = F.greatest(F.col("period"), F.lit(1))
    before = tests.select(*k, "period", (F.col("pos") + step).alias("pos"),
                          F.col("pitches").alias("__before"))
    t = tests.join(before, [*k, "period", "pos"])
    top, top0 = F.element_at("pitches", -1), F.element_at("__before", -1)
    t = t.withColumn(
        "__sig",
        F.when(F.col("period") == 0, F.signum((top - top0).cast("double")).cast("int"))
        .when(F.col("pitches") == F.col("__before"), 1).otherwise(0),
    ).select(*k, "period", "pos", "__sig")
    kp = [*k, "period"]
    isl = islands(t, kp, ["pos"], chunk_of("pos", INDEX_WIDTH),
                  lambda p, c: p("__sig") != c("__sig"), ["__sig"], "__i")
    spans = isl.where("__sig <> 0").groupBy(*kp, "__i").agg(
        (F.min("pos") - F.greatest(F.col("period"), F.lit(1))).alias("lo"),
        F.max("pos").alias("hi"),
    ).where(
        F.col("hi") - F.col("lo") + 1 >= F.greatest(F.lit(min_notes), F.col("period") * 2)
    )
    # union of covered onsets, then runs of covered onsets
    cover = cut_lineage(spans).select(
        *k, (F.col("period") == 0).alias("mono"), F.explode(F.sequence("lo", "hi")).alias("pos")
    ).groupBy(*k, "pos").agg(
        F.bool_or("mono").alias("mono"), F.bool_or(~F.col("mono")).alias("figure")
    )
    out = islands(cover, k, ["pos"], chunk_of("pos", INDEX_WIDTH),
                  lambda p, c: c("pos") != p("pos") + 1, ["pos"], "__r")
    m, f = F.bool_or("mono"), F.bool_or("figure")
    return out.groupBy(*k, "__r").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.when(m & f, "mixed").when(m, "monotone").otherwise("figure").alias("kind"),
    ).where(F.col("last_pos") - F.col("first_pos") + 1 >= min_notes).drop("__r")


def detect_pauses(
    beats: DataFrame,
    keys: Sequence[str],
    win: int,
    width: int,
    *,
    factor: float = 2.5,
    min_extra: float = 0.3e6,
) -> DataFrame:
    """Gaps at least ``factor`` x the local expectation and ``min_extra`` longer.

    ``beats``: key, ``pos`` (score), ``time``. The expectation of a gap is its length in beats
    times the median seconds per beat of the other gaps whose midpoint is within ``win``.
    Needs two others.
    """
    keys = list(keys)
    gaps = scan(beats, keys, ["pos"], chunk_of("pos", width),
                __p1=("lead", "pos"), __t1=("lead", "time")).where("__p1 is not null")
    gaps = gaps.select(
        *keys, "pos", "time",
        (F.col("__t1") - F.col("time")).alias("ioi"),
        (F.col("__p1") - F.col("pos")).alias("db"),
        (F.col("__p1") + F.col("pos")).alias("mid2"),
    ).withColumn("rate", F.col("ioi") / F.col("db"))
    halo = with_halo(gaps, "mid2", 2 * width, 2 * win, 2 * win)
    w = W.partitionBy(*keys, CHUNK).orderBy("mid2").rangeBetween(-2 * win, 2 * win)
    arr = F.sort_array(F.collect_list("rate").over(w))
    g = halo.withColumn("__a", arr).where("__home")
    at = F.array_position("__a", F.col("rate"))
    others = F.concat(
        F.slice("__a", F.lit(1), (at - 1).cast("int")),
        F.slice("__a", (at + 1).cast("int"), F.size("__a")),
    )
    g = g.withColumn("__o", others).withColumn("__n", F.size("__o"))
    mid = F.when(
        F.col("__n") >= 2,
        (
            F.element_at("__o", F.floor((F.col("__n") + 1) / 2).cast("int"))
            + F.element_at("__o", F.floor((F.col("__n") + 2) / 2).cast("int"))
        ) / 2,
    )
    exp = F.col("__m") * F.col("db")
    return (
        g.withColumn("__m", mid)
        .withColumn(
            "pause",
            F.coalesce(
                (F.col("ioi") >= factor * exp) & (F.col("ioi") - exp >= min_extra), F.lit(False)
            ),
        )
        .select(*keys, "pos", "ioi", exp.alias("expected"), "pause")
    )


def metric_profile(
    res: DataFrame, keys: Sequence[str], slot: str, value: str, min_count: int = 3
) -> DataFrame:
    """Median residual per beat-in-bar (0 with fewer than ``min_count``) and what is left."""
    k = [*keys, slot]
    med = exact_quantiles(res, k, value, {"__p": 0.5}, count="__n")
    prof = F.when(F.col("__n") >= min_count, F.col("__p")).otherwise(0.0)
    return res.join(med, k, "left").withColumn("profile", prof).withColumn(
        "jitter", F.col(value) - F.col("profile")
    ).drop("__p", "__n")


def steady_streams(
    notes: DataFrame, keys: Sequence[str], width: int, *, half: int = 4,
    lo: float = 0.6, hi: float = 1.6, min_len: int = 24,
) -> DataFrame:
    """Score-free steady streams: inter-onset interval over its centred running median in range.

    One row per stream of at least ``min_len`` intervals: count, mean and CV of the intervals.
    """
    keys = list(keys)
    on = notes.groupBy(*keys, "onset_us").agg(F.avg("velocity").alias("velocity"))
    g = scan(on.withColumn("__one", F.lit(1).cast("bigint")), keys, ["onset_us"],
             chunk_of("onset_us", width), idx=("sum", "__one"), __t1=("lead", "onset_us"))
    g = g.where("__t1 is not null").withColumn("ioi", F.col("__t1") - F.col("onset_us"))
    halo, w = frame_halo(g, keys, "idx", half, half)
    g = halo.withColumn("__m", F.percentile(F.col("ioi").cast("double"), 0.5).over(w)).where(
        "__home").drop("__home", CHUNK)
    r = F.col("ioi") / F.col("__m")
    g = g.withColumn("steady", (r > lo) & (r < hi))
    g = islands(g, keys, ["idx"], chunk_of("idx", INDEX_WIDTH),
                lambda p, c: p("steady") != c("steady"), ["steady"], "stream")
    return g.where("steady").groupBy(*keys, "stream").agg(
        F.min("onset_us").alias("start_us"), F.count("*").alias("n_iois"),
        F.avg("ioi").alias("ioi_mean"),
        (F.stddev_samp("ioi") / F.avg("ioi")).alias("ioi_cv"),
        F.stddev_samp("velocity").alias("velocity_sd"),
    ).where(F.col("n_iois") >= min_len).drop("stream")


def onset_sanity(
    notes: DataFrame, keys: Sequence[str], width: int, *, double_us: int = 50_000,
    short_us: int = 30_000,
) -> DataFrame:
    """Gross-failure checks of a transcription, one row per performance."""
    keys = list(keys)
    p = scan(notes, [*keys, "pitch"], ["onset_us", "note_id"], chunk_of("onset_us", width),
             __pt=("prev", "onset_us"))
    span = (F.max("onset_us") - F.min("onset_us")) / 1e6

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)) / F.count("*")

    return p.groupBy(*keys).agg(
        F.count("*").alias("n_notes"),
        F.when(span > 0, F.count("*") / span).alias("notes_per_sec"),
        share(F.col("onset_us") - F.col("__pt") < double_us).alias("share_double_trigger"),
        share(F.col("duration_us") < short_us).alias("share_short"),
        share((F.col("pitch") < 21) | (F.col("pitch") > 108)).alias("share_out_of_range"),
        F.min("pitch").alias("pitch_min"),
        F.max("pitch").alias("pitch_max"),
        F.avg("velocity").alias("vel_mean"),
        F.stddev_pop("velocity").alias("vel_sd"),
    )


def snap_durations(
    score: DataFrame, keys: Sequence[str], width: int, max_gap_rel: float = 0.07
) -> DataFrame:
    """Within a (staff, voice), extend a duration to the next onset over a small rest."""
    k = [*keys, "staff", "voice"]
    nxt = scan(score.select(*k, "onset_uq").distinct(), k, ["onset_uq"],
               chunk_of("onset_uq", width), __n=("lead", "onset_uq"))
    ioi = F.col("__n") - F.col("onset_uq")
    gap = ioi - F.col("duration_uq")
    return (
        score.join(nxt, [*k, "onset_uq"], "left")
        .withColumn(
            "duration_uq",
            F.when((gap > 0) & (gap <= max_gap_rel * ioi), ioi).otherwise(F.col("duration_uq")),
        )
        .drop("__n")
    )


def pedal_presses(
    pedal: DataFrame, keys: Sequence[str], width: int, threshold: float = 64
) -> DataFrame:
    """Pedal presses as intervals: ``down_us``, ``up_us`` (null while still down at the end)."""
    keys = list(keys)
    p = pedal.withColumn("down", F.col("value") >= threshold)
    p = scan(p, keys, ["time_us", "event_id"], chunk_of("time_us", width), __was=("prev", "down"))
    ch = p.where(F.col("down") != F.coalesce("__was", F.lit(False)))
    ch = scan(ch, keys, ["time_us", "event_id"], chunk_of("time_us", width),
              up_us=("lead", "time_us"))
    return ch.where("down").select(*keys, F.col("time_us").alias("down_us"), "up_us")


def pedal_summary(
    presses: DataFrame, spans: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Presses, share of time down and median press, over ``[start_us, end_us]`` of each key."""
    keys = list(keys)
    j = spans.join(presses, keys, "left").withColumn(
        "__up", F.coalesce("up_us", "end_us")
    ).withColumn("__len", F.when(F.col("down_us").isNotNull(), F.col("__up") - F.col("down_us")))
    held = F.greatest(
        F.lit(0), F.least("__up", "end_us") - F.greatest("down_us", "start_us")
    )
    med = exact_quantiles(j, keys, "__len", {"median_press_us": 0.5})
    s = j.groupBy(*keys).agg(
        F.count("down_us").alias("n_presses"),
        F.when(
            F.max(F.col("end_us") - F.col("start_us")) > 0,
            F.coalesce(F.sum(F.when(F.col("down_us").isNotNull(), held)), F.lit(0))
            / F.max(F.col("end_us") - F.col("start_us")),
        ).otherwise(0.0).alias("down_fraction"),
    )
    return s.join(med, keys, "left")


def place_in_bars(
    points: DataFrame, bars: DataFrame, keys: Sequence[str], pos: str, width: int
) -> DataFrame:
    """Bar of a position: the last bar that starts at or before it, if the position is inside."""
    hit = asof(points, bars, keys, pos, "start_uq", ["measure_idx", "end_uq"], width)
    inside = F.col(pos) < F.col("end_uq")
    return hit.withColumn("measure_idx", F.when(inside, F.col("measure_idx"))).drop(
        "end_uq", "hit_start_uq"
    )


_SLOPES = (
    "flatten(transform({a}, (p, i) -> transform(slice({a}, i + 2, size({a})),"
    " q -> (q.t - p.t) / (q.b - p.b))))"
)


def _median_sql(a: str) -> str:
    """Median of an array; null when it is empty."""
    s = f"array_sort({a})"
    n = f"size({a})"
    return (f"case when {n} > 0 then (element_at({s}, cast(floor(({n} + 1) / 2) as int))"
            f" + element_at({s}, cast(floor(({n} + 2) / 2) as int))) / 2 end")


def gross_outliers(
    beats: DataFrame, keys: Sequence[str], win: int, width: int, *, gross_us: float = 150_000.0,
    gross_beats: float = 0.5,
) -> DataFrame:
    """Positions that miss both one-sided Theil-Sen predictions by a wide margin.

    ``beats``: keys, ``pos`` and ``time`` (micro-units). Each side uses the positions within
    ``win``, or the nearest three; with one side only the tolerance doubles. The neighbours come
    from windows around the position, so no pair outside them is formed.
    """
    keys = list(keys)
    d = beats.selectExpr("*", "struct(pos / 1e6D as b, time / 1e6D as t) as __i")
    d = running_index(d, keys, ["pos"], chunk_of("pos", width))
    n = d.groupBy(*keys).agg(F.count("*").alias("__n"))
    near = with_halo(d, "pos", width, win, win)
    wr = W.partitionBy(*keys, CHUNK).orderBy("pos").rangeBetween(-win, win)
    near = near.withColumn("__r", F.collect_list("__i").over(wr)).where("__home").drop(
        "__home", CHUNK)
    halo, wi = frame_halo(near, keys, "idx", 3, 3)
    d = halo.withColumn("__k", F.collect_list("__i").over(wi)).where("__home").drop(
        "__home", CHUNK).join(n, keys)
    b = "(pos / 1e6D)"
    steps = {}
    for s, op in (("l", "<"), ("g", ">")):
        steps[f"__{s}"] = (
            f"case when size(filter(__r, x -> x.b {op} {b})) >= 3 then filter(__r, x -> x.b {op} {b})"
            f" else filter(__k, x -> x.b {op} {b}) end")
    d = d.selectExpr("*", *[f"{e} as {k}" for k, e in steps.items()])
    for s in "lg":
        a = f"__{s}"
        d = d.withColumn(f"__s{s}", F.expr(f"case when size({a}) >= 3 then "
                                           f"{_median_sql(_SLOPES.format(a=a))} end"))
        d = d.withColumn(f"__p{s}", F.expr(
            f"case when __s{s} > 0 then "
            f"({_median_sql(f'transform({a}, x -> x.t - __s{s} * x.b)')}) + __s{s} * {b} end"))
    sl = "filter(array(case when __sl > 0 then __sl end, case when __sg > 0 then __sg end), x -> x is not null)"
    d = d.withColumn("__tol", F.expr(
        f"greatest({gross_us / 1e6!r}D, {gross_beats!r}D * ({_median_sql(sl)}))"
        f" * case when size({sl}) = 1 then 2 else 1 end"))
    miss = ("(__pl is null or abs(time / 1e6D - __pl) > __tol) and (__pg is null or"
            " abs(time / 1e6D - __pg) > __tol) and (__pl is not null or __pg is not null)")
    return d.withColumn("gross", F.expr(f"coalesce(__n >= 6 and {miss}, false)")).select(
        *keys, "pos", "time", "gross")


def tempo_summary(beats: DataFrame, keys: Sequence[str], period: str) -> DataFrame:
    """Geometric-mean tempo, population SD and p90 - p10 of the log tempo ratio."""
    keys = list(keys)
    d = beats.withColumn("__l", F.ln(period))
    q = exact_quantiles(d, keys, "__l", {"__a": 0.1, "__z": 0.9})
    return d.groupBy(*keys).agg(
        F.count("__l").alias("n_beats"), (60.0 / F.exp(F.avg("__l"))).alias("tempo_bpm"),
        F.stddev_pop("__l").alias("log_sd")).join(q, keys).withColumn(
        "log_range", F.col("__z") - F.col("__a")).drop("__a", "__z")
