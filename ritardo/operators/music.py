"""Score and performance features: neighbourhoods, harmony, synchrony, voicing, phrases, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.functions.stats import steady_mean
from ritardo.operators.matching import range_join
from ritardo.operators.ordered import CHUNK, asof, chunk_of, scan, with_halo
from ritardo.operators.quantiles import exact_quantiles, robust_sd
from ritardo.session import cut_lineage

# fixed values: semitone distances of a note above a harmonic source
HARMONIC_STEPS = (12, 19, 24, 28, 31, 34, 36)

# fixed values: chord shapes as semitones above the root
CHORD_SHAPES = {
    "maj": (0, 4, 7), "min": (0, 3, 7), "dim": (0, 3, 6), "aug": (0, 4, 8),
    "dom7": (0, 4, 7, 10), "maj7": (0, 4, 7, 11), "min7": (0, 3, 7, 10),
    "hdim7": (0, 3, 6, 10), "dim7": (0, 3, 6, 9),
}
# fixed values: shapes of each template set
TEMPLATE_SETS = {
    "all": ("maj", "min", "dim", "aug", "dom7", "maj7", "min7", "hdim7", "dim7"),
    "no_maj7": ("maj", "min", "dim", "aug", "dom7", "min7", "hdim7", "dim7"),
    "functional": ("maj", "min", "dim", "aug", "dom7", "hdim7", "dim7"),
    "triads": ("maj", "min", "dim", "aug"),
}


def chord_masks(name: str) -> list[int]:
    """12-bit pitch-class masks of all transpositions of a template set."""
    return sorted({
        sum(1 << ((root + step) % 12) for step in CHORD_SHAPES[shape])
        for shape in TEMPLATE_SETS[name] for root in range(12)
    })


def note_features(
    notes: DataFrame, keys: Sequence[str], *, chord_us: int = 50_000, local_us: int = 1_000_000,
    reg_us: int = 500_000, back_us: int = 4_000_000, width: int = 16_000_000,
) -> DataFrame:
    """Neighbourhood features of every note from the transcription alone.

    One RANGE window around each note (with halo copies at chunk edges) gives the neighbours; the
    same-pitch gap is an ordered scan and the pitch histogram a small aggregate.
    """
    keys = list(keys)
    d = notes.withColumn("__item", F.struct("note_id", "onset_us", "pitch", "velocity", (
        F.col("onset_us") + F.col("duration_us")).alias("off_us")))
    halo = with_halo(d, "onset_us", width, max(back_us, local_us), local_us)
    w = W.partitionBy(*keys, CHUNK).orderBy("onset_us").rangeBetween(-back_us, local_us)
    g = halo.withColumn("__n", F.collect_list("__item").over(w)).where("__home")
    t, p, v = F.col("onset_us"), F.col("pitch"), F.col("velocity")

    def near(dist: int) -> Column:
        return F.filter("__n", lambda x: (F.abs(x["onset_us"] - t) <= dist)
                        & (x["note_id"] != F.col("note_id")))

    g = g.withColumns({"__loc": near(local_us), "__ch": near(chord_us), "__rg": near(reg_us)})
    vel = F.array_sort(F.transform("__loc", lambda x: x["velocity"]))
    n = F.size("__loc")
    mid = (F.element_at("__v", F.floor((n + 1) / 2).cast("int")) + F.element_at(
        "__v", F.floor((n + 2) / 2).cast("int"))) / 2
    harmonic = [F.lit(h) for h in HARMONIC_STEPS]

    def is_source(x: Column) -> Column:
        return (p - x["pitch"]).isin(*harmonic)

    sounding = F.exists("__n", lambda x: (x["onset_us"] <= t + chord_us) & (
        x["off_us"] >= t - chord_us) & is_source(x))
    g = g.withColumn("__v", vel).withColumns({
        "density": n, "n_chord": F.size("__ch"),
        "vel_rel_local": F.when(n > 0, v - mid).otherwise(0.0),
        "vel_rel_chord": F.when(F.size("__ch") > 0, v - F.array_max(F.transform(
            "__ch", lambda x: x["velocity"]))).otherwise(0),
        "harm_onset": F.exists("__ch", is_source),
        "harm_sounding": sounding,
        "gap_above": p - F.array_max(F.transform("__rg", lambda x: x["pitch"])),
        "gap_nearest": F.array_min(F.transform("__rg", lambda x: F.abs(p - x["pitch"]))),
    }).drop("__n", "__loc", "__ch", "__rg", "__v", "__home", "__item", CHUNK)
    g = scan(g, [*keys, "pitch"], ["onset_us", "note_id"], chunk_of("onset_us", width),
             __prev=("prev", "onset_us"))
    dt = (t - F.col("__prev")) / 1e6
    g = g.withColumn("same_pitch_dt", F.when(F.col("__prev").isNotNull(), F.ln(
        F.least(F.lit(10.0), dt) + 1e-3)).otherwise(F.ln(F.lit(10.0)))).drop("__prev")
    # pitch histogram: a pitch against the mean of its four neighbours inside 0 .. 127
    cnt = notes.groupBy(*keys, "pitch").agg(F.count("*").alias("__c"))
    spread = cnt.select(*keys, F.explode(F.array(*[F.col("pitch") + s for s in (
        -2, -1, 1, 2)])).alias("pitch"), "__c").groupBy(*keys, "pitch").agg(F.sum("__c").alias(
            "__around"))
    inside = sum((F.when((F.col("pitch") + s >= 0) & (F.col("pitch") + s < 128), 1).otherwise(0)
                  for s in (-2, -1, 1, 2)), F.lit(0))
    spike = cnt.join(spread, [*keys, "pitch"], "left").select(
        *keys, "pitch", F.ln((F.col("__c") + 1) / (F.coalesce("__around", F.lit(0)) / inside + 1)
                             ).alias("pitch_spike"))
    return g.join(spike, [*keys, "pitch"]).withColumn(
        "log_dur", F.ln(F.greatest(F.col("duration_us") / 1e6, F.lit(0.0)) + 1e-3))


def spurious_rule(
    min_pitch: int = 96, max_vel_rel: float = 99.0, min_spike: float = 0.5, max_dur: float = 0.1
) -> Column:
    """High, short, without a harmonic source, on a pitch as common as its neighbours."""
    return (
        (F.col("pitch") >= min_pitch) & ~F.col("harm_onset") & ~F.col("harm_sounding")
        & (F.col("log_dur") < F.ln(F.lit(max_dur + 1e-3)))
        & (F.col("vel_rel_local") <= max_vel_rel) & (F.col("pitch_spike") >= min_spike))


WINDOWS = 1024  # windows of a key whose notes lie in one task


def harmony_windows(
    score: DataFrame, keys: Sequence[str], window: int, min_weight: float = 0.15
) -> DataFrame:
    """Pitch content of fixed windows: bass, pitch-class mask, first onset in the window.

    Notes are shuffled once, to their chunk of windows (to both where they reach over); twelve
    conditional sums per window follow in place.
    """
    keys = list(keys)
    k = [f"`{x}`" for x in keys]
    first, last = (f"cast(floor({x} / {float(window)!r}D) as bigint)" for x in (
        "onset_uq", "(onset_uq + duration_uq - 1)"))
    s = score.where("duration_uq > 0").selectExpr(
        *k, "onset_uq", "duration_uq", "cast(pitch as int) as pitch",
        f"explode(sequence({first} div {WINDOWS} - cast({first} % {WINDOWS} < 0 as int),"
        f" {last} div {WINDOWS} - cast({last} % {WINDOWS} < 0 as int))) as __c")
    s = s.repartition(*keys, "__c").selectExpr(
        *k, "__c", "onset_uq", "onset_uq + duration_uq as off", "pitch",
        f"explode(sequence(greatest({first}, __c * {WINDOWS}),"
        f" least({last}, __c * {WINDOWS} + {WINDOWS - 1}))) as w")
    s = s.selectExpr(
        *k, "__c", "w", "pitch", "pitch % 12 as pc",
        f"least(off, (w + 1) * {window}L) - greatest(onset_uq, w * {window}L) as ov",
        f"case when onset_uq >= w * {window}L then onset_uq end as first")
    g = s.groupBy(*keys, "__c", "w").agg(
        *[F.expr(f"sum(case when pc = {i} then ov else 0 end) as s{i}") for i in range(12)],
        F.expr("sum(ov) as tot"), F.expr("min(pitch) % 12 as bass"),
        F.expr("min(first) as first_onset"))
    heavy = " | ".join(
        f"case when s{i} > 0 and s{i} / tot >= {min_weight!r}D or bass = {i} then {1 << i}L else 0L"
        " end" for i in range(12))
    return g.selectExpr(*[f"`{k}`" for k in keys], "w", f"({heavy}) as pcs",
                        "cast(bass as bigint) as bass", "first_onset")


def harmony_changes(
    windows: DataFrame, keys: Sequence[str], *, templates: str = "functional",
    require_bass_change: bool = True,
) -> DataFrame:
    """A window starts a new harmony when its bass differs from the previous non-empty window and
    their joint pitch classes fit no chord template."""
    w = scan(windows, keys, ["w"], chunk_of("w", 4096), combine=True, prev_bass=("prev", "bass"),
             __pp=("prev", "pcs"))
    masks = F.array(*[F.lit(m).cast("bigint") for m in chord_masks(templates)])
    union = F.col("pcs").bitwiseOR(F.col("__pp"))
    fits = F.exists(masks, lambda t: union.bitwiseAND(F.bitwise_not(t)) == 0)
    moved = F.col("bass") != F.col("prev_bass") if require_bass_change else F.lit(True)
    return w.where(F.col("prev_bass").isNotNull() & moved & F.col("first_onset").isNotNull()
                   & ~fits).select(*keys, "w", "first_onset", "bass", "prev_bass", "pcs")


def pedal_blur(
    changes: DataFrame, pedal: DataFrame, keys: Sequence[str], width: int, *, before: float = 0.25,
    after: float = 0.5, max_beats: float = 4.0, threshold: int = 64,
) -> DataFrame:
    """Pedal held across each change: down before it and not lifted until after it.

    ``changes``: keys, ``time_us``, ``period_us``; ``pedal``: keys, ``time_us``, ``event_id``,
    ``value``. The blur lasts to the first lift, the next change or ``max_beats``.
    """
    keys = list(keys)
    c = scan(changes, keys, ["time_us"], chunk_of("time_us", width), __next=("lead", "time_us"))
    c = c.withColumns({
        "__a0": (F.col("time_us") - before * F.col("period_us")).cast("bigint"),
        "__a1": (F.col("time_us") + after * F.col("period_us")).cast("bigint")})
    ev = pedal.select(*keys, F.col("time_us").alias("__pt"), (F.col("value") >= threshold).alias(
        "__down"), "event_id")
    at = asof(c, ev, keys, "__a0", "__pt", ["__down"], width, right_tie="event_id")
    lifts = ev.where("not __down").select(*keys, F.col("__pt").alias("__lift"))
    up = asof(at, lifts, keys, "__a0", "__lift", [], width, direction="forward", strict=True)
    up = up.withColumnRenamed("hit___lift", "__up")
    held = F.coalesce(F.col("__down"), F.lit(False)) & (
        F.col("__up").isNull() | (F.col("__up") > F.col("__a1")))
    cap = F.least(F.coalesce("__next", F.lit(2**62)), F.col("time_us") + (
        max_beats * F.col("period_us")).cast("bigint"))
    end = F.least(F.coalesce("__up", F.lit(2**62)), cap)
    return up.withColumn("blurred", held).withColumn(
        "blur_beats", F.when(F.col("blurred"), (end - F.col("time_us")) / F.col("period_us"))
        .otherwise(0.0)).select(*keys, "time_us", "period_us", "blurred", "blur_beats")


def hand_synchrony(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Onsets with both staves: asynchrony in ms (staff 1 minus staff 2), velocity difference and
    the residual of the line on points within three robust SDs."""
    keys = list(keys)

    def mean(c: str, staff: int) -> Column:
        return F.avg(F.when(F.col("staff") == staff, F.col(c)))

    g = matched.groupBy(*keys, "onset_uq").agg(
        (1000 * (mean("onset_sec", 1) - mean("onset_sec", 2))).alias("async_ms"),
        (mean("velocity", 1) - mean("velocity", 2)).alias("dv"))
    g = cut_lineage(g.where("async_ms is not null and dv is not null"))
    sd = robust_sd(g, keys, "async_ms", "__sd")
    g = g.join(sd, keys)
    inl = (F.col("__sd") <= 0) | (
        F.abs(F.col("async_ms") - F.col("__sd_median")) <= 3 * F.greatest(F.col("__sd"), F.lit(1e-9)))
    x, y = F.when(inl, F.col("dv")), F.when(inl, F.col("async_ms"))
    fit = g.groupBy(*keys).agg(
        F.count(x).alias("__n"), F.regr_slope(y, x).alias("__b"), F.avg(y).alias("__my"),
        F.avg(x).alias("__mx"), (F.max(x) - F.min(x)).alias("__range"))
    ok = (F.col("__n") >= 3) & (F.col("__range") > 0)
    fit = fit.select(*keys, F.when(ok, F.col("__b")).otherwise(0.0).alias("slope"), F.when(
        ok, F.col("__my") - F.col("__b") * F.col("__mx")).otherwise(F.col("__my")).alias(
            "intercept"))
    return g.join(fit, keys).withColumn("resid_ms", F.col("async_ms") - F.col("intercept") - F.col(
        "slope") * F.col("dv")).drop("__sd", "__sd_median", "__sd_n")


def synchrony_summary(onsets: DataFrame, keys: Sequence[str], equal_velocity: float = 5.0
                      ) -> DataFrame:
    """Mean, median and robust SD of the asynchrony, slope, and the equal-velocity mean."""
    keys = list(keys)
    onsets = cut_lineage(onsets)
    eq = F.abs(F.col("dv")) <= equal_velocity
    a = onsets.groupBy(*keys).agg(
        F.count("*").alias("n_onsets"), F.avg("async_ms").alias("mean_ms"),
        F.max("slope").alias("vel_slope_ms"), F.count(F.when(eq, 1)).alias("n_equal"),
        F.avg(F.when(eq, F.col("async_ms"))).alias("equal_mean_ms"))
    sd = robust_sd(onsets, keys, "async_ms", "sd_ms").withColumnRenamed(
        "sd_ms_median", "median_ms").drop("sd_ms_n")
    rs = robust_sd(onsets, keys, "resid_ms", "resid_sd_ms").select(*keys, "resid_sd_ms")
    return a.join(sd, keys).join(rs, keys)


def onset_table(score: DataFrame, keys: Sequence[str], max_duration: int) -> DataFrame:
    """Per onset: top, bass, size, last end, highest pitch held over, and the skyline melody.

    ``max_duration`` bounds how far back a held note can start (the longest note of the score).
    """
    keys = list(keys)
    on = score.groupBy(*keys, "onset_uq").agg(
        F.max("pitch").alias("top"), F.min("pitch").alias("bass"), F.count("*").alias("n_notes"),
        F.max(F.col("onset_uq") + F.col("duration_uq")).alias("max_end"))
    started = score.groupBy(*keys, F.col("onset_uq").alias("__s"), (
        F.col("onset_uq") + F.col("duration_uq")).alias("__e")).agg(F.max("pitch").alias("__p"))
    j = range_join(on.select(*keys, "onset_uq"), started, keys, "onset_uq", "__s", max_duration, 0)
    held = j.where((F.col("__s") < F.col("onset_uq")) & (F.col("__e") > F.col("onset_uq"))).groupBy(
        *keys, "onset_uq").agg(F.max("__p").alias("held"))
    h = F.coalesce("held", F.lit(-1))
    return on.join(held, [*keys, "onset_uq"], "left").withColumns({
        "held": h, "melody_new": F.col("top") >= h, "melody_pitch": F.greatest("top", h)})


def voicing(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per onset: top note against the lower notes: velocity difference and melody lead (ms)."""
    k = [*keys, "onset_uq"]
    m = notes.groupBy(*k).agg(F.max_by(
        F.struct("note_id", "pitch", "velocity", "onset_sec"), F.struct("pitch", "note_id")).alias(
            "__m"))
    j = notes.join(m, k).where("pitch < __m.pitch")
    return j.groupBy(*k).agg(
        F.first("__m.note_id").alias("melody_id"), F.count("*").alias("n_accomp"),
        (F.first("__m.velocity") - F.avg("velocity")).alias("vel_diff"),
        (1000 * (F.avg("onset_sec") - F.first("__m.onset_sec"))).alias("lead_ms"))


def voicing_bars(onsets: DataFrame, keys: Sequence[str], bar: str) -> DataFrame:
    """Means of ``voicing`` per bar."""
    return onsets.groupBy(*keys, bar).agg(
        F.count("*").alias("n"), F.avg("vel_diff").alias("vel_diff"), F.avg("lead_ms").alias("lead_ms"))


def voicing_summary(onsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means, medians, share of louder melodies, and correlation of lead and loudness per key."""
    keys = list(keys)
    s = onsets.groupBy(*keys).agg(
        F.count("*").alias("n_onsets"), steady_mean(F.col("vel_diff")).alias("vel_diff_mean"),
        F.avg((F.col("vel_diff") > 0).cast("double")).alias("share_louder"),
        steady_mean(F.col("lead_ms")).alias("lead_mean_ms"), F.corr("lead_ms", "vel_diff").alias("lead_vel_corr"))
    for col, name in (("vel_diff", "vel_diff_median"), ("lead_ms", "lead_median_ms")):
        s = s.join(exact_quantiles(onsets, keys, col, {name: 0.5}), keys)
    return s


def legato_overlap(
    notes: DataFrame, keys: Sequence[str], width: int, tol_uq: int = 1
) -> DataFrame:
    """Share of melody notes, followed at once by the next, that are held into it.

    ``notes``: keys, ``note_id``, ``onset_uq``, ``duration_uq``, ``pitch``, ``onset_sec``,
    ``release_sec``; the melody is the top note of every onset. Null below three melody notes, or
    where none meets the next.
    """
    keys = list(keys)
    top = notes.groupBy(*keys, "onset_uq").agg(F.max_by(F.struct(
        "duration_uq", "onset_sec", "release_sec"), F.struct("pitch", "note_id")).alias("__m"))
    top = top.select(*keys, "onset_uq", "__m.*")
    nxt = scan(top, keys, ["onset_uq"], chunk_of("onset_uq", width), __nq=("lead", "onset_uq"),
               __ns=("lead", "onset_sec"))
    meets = F.abs(F.col("onset_uq") + F.col("duration_uq") - F.col("__nq")) <= tol_uq
    over = F.avg(F.when(meets, (F.col("release_sec") > F.col("__ns")).cast("double")))
    return nxt.groupBy(*keys).agg(F.when(F.count("*") >= 3, over).alias("legato_overlap"))


def chord_spread(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median time from the first to the last note of score onsets with several notes, in ms."""
    c = notes.groupBy(*keys, "onset_uq").agg(
        (1000 * (F.max("onset_sec") - F.min("onset_sec"))).alias("__s"), F.count("*").alias("__n"))
    return exact_quantiles(c.where("__n >= 2"), keys, "__s", {"chord_spread_ms": 0.5})


def quadratic_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 3
                  ) -> DataFrame:
    """Parabola per group on x scaled to [-1, 1], from power sums: c0, c1, c2, r2."""
    keys = list(keys)
    lim = df.groupBy(*keys).agg(F.min(x).alias("__x0"), F.max(x).alias("__x1"))
    u = 2 * (F.col(x) - F.col("__x0")) / F.greatest(F.col("__x1") - F.col("__x0"), F.lit(
        1e-9)) - 1
    d = df.join(lim, keys).select(*keys, u.alias("u"), F.col(y).alias("y")).withColumn(
        "q", F.col("u") * F.col("u"))
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("u").alias("mu"), F.avg("q").alias("mq"),
        F.avg("y").alias("my"), F.var_pop("u").alias("uu"), F.var_pop("q").alias("qq"),
        F.covar_pop("u", "q").alias("uq"), F.covar_pop("u", "y").alias("uy"),
        F.covar_pop("q", "y").alias("qy"), F.var_pop("y").alias("yy"))
    det = F.col("uu") * F.col("qq") - F.col("uq") * F.col("uq")
    ok = (F.col("n") >= min_points) & (det > 1e-15)
    c1 = F.when(ok, (F.col("qq") * F.col("uy") - F.col("uq") * F.col("qy")) / det)
    c2 = F.when(ok, (F.col("uu") * F.col("qy") - F.col("uq") * F.col("uy")) / det)
    s = s.withColumns({"c1": c1, "c2": c2})
    fit = F.col("c1") * F.col("uy") + F.col("c2") * F.col("qy")
    return s.select(*keys, "n", (F.col("my") - F.col("c1") * F.col("mu") - F.col("c2") * F.col(
        "mq")).alias("c0"), "c1", "c2", F.when(F.col("yy") > 0, fit / F.col("yy")).alias("r2"),
        (F.col("yy") * F.col("n")).alias("ss"))


def phrase_arcs(
    beats: DataFrame, starts: DataFrame, keys: Sequence[str], beat: str, value: str, width: int,
    min_beats: int = 3,
) -> DataFrame:
    """Parabola of the tempo curve in each phrase (phrases given by their start beats)."""
    p = asof(beats, starts.select(*keys, F.col("start").alias("__start")), keys, beat, "__start",
             [], width).withColumnRenamed("hit___start", "start").where("start is not null")
    return quadratic_fit(p, [*keys, "start"], beat, value, max(min_beats, 3))


def arc_summary(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fitted phrases, share of concave arcs, pooled within-phrase R2."""
    ok = F.col("c2").isNotNull()
    res = F.when(ok & F.col("r2").isNotNull(), (1 - F.col("r2")) * F.col("ss")).otherwise(
        F.col("ss"))
    return arcs.groupBy(*keys).agg(
        F.count(F.when(ok, 1)).alias("n_phrases"),
        F.avg(F.when(ok, (F.col("c2") < 0).cast("int"))).alias("concave_share"),
        (1 - F.sum(res) / F.nullif(F.sum("ss"), F.lit(0.0))).alias("arc_r2_within"))


def shift_boundaries(starts: DataFrame, spans: DataFrame, keys: Sequence[str], shift: int
                     ) -> DataFrame:
    """Circular shift of phrase starts inside ``[lo, hi)``: same number and spacing."""
    j = starts.join(spans, list(keys))
    pos = F.pmod(F.col("start") - F.col("lo") + shift, F.col("hi") - F.col("lo"))
    return j.select(*keys, (F.col("lo") + pos).alias("start"))


def evenness(run_notes: DataFrame, keys: Sequence[str], *, min_iois: int = 4, long_run: int = 12
             ) -> DataFrame:
    """Per run: CV of tempo-normalised intervals, velocity SD after a trend, note rate.

    ``run_notes``: keys of the run, ``pos``, ``onset_us``, ``expected_us``, ``velocity``. The
    trend is linear, quadratic from ``long_run`` notes on.
    """
    keys = list(keys)
    r = scan(run_notes, keys, ["pos"], chunk_of("pos", 4096), __t=("lead", "onset_us"),
             __e=("lead", "expected_us"))
    ioi = F.col("__t") - F.col("onset_us")
    exp = F.col("__e") - F.col("expected_us")
    ratio = F.when(exp > 0, ioi / exp)
    a = r.withColumns({"__r": ratio, "__i": F.when(ratio.isNotNull(), ioi)}).groupBy(*keys).agg(
        F.count("*").alias("n_onsets"), F.count("__r").alias("n_iois"),
        F.when(F.count("__r") >= min_iois, F.stddev_samp("__r") / F.avg("__r")).alias("ioi_cv"),
        (F.count("__r") / F.nullif(F.sum("__i"), F.lit(0)) * 1e6).alias("note_rate"))
    q = quadratic_fit(run_notes, keys, "pos", "velocity").select(
        *keys, F.col("n").alias("__nv"), (F.col("ss") * (1 - F.col("r2"))).alias("__sq"))
    lin = run_notes.groupBy(*keys).agg(
        (F.regr_syy("velocity", "pos") - F.regr_slope("velocity", "pos") * F.regr_sxy(
            "velocity", "pos")).alias("__sl"))
    j = a.join(q, keys).join(lin, keys)
    deg = F.when(F.col("__nv") >= long_run, 2).otherwise(1)
    sse = F.when(deg == 2, F.col("__sq")).otherwise(F.col("__sl"))
    return j.withColumn("vel_sd", F.when(F.col("__nv") >= F.greatest(F.lit(5), deg + 3), F.sqrt(
        F.greatest(sse, F.lit(0.0)) / (F.col("__nv") - deg - 1)))).drop("__nv", "__sq", "__sl")


def bar_positions(notes: DataFrame, bars: DataFrame, keys: Sequence[str], length: int) -> DataFrame:
    """Place in the bar; a short first bar (pickup) is aligned to its right edge."""
    b = bars.select(*keys, "measure_idx", "start_uq", "end_uq")
    first = b.groupBy(*keys).agg(F.min("measure_idx").alias("__m0"))
    j = notes.join(b, [*keys, "measure_idx"]).join(first, list(keys))
    size = F.col("end_uq") - F.col("start_uq")
    pad = F.when((F.col("measure_idx") == F.col("__m0")) & (size < length), length - size).otherwise(
        0)
    return j.withColumn("pos_in_bar", F.col("onset_uq") - F.col("start_uq") + pad).drop(
        "__m0", "start_uq", "end_uq")


def event_kernels(
    points: DataFrame, events: DataFrame, keys: Sequence[str], pos: str, bar: float, width: int,
) -> DataFrame:
    """``exp(-d)`` to the next event at or after a position and from the last one before it;
    0 where there is none."""
    ev = events.select(*keys, F.col("event").alias("__ev"))
    a = asof(points, ev, keys, pos, "__ev", [], width, direction="forward")
    a = a.withColumnRenamed("hit___ev", "__nx")
    b = asof(a, ev, keys, pos, "__ev", [], width, strict=True).withColumnRenamed(
        "hit___ev", "__pv")

    def kernel(d: Column) -> Column:
        return F.coalesce(F.exp(-(d / bar)), F.lit(0.0))

    return b.withColumns({"pre": kernel(F.col("__nx") - F.col(pos)),
                          "post": kernel(F.col(pos) - F.col("__pv"))}).drop("__nx", "__pv")


def hand_risk_flags(
    score: DataFrame, keys: Sequence[str], max_notes: int = 5, max_span: int = 14
) -> DataFrame:
    """Per note: staff differs from its voice's modal staff; its staff has more notes or a wider
    span at this onset than one hand plays; it crosses the other staff's notes there."""
    keys = list(keys)
    v = [*keys, "voice"]
    n = score.groupBy(*v).agg(
        F.count(F.when(F.col("staff") == 1, 1)).alias("__n1"),
        F.count(F.when(F.col("staff") == 2, 1)).alias("__n2"))

    def stat(f, c: str, staff: int) -> Column:
        return f(F.when(F.col("staff") == staff, F.col(c)))

    o = score.groupBy(*keys, "onset_uq").agg(
        F.max(F.lit(1)).alias("__x"),
        *[stat(F.count, "pitch", s).alias(f"__c{s}") for s in (1, 2)],
        *[stat(F.min, "pitch", s).alias(f"__lo{s}") for s in (1, 2)],
        *[stat(F.max, "pitch", s).alias(f"__hi{s}") for s in (1, 2)])
    j = score.join(n, v).join(o, [*keys, "onset_uq"])
    modal = F.when(F.col("__n1") > F.col("__n2"), 1).when(F.col("__n2") > F.col("__n1"), 2)
    right = F.col("staff") == 1

    def own(c: str) -> Column:
        return F.when(right, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))

    cross = F.when(right, F.col("pitch") < F.col("__hi2")).otherwise(
        F.col("pitch") > F.col("__lo1"))
    return j.select(
        *score.columns,
        F.coalesce(F.col("staff") != modal, F.lit(False)).alias("off_staff"),
        F.coalesce(cross, F.lit(False)).alias("crossing"),
        ((own("__c") > max_notes) | (own("__hi") - own("__lo") > max_span)).alias("stretch"))


def bar_window_span(matched: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Time span of a bar range: first matched onset to the median onset of the next bar's first
    position (open at the end of the piece)."""
    keys = list(keys)
    inside = matched.where(F.col("measure_idx").between(first, last)).groupBy(*keys).agg(
        F.min("onset_us").alias("start_us"))
    nxt = matched.where(F.col("measure_idx") == last + 1)
    pos = nxt.groupBy(*keys).agg(F.min("pos").alias("pos"))
    end = exact_quantiles(nxt.join(pos, [*keys, "pos"], "left_semi"), keys, "onset_us",
                          {"end_us": 0.5})
    return inside.join(end, keys, "left")


def global_descriptors(notes: DataFrame, keys: Sequence[str], bar: str) -> DataFrame:
    """Velocity mean / SD / p95 - p5, SD of bar means, duration median and IQR, and notes per second
    from the first onset to the last release."""
    keys = list(keys)
    q = exact_quantiles(notes, keys, "velocity", {"__p5": 0.05, "__p95": 0.95})
    d = exact_quantiles(notes, keys, "duration_us", {"art_median": 0.5, "__q1": 0.25, "__q3": 0.75})
    b = notes.groupBy(*keys, bar).agg(F.avg("velocity").alias("__m")).groupBy(*keys).agg(
        F.stddev_samp("__m").alias("bar_vel_sd"))
    span = (F.max(F.col("onset_us") + F.col("duration_us")) - F.min("onset_us")) / 1e6
    a = notes.groupBy(*keys).agg(
        F.avg("velocity").alias("vel_mean"), F.stddev_pop("velocity").alias("vel_sd"),
        F.when(span > 0, F.count("*") / span).alias("notes_per_sec"))
    j = a.join(q, keys).join(d, keys).join(b, keys)
    return j.select(*keys, "vel_mean", "vel_sd", (F.col("__p95") - F.col("__p5")).alias(
        "vel_range"), "bar_vel_sd", "art_median", (F.col("__q3") - F.col("__q1")).alias("art_iqr"),
        "notes_per_sec")


def bar_window_notes(notes: DataFrame, span: DataFrame, keys: Sequence[str], first: int, last: int, *,
                     early_us: int = 30_000, release_us: int = 0, lead_us: int = 0,
                     least_us: int = 20_000) -> DataFrame:
    """The notes of a bar range as a performance of their own, which begins at ``lead_us``.

    ``notes``: keys, onset_us, duration_us, measure_idx (null where the note is matched to no bar);
    ``span``: keys, start_us, end_us from :func:`bar_window_span`, open where end_us is null. Matched
    notes belong by their bar, others by their time, from ``early_us`` before the start to just
    before the end. Durations end ``release_us`` after the end and are no shorter than ``least_us``.
    Returns the kept rows with ``new_onset_us`` and ``new_duration_us``.
    """
    keys = list(keys)
    top = notes.groupBy(*keys).agg(F.max(F.col("onset_us") + F.col("duration_us")).alias("__top"))
    s = span.select(*keys, "start_us", "end_us").join(top, keys).withColumn(
        "__end", F.coalesce("end_us", "__top").cast("double"))
    n = notes.join(s.select(*keys, "start_us", "__end"), keys)
    by_time = (F.col("onset_us") >= F.col("start_us") - early_us) & (
        F.col("onset_us") < F.col("__end") - 100)
    n = n.where(F.when(F.col("measure_idx").isNull(), by_time).otherwise(
        F.col("measure_idx").between(first, last)))
    start = n.groupBy(*keys).agg(F.min("onset_us").alias("__first"))
    off = F.least(F.col("onset_us") + F.col("duration_us"), F.col("__end") + release_us)
    return n.join(start, keys).select(
        *notes.columns, (F.col("onset_us") - F.col("__first") + lead_us).alias("new_onset_us"),
        F.greatest(F.lit(float(least_us)), off - F.col("onset_us")).alias("new_duration_us"))
