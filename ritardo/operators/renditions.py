"""Seeded transforms of performances: flattened, jittered, rescaled and mistaken renditions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.functions.draws import normal, uniform
from ritardo.operators.ordered import CHUNK, chunk_of, scan, with_halo
from ritardo.operators.resampling import HASH_CHUNKS

MIN_DURATION_US = 20_000
# fixed values: pitch changes of a wrong note
WRONG_DELTAS = (1, -1, 2, -2, 12, -12)


def scaled_renditions(
    notes: DataFrame, keys: Sequence[str], pos: str, time: str, velocity: str,
    factors: Sequence[float],
) -> DataFrame:
    """Copies with deviations from the tempo line and the mean velocity scaled by each factor.

    Factor 0 is score-exact timing at constant velocity, 1 the performance itself.
    """
    line = notes.groupBy(*keys).agg(
        F.regr_slope(time, pos).alias("__b"), F.regr_intercept(time, pos).alias("__a"),
        F.avg(velocity).alias("__v"))
    d = notes.join(line, list(keys)).withColumn("factor", F.explode(F.array(*[
        F.lit(float(f)) for f in factors])))
    return d.withColumns({
        time: F.expr(f"__a + __b * `{pos}` + factor * (`{time}` - __a - __b * `{pos}`)"),
        velocity: F.expr(f"least(greatest(round(__v + factor * (`{velocity}` - __v)), 1), 127)"),
    }).drop("__a", "__b", "__v")


def deadpan(
    notes: DataFrame, keys: Sequence[str], sec_per_quarter: float, velocity: int,
    legato: float = 0.95,
) -> DataFrame:
    """Mechanical rendition: score-exact timing, constant velocity, grace notes 1/16 quarter."""
    first = notes.groupBy(*keys).agg(F.min("onset_uq").alias("__q0"))
    dur = F.expr("case when duration_uq > 0 then duration_uq else 62500 end")
    return notes.join(first, list(keys)).withColumns({
        "onset_us": (F.col("onset_uq") - F.col("__q0")) * sec_per_quarter,
        "duration_us": dur * sec_per_quarter * legato, "velocity": F.lit(velocity)}).drop("__q0")


def articulation_scale(
    notes: DataFrame, keys: Sequence[str], factor: float, width: int
) -> DataFrame:
    """Scale durations; a note ends before the next one of its pitch and lasts at least 20 ms."""
    n = scan(notes, [*keys, "pitch"], ["onset_us", "note_id"], chunk_of("onset_us", width),
             __next=("lead", "onset_us"))
    long = F.expr(f"cast(greatest({MIN_DURATION_US}, duration_us * {factor!r}D) as bigint)")
    room = F.greatest(F.lit(MIN_DURATION_US), F.col("__next") - F.col("onset_us"))
    return n.withColumn("duration_us", F.least(long, F.coalesce(room, long))).drop("__next")


def timing_jitter(
    notes: DataFrame, keys: Sequence[str], sd_us: float, width: int, seed: int
) -> DataFrame:
    """Move each distinct onset by hash noise, cut at .45 of the smaller neighbouring gap."""
    on = notes.select(*keys, "onset_us").distinct()
    g = scan(on, keys, ["onset_us"], chunk_of("onset_us", width), __p=("prev", "onset_us"),
             __n=("lead", "onset_us"))
    gap = F.least(F.col("onset_us") - F.col("__p"), F.col("__n") - F.col("onset_us"))
    lim = F.coalesce(gap * 0.45, F.lit(0.0))
    z = normal(seed, *[F.col(k) for k in keys], F.col("onset_us")) * sd_us
    g = g.select(*keys, "onset_us", F.least(F.greatest(z, -lim), lim).alias("shift_us"))
    return notes.join(g, [*keys, "onset_us"]).withColumn(
        "new_onset_us", F.col("onset_us") + F.col("shift_us"))


KERNEL_REACH = 39  # bandwidths beyond which exp(-z*z/2) is zero in double precision


def velocity_components(
    notes: DataFrame, keys: Sequence[str], pos: str, velocity: str, melody: str, bandwidth: int,
    width: int,
) -> DataFrame:
    """Velocity = mean + dynamics D + voicing V from Gaussian local means of melody and
    accompaniment over the whole performance.

    Notes of one position are summed first; a position then meets the positions around it as far
    as the kernel is above zero in double precision, so nothing of the sum is left out.
    """
    keys = list(keys)
    r = bandwidth * KERNEL_REACH
    m, v = F.col(melody), F.col(velocity).cast("double")
    at = notes.groupBy(*keys, pos).agg(
        F.count(F.when(m, 1)).alias("n1"), F.sum(F.when(m, v)).alias("v1"),
        F.count(F.when(~m, 1)).alias("n0"), F.sum(F.when(~m, v)).alias("v0"))
    d = at.na.fill(0.0, ["v1", "v0"]).select(*keys, pos, "n1", "n0", "v1", "v0")
    halo = with_halo(d, pos, width, r, r)
    sums = ["__sm", "__sa", "__vm", "__va"]

    def smooth(p: pd.DataFrame) -> pd.DataFrame:
        home = p[p["__home"].astype(bool)]
        q, x = p[pos].to_numpy(), p[["n1", "n0", "v1", "v0"]].to_numpy(float)
        out = home[[*keys, pos]].copy()
        got = np.zeros((len(home), 4))
        for i in range(0, len(home), 256):  # a bounded part of the kernel at a time
            z = (q[None] - home[pos].to_numpy()[i:i + 256, None]) / float(bandwidth)
            got[i:i + 256] = np.exp(-0.5 * z * z) @ x
        out[sums] = got
        return out

    types = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in [*keys, pos])
    g = halo.groupBy(*keys, CHUNK).applyInPandas(
        smooth, types + "".join(f", {c} double" for c in sums))
    mean = notes.groupBy(*keys).agg(F.avg(velocity).alias("mean"))
    both = "__sm > 1e-3 and __sa > 1e-3"
    g = notes.join(g, [*keys, pos]).join(mean, keys).selectExpr(
        "*", f"case when {both} then __vm / __sm - __va / __sa else 0D end as gap",
        f"case when {both} then __sm / (__sm + __sa) else 0D end as p_melody")
    g = g.withColumn("V", F.expr(
        f"case when `{melody}` then (1 - p_melody) * gap else -p_melody * gap end"))
    g = g.withColumn("D", F.expr(f"`{velocity}` - mean - V"))
    return g.drop("__sm", "__sa", "__vm", "__va")


def rescale_velocity(parts: DataFrame, dynamics: float = 1.0, voicing: float = 1.0) -> DataFrame:
    """Rebuild velocities with D or V scaled, rounded and clipped to 1 .. 127."""
    v = F.expr(f"mean + {dynamics!r}D * D + {voicing!r}D * V")
    return parts.withColumn("new_velocity", F.least(F.greatest(F.round(v), F.lit(1.0)), F.lit(
        127.0)).cast("bigint"))


def inject_mistakes(
    notes: DataFrame, keys: Sequence[str], rate: float, seed: int, *,
    mix: Sequence[float] = (1.0, 1.0, 1.0), weight: str | None = None,
) -> DataFrame:
    """Label ``round(rate * n)`` notes per performance as mistakes, split over wrong pitch,
    missed and extra by largest remainder.

    Notes are taken in the order of ``-ln(u) / weight``: a weighted sample without replacement.
    Wrong pitches get a drawn semitone change in ``delta``; an extra note copies its source.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1.0)
    u = F.greatest(uniform(seed, F.col("note_id")), F.lit(1e-12))
    d = notes.withColumns({"__e": -F.ln(u) / w, "__one": F.lit(1).cast("bigint")})
    # exponential keys: 1 - exp(-e) spreads them evenly over the chunks
    chunk = F.floor((1 - F.exp(-F.col("__e"))) * HASH_CHUNKS).cast("bigint")
    d = scan(d, keys, ["__e", "note_id"], chunk, __r=("sum", "__one"))
    n = notes.groupBy(*keys).agg(F.round(F.count("*") * rate).cast("bigint").alias("__k"))
    s = sum(mix)
    raw = [f"__k * {m / s!r}D" for m in mix]
    n = n.selectExpr(
        *[f"`{k}`" for k in keys], "__k",
        "array_sort(array(" + ", ".join(
            f"struct(-({r} - floor({r})) as f, {i} as i)" for i, r in enumerate(raw)) + ")) as __f",
        "array(" + ", ".join(f"cast(floor({r}) as bigint)" for r in raw) + ") as __b")
    n = n.selectExpr(
        *[f"`{k}`" for k in keys], "__k",
        "transform(__b, (b, i) -> b + case when exists(slice(__f, 1, cast(__k - aggregate(__b, 0L,"
        " (a, x) -> a + x) as int)), x -> x.i = i) then 1 else 0 end) as __c")
    j = d.join(n, keys)
    kind = F.expr(
        "case when __r <= __c[0] then 'wrong_pitch' when __r <= __c[0] + __c[1] then 'missed'"
        " when __r <= __c[0] + __c[1] + __c[2] then 'extra' else 'correct' end")
    pick = F.floor(uniform(seed + 1, F.col("note_id")) * len(WRONG_DELTAS)).cast("int") + 1
    deltas = F.array(*[F.lit(x) for x in WRONG_DELTAS])
    return j.withColumn("mistake", kind).withColumn(
        "delta", F.when(F.col("mistake") == "wrong_pitch", F.element_at(deltas, pick)).otherwise(
            0)).drop("__e", "__one", "__r", "__k", "__c")
