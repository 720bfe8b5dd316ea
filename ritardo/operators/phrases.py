"""Markings, boundaries and beat maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.functions import keys as K
from ritardo.operators.ordered import CHUNK, asof, chunk_of, scan, with_halo
from ritardo.session import cut_lineage


def dynamics(
    points: DataFrame, levels: DataFrame, hairpins: DataFrame, keys: Sequence[str], pos: str,
    width: int,
) -> DataFrame:
    """Latest dynamic level (0 before the first) and the highest hairpin ramp at each position."""
    keys = list(keys)
    p = asof(points, levels.select(*keys, F.col("start").alias("__s"), "level"), keys, pos, "__s",
             ["level"], width, right_tie="level").withColumn(
        "level", F.coalesce("level", F.lit(0))).drop("hit___s")
    size = float(width)
    spans = hairpins.where("end > start").selectExpr(
        *[f"`{k}`" for k in keys], "start", "end", f"explode(sequence(cast(floor(start / {size}D)"
        f" as bigint), cast(floor(end / {size}D) as bigint))) as `{CHUNK}`")
    at = p.select(*keys, pos).distinct().withColumn(CHUNK, chunk_of(pos, width))
    rising = at.join(spans, [*keys, CHUNK]).where(F.expr(f"`{pos}` between start and end"))
    ramp = rising.groupBy(*keys, pos).agg(F.max(K.ramp(F.col(pos), F.col("start"), F.col("end"))).alias(
        "ramp"))
    return p.join(ramp, [*keys, pos], "left").withColumns({
        "inside": F.col("ramp").isNotNull(), "ramp": F.coalesce("ramp", F.lit(0.0))})


def greedy_peaks(
    cands: DataFrame, keys: Sequence[str], pos: str, score: str, min_gap: int
) -> DataFrame:
    """Peaks in order of score, each at least ``min_gap`` from every stronger one that was kept.

    In each round a candidate wins when no remaining candidate within the gap is stronger; the
    losers near a winner leave. Rounds go on until nothing is left, so the result is the
    sequential one. Ties go to the earlier position.
    """
    keys = list(keys)
    reach, width = min_gap - 1, max(16 * min_gap, 1)
    rest = cut_lineage(cands.withColumn("__o", F.struct(F.col(score).alias("s"), (-F.col(
        pos)).alias("p"))))
    kept = rest.limit(0)
    w = W.partitionBy(*keys, CHUNK).orderBy(pos).rangeBetween(-reach, reach)
    while not rest.isEmpty():
        h = with_halo(rest, pos, width, reach, reach)
        best = h.withColumn("__win", F.max("__o").over(w) == F.col("__o"))
        # a halo copy at the rim of a chunk sees only part of its neighbours: trust home rows
        won = cut_lineage(best.where("__home and __win").drop("__win", "__home", CHUNK))
        kept = kept.unionByName(won)
        both = rest.withColumn("__w", F.lit(0)).unionByName(won.withColumn("__w", F.lit(1)))
        near = with_halo(both, pos, width, reach, reach).withColumn("__n", F.max("__w").over(w))
        rest = cut_lineage(near.where("__home and __w = 0 and __n = 0").drop(
            "__w", "__n", "__home", CHUNK))
    return kept.drop("__o")


def beat_map(
    points: DataFrame, segments: DataFrame, keys: Sequence[str], pos: str, width: int
) -> DataFrame:
    """Reference beat of a source beat: exact positions take their offset, a beat between two
    positions only if both have the same offset. ``segments`` has a position once."""
    keys = list(keys)
    # the next position lies at its segment, so that points are shuffled once, with their rows
    s = scan(segments.select(*keys, F.col("pos").alias("__p"), F.col("offset").alias("__o0")), keys,
             ["__p"], chunk_of("__p", width), __o1=("lead", "__o0"))
    hit = asof(points, s, keys, pos, "__p", ["__o0", "__o1"], width)
    return hit.withColumn("ref_pos", F.expr(
        f"case when hit___p = `{pos}` or __o0 = __o1 then `{pos}` + __o0 end")).drop(
        "hit___p", "__o0", "__o1")


def accent_excess(
    notes: DataFrame, keys: Sequence[str], pos: str, value: str, marked: str, reach: int,
    width: int,
) -> DataFrame:
    """Loudness of each marked note over the median of unmarked notes within ``reach``."""
    keys = list(keys)
    d = notes.withColumn("__i", F.when(~F.col(marked), F.col(value).cast("double")))
    w = W.partitionBy(*keys, CHUNK).orderBy(pos).rangeBetween(-reach, reach)
    h = with_halo(d, pos, width, reach, reach).withColumn(
        "__m", F.percentile("__i", 0.5).over(w)).where(F.col("__home") & F.col(marked))
    return h.withColumn("excess", F.col(value) - F.col("__m")).drop("__i", "__m", "__home", CHUNK)


def snap_events(
    events: DataFrame, onsets: DataFrame, keys: Sequence[str], pos: str, reach: int, width: int
) -> DataFrame:
    """Snap boundary events to the nearest onset within ``reach`` (the earlier on ties)."""
    keys = list(keys)
    on = onsets.select(*keys, F.col("onset").alias("__on")).distinct()
    lo = asof(events, on, keys, pos, "__on", [], width).withColumnRenamed("hit___on", "__lo")
    hi = asof(lo, on, keys, pos, "__on", [], width, direction="forward", strict=True
              ).withColumnRenamed("hit___on", "__hi")
    near = F.expr(f"case when __hi is null or `{pos}` - __lo <= __hi - `{pos}` then __lo"
                  " else __hi end")
    h = hi.withColumn("__near", near)
    ok = F.abs(F.col("__near") - F.col(pos)) <= reach
    return h.withColumns({
        "snapped_pos": F.when(ok, F.col("__near")).otherwise(F.col(pos)),
        "outcome": F.when(F.col("__near") == F.col(pos), "exact").when(ok, "snapped").otherwise(
            "far")}).drop("__lo", "__hi", "__near")


def split_long_phrases(
    starts: DataFrame, keys: Sequence[str], end: DataFrame, max_len: int, width: int
) -> DataFrame:
    """Cut phrases longer than ``max_len`` evenly into the fewest equal parts."""
    keys = list(keys)
    p = scan(starts, keys, ["start"], chunk_of("start", width), __next=("lead", "start")).join(
        end, keys)
    p = p.withColumn("__len", F.coalesce("__next", "end") - F.col("start")).withColumn(
        "__n", F.greatest(F.lit(1), F.ceil(F.col("__len") / max_len)).cast("int"))
    return p.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).select(
        *keys, (F.col("start") + F.expr("cast(floor(i * __len / __n) as bigint)")).alias("start"))
