"""Target curves against a set of reference curves of the same piece."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.functions.stats import tier
from ritardo.operators.consensus import loo_mean
from ritardo.operators.ordered import scan
from ritardo.operators.quantiles import exact_quantiles, value_bucket

MIN_WINDOW_BEATS = 8
MIN_REFERENCES = 10


def window_quality(
    refs: DataFrame, keys: Sequence[str], performance: str, pos: str, value: str, *,
    miss_pos: float = 0.1, miss_ref: float = 0.1,
) -> DataFrame:
    """Columns observed in enough references, then references observed at enough of those."""
    keys = list(keys)
    seen = F.avg(F.col(value).isNotNull().cast("double"))
    cols = refs.groupBy(*keys, pos).agg(seen.alias("__s")).where(F.col("__s") >= 1 - miss_pos)
    kept = refs.join(cols.select(*keys, pos), [*keys, pos], "left_semi")
    rows = kept.groupBy(*keys, performance).agg(seen.alias("__s")).where(
        F.col("__s") >= 1 - miss_ref)
    nb = cols.groupBy(*keys).agg(F.count("*").alias("n_beats"))
    nr = rows.groupBy(*keys).agg(F.count("*").alias("n_refs"))
    out = refs.select(*keys).distinct().join(nb, keys, "left").join(nr, keys, "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_beats", "n_refs")})
    return out.withColumn(
        "status",
        F.when(F.col("n_beats") < MIN_WINDOW_BEATS, "too_few_beats")
        .when(F.col("n_refs") < MIN_REFERENCES, "too_few_references").otherwise("ok"))


def count_at_or_below(
    targets: DataFrame, refs: DataFrame, keys: Sequence[str], value: str, name: str,
    strict: bool = False,
) -> DataFrame:
    """For each target row the number of reference rows of its group with a value <= (or <) it.

    Both sides are merged in value order and counted with one running sum.
    """
    keys = list(keys)
    cols = [c for c in targets.columns if c not in keys]
    side = 1 if strict else 0
    t = targets.select(*keys, F.col(value).alias("__v"), F.lit(1 - side).alias("__s"),
                       F.lit(0).cast("bigint").alias("__r"), F.struct(*cols).alias("__t"))
    r = refs.groupBy(*keys, F.col(value).alias("__v")).agg(
        F.count("*").alias("__r")).withColumn("__s", F.lit(side))
    u = t.unionByName(r, allowMissingColumns=True)
    u = scan(u, keys, ["__v", "__s"], value_bucket("__v"), __cum=("sum", "__r"))
    # rows of equal value and side: the running sum of targets adds nothing, so order is free
    return u.where(F.col("__t").isNotNull()).select(
        *keys, *[F.col(f"__t.{c}").alias(c) for c in cols], F.col("__cum").alias(name))


def magnitude_flags(
    targets: DataFrame, refs: DataFrame, keys: Sequence[str], performance: str, value: str, *,
    q: float = 0.95,
) -> DataFrame:
    """Size of a window's shaping against the references: percentile, too flat, too extreme."""
    keys = list(keys)
    mag = F.stddev_pop(value).alias("magnitude")
    t = targets.groupBy(*keys, performance).agg(mag)
    r = refs.groupBy(*keys, performance).agg(mag)
    lim = exact_quantiles(r, keys, "magnitude",
                          {"__lo": 1 - q, "magnitude_ref_median": 0.5, "__hi": q}, count="__n")
    c = count_at_or_below(t, r, keys, "magnitude", "__le").join(lim, keys)
    return c.select(
        *keys, performance, "magnitude", "magnitude_ref_median",
        (F.col("__le") / F.col("__n")).alias("magnitude_pct"),
        (F.col("magnitude") < F.col("__lo")).alias("too_flat"),
        (F.col("magnitude") > F.col("__hi")).alias("too_extreme"))


def bar_deviation_tiers(
    targets: DataFrame, refs: DataFrame, piece: str, performance: str, pos: str, bar: str,
    value: str,
) -> DataFrame:
    """Per-bar rms deviation of a target from the reference mean, against the references' own
    leave-one-out deviations: out of band at q95, two tiers, multiple of the notable limit."""
    mean = refs.groupBy(piece, pos).agg(F.avg(value).alias("__m"))
    t = targets.join(mean, [piece, pos]).withColumn("__d", F.col(value) - F.col("__m"))
    dev = F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias("dev_rms")
    tb = t.groupBy(piece, performance, bar).agg(dev)
    r = loo_mean(refs, [piece, pos], value).withColumn("__d", F.col(value) - F.col("loo_mean"))
    rb = r.groupBy(piece, performance, bar).agg(dev)
    lim = exact_quantiles(rb, [piece, bar], "dev_rms", {"q95": 0.95, "q99": 0.99})
    j = tb.join(lim, [piece, bar])
    v = F.col("dev_rms")
    return j.select(piece, performance, bar, v, (v > F.col("q95")).alias("out_of_band"),
                    tier(v, F.col("q95"), F.col("q99")).alias("tier"),
                    (v / F.col("q95")).alias("magnitude"))


def velocity_references(perfs: DataFrame, piece: str, min_sensor: int = 8) -> DataFrame:
    """Sensor references for loudness when there are enough of them, else all."""
    n = perfs.groupBy(piece).agg(
        F.count(F.when(F.col("provenance") == "sensor", 1)).alias("__ns"))
    enough = F.col("__ns") >= min_sensor
    return perfs.join(n, piece).where(~enough | (F.col("provenance") == "sensor")).withColumn(
        "source", F.when(enough, "sensor").otherwise("all")).drop("__ns")


def tempo_band(targets: DataFrame, refs: DataFrame, piece: str, tempo: str) -> DataFrame:
    """Overall tempo against the references: q10, median, q90 and the share that is slower."""
    q = exact_quantiles(refs, [piece], tempo, {"q10": 0.1, "median": 0.5, "q90": 0.9},
                        count="__n")
    c = count_at_or_below(targets, refs, [piece], tempo, "__lt", strict=True).join(q, piece)
    return c.withColumn("share_slower", F.col("__lt") / F.col("__n")).drop("__lt", "__n")
