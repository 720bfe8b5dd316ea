"""Quality gates: reasons why a row must not be used, and edge bars of partial recordings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.quantiles import average_rank, exact_quantiles

# fixed values: raw recordings against their score and against their refined version
NOTE_RATIO_MAX = 1.65
SPAN_RATIO_MAX = 1.3

# fixed values: acceptance of a take
MIN_EVENT_MATCH, MIN_NOTE_MATCH, MAX_INSERT, MAX_GAP_RATIO = 0.90, 0.90, 0.15, 8.0


def raw_guard(
    index: DataFrame, score_notes: DataFrame, mismatch: DataFrame, mislabelled: DataFrame,
    span_pieces: DataFrame, exempt: DataFrame,
) -> DataFrame:
    """One reason per performance ("" = usable): version mismatch, mislabelled row, more notes
    than 1.65 x the score's longest reading, longer than 1.3 x the refined recording."""

    def flag(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    longest = score_notes.where("unfolded_max > 0").select(
        "score_path", F.col("unfolded_max").cast("double").alias("__unf"))
    d = (
        index.join(longest, "score_path", "left")
        .join(flag(mismatch, "piece_id", "__mm"), "piece_id", "left")
        .join(flag(mislabelled, "performance_id", "__ml"), "performance_id", "left")
        .join(flag(span_pieces, "piece_id", "__sp"), "piece_id", "left")
        .join(flag(exempt, "piece_id", "__ex"), "piece_id", "left"))
    den = F.coalesce(F.col("__unf"), F.col("score_note_count").cast("double"))
    notes = F.col("__ex").isNull() & (den > 0) & (
        F.col("note_count") > NOTE_RATIO_MAX * den)
    span = F.col("__sp").isNotNull() & (F.col("refined_duration") > 0) & (
        F.col("duration") > SPAN_RATIO_MAX * F.col("refined_duration"))
    reason = (
        F.when(F.col("__mm"), "score version mismatch").when(F.col("__ml"), "mislabelled row")
        .when(notes, "more notes than the score").when(span, "longer than the refined recording")
        .otherwise(""))
    return d.withColumn("reason", reason).drop("__unf", "__mm", "__ml", "__sp", "__ex")


def guard_jobs(jobs: DataFrame, guarded: DataFrame) -> DataFrame:
    """Drop flagged rows from a drawn sample; ids that are not in the index stay."""
    return jobs.join(guarded.where("reason <> ''").select("performance_id"), "performance_id",
                     "left_anti")


def max_gap_ratio(
    events: DataFrame, keys: Sequence[str], score_pos: str, played: str, width: int
) -> DataFrame:
    """Largest seconds-per-division of consecutive events over the median; null below 3 gaps."""
    keys = list(keys)
    d = scan(events, keys, [score_pos], chunk_of(score_pos, width), __s=("prev", score_pos),
             __p=("prev", played))
    ds, dp = F.col(score_pos) - F.col("__s"), F.col(played) - F.col("__p")
    r = d.where(ds > 0).select(*keys, (dp / ds).alias("rate"))
    q = exact_quantiles(r, keys, "rate", {"med": 0.5, "top": 1.0}, count="n")
    ok = (F.col("n") >= 3) & (F.col("med") > 0)
    return q.select(*keys, F.when(ok, F.col("top") / F.col("med")).alias("max_gap_ratio"))


def take_accepted(event_match: Column, note_match: Column, insert: Column, gap: Column) -> Column:
    return F.coalesce(
        (event_match >= MIN_EVENT_MATCH) & (note_match >= MIN_NOTE_MATCH)
        & (insert <= MAX_INSERT) & (gap <= MAX_GAP_RATIO), F.lit(False))


def edge_bars(
    bars: DataFrame, keys: Sequence[str], k: int, *, start: str = "cut_start",
    end: str = "cut_end",
) -> DataFrame:
    """The first / last ``k`` graded bars on the sides that were not recorded.

    ``bars``: keys, ``measure_idx``, ``n_notes`` and per-row flags of the cut sides. Ranks are
    counted from both ends without ordering a whole score in one task.
    """
    keys = list(keys)
    g = bars.where("n_notes > 0").withColumn("__m", F.col("measure_idx").cast("double"))
    g = average_rank(g, keys, "__m", "__r")
    n = g.groupBy(*keys).agg(F.count("*").alias("__n"))
    g = g.join(n, keys)
    at_start = F.col(start) & (F.col("__r") <= k)
    at_end = F.col(end) & (F.col("__r") > F.col("__n") - k)
    return g.withColumns({"at_start": at_start, "at_end": at_end}).where(
        "at_start or at_end").drop("__m", "__r", "__n")


def edge_outside(
    notes: DataFrame, edges: DataFrame, keys: Sequence[str], *, basis: str = "score",
    tol: float = 0.0,
) -> DataFrame:
    """Score notes of edge bars outside the part of the bar that the recording shows.

    ``notes``: keys, ``measure_idx``, ``pos``, ``matched`` (boolean), for basis ``time`` also
    ``expected`` and ``onset`` (played onset of a matched note). A bar without a matched note is
    outside entirely; ``score_le`` also puts unmatched notes at the boundary position outside.
    """
    k = [*keys, "measure_idx"]
    j = notes.join(edges.select(*k, "at_start", "at_end"), k)
    ref = "onset" if basis == "time" else "pos"
    lim = j.groupBy(*k).agg(
        F.count(F.when(F.col("matched"), 1)).alias("__any"),
        F.min(F.when(F.col("matched"), F.col(ref))).alias("__lo"),
        F.max(F.when(F.col("matched"), F.col(ref))).alias("__hi"))
    j = j.join(lim, k)
    if basis == "time":
        before = F.col("expected") < F.col("__lo") - tol
        after = F.col("expected") > F.col("__hi") + tol
    elif basis == "score_le":
        before = (F.col("pos") <= F.col("__lo")) & ~F.col("matched")
        after = (F.col("pos") >= F.col("__hi")) & ~F.col("matched")
    else:
        before, after = F.col("pos") < F.col("__lo"), F.col("pos") > F.col("__hi")
    out = (
        (F.col("__any") == 0) | F.col("__lo").isNull()
        | (F.col("at_start") & before) | (F.col("at_end") & after))
    return j.where(F.coalesce(out, F.lit(False))).drop("__any", "__lo", "__hi")


def gate_counts(df: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """Rows dropped for each reason (a row counts under every reason) and rows kept."""
    bad = F.lit(False)
    aggs = []
    for name, c in gates.items():
        fails = ~F.coalesce(c, F.lit(False))
        aggs.append(F.count(F.when(fails, 1)).alias(f"dropped_{name}"))
        bad = bad | fails
    return df.agg(*aggs, F.count(F.when(~bad, 1)).alias("kept"), F.count("*").alias("total"))
