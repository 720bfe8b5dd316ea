"""Spans of bars that a partial recording covers: widening, whether it was needed, shrinking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.operators.ordered import chunk_of, scan


def widen_spans(bars: DataFrame, spans: DataFrame, keys: Sequence[str], width: int, *,
                min_bars: int = 2, min_notes: int = 16) -> DataFrame:
    """``spans`` with ``wide_first`` and ``wide_last``.

    ``bars``: keys, row (0, 1, ...), notes. ``spans``: keys, first, last, widen_first, widen_last, one
    row a key. An end that may widen goes out to the nearest row at which at least ``min_bars`` rows
    and ``min_notes`` notes are added, or to the edge. Added notes are differences of one running
    sum, so the nearest row is a conditional extreme, not a walk.
    """
    keys = list(keys)
    s = scan(bars, keys, ["row"], chunk_of("row", width), __upto=("sum", "notes"))
    j = s.join(spans, keys)
    row, first, last = F.col("row"), F.col("first"), F.col("last")
    # notes before the first row of the span, and up to its last row
    ends = j.groupBy(*keys).agg(
        F.max(F.when(row == first, F.col("__upto") - F.col("notes"))).alias("__a"),
        F.max(F.when(row == last, F.col("__upto"))).alias("__z"), F.max("row").alias("__top"))
    j = j.join(ends, keys)
    out_ = (row <= first - min_bars) & (
        F.col("__a") - (F.col("__upto") - F.col("notes")) >= min_notes)
    on_ = (row >= last + min_bars) & (F.col("__upto") - F.col("__z") >= min_notes)
    g = j.groupBy(*keys).agg(F.max(F.when(out_, row)).alias("__f"), F.min(F.when(on_, row)).alias(
        "__l"), F.max("__top").alias("__top"))
    g = spans.join(g, keys, "left")
    return g.withColumn("wide_first", F.when(F.col("widen_first"), F.coalesce(
        "__f", F.lit(0).cast("bigint"))).otherwise(first)).withColumn(
        "wide_last", F.when(F.col("widen_last"), F.coalesce("__l", "__top")).otherwise(last)).drop(
        "__f", "__l", "__top")


def margin_needed(used: DataFrame, unmatched: DataFrame, keys: Sequence[str], note: str, *,
                  min_notes: int = 3, share: float = 0.5) -> DataFrame:
    """keys, used, explained, needed: whether the wider span explains notes that nothing else does.

    ``used``: notes matched in the added rows; ``unmatched``: notes the narrow span leaves over.
    """
    keys = list(keys)
    u = used.select(*keys, note).distinct()
    hit = unmatched.select(*keys, note).distinct().withColumn("__hit", F.lit(1))
    return u.join(hit, [*keys, note], "left").groupBy(*keys).agg(
        F.count("*").alias("used"), F.count("__hit").alias("explained")).withColumn(
        "needed", (F.col("explained") >= min_notes) & (F.col("explained") >= share * F.col("used")))


def shrink_spans(bars: DataFrame, spans: DataFrame, keys: Sequence[str], *, share: float = 0.5
                 ) -> DataFrame:
    """``spans`` with ``tight_first`` and ``tight_last``: rows without notes, or with at least
    ``share`` of them missed, are left out at the ends that may shrink. One row stays.

    ``bars``: keys, row, notes, missed. ``spans``: keys, first, last, shrink_first, shrink_last.
    """
    keys = list(keys)
    gone = (F.col("notes") == 0) | (F.col("missed") >= share * F.col("notes"))
    j = bars.join(spans, keys).where(F.col("row").between(F.col("first"), F.col("last")) & ~gone)
    g = j.groupBy(*keys).agg(F.min("row").alias("__lo"), F.max("row").alias("__hi"))
    g = spans.join(g, keys, "left")
    tight = F.when(F.col("shrink_first"), F.coalesce("__lo", "last")).otherwise(F.col("first"))
    g = g.withColumn("tight_first", tight)
    return g.withColumn("tight_last", F.when(F.col("shrink_last"), F.greatest(F.coalesce(
        "__hi", "tight_first"), F.col("tight_first"))).otherwise(F.col("last"))).drop("__lo", "__hi")
