"""Catalogue tables: aligned facts, performance and piece manifests, metadata, crosswalks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
"""Hash buckets of the fact table: one directory per bucket instead of one per piece."""


def piece_bucket(piece_id: Column) -> Column:
    return F.pmod(F.hash(piece_id.cast("string")), F.lit(BUCKETS))


def aligned_notes(
    pairs: DataFrame, score: DataFrame, played: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """One row per alignment pair: ``s_*`` and ``p_*`` columns, null on the missing side.

    ``score`` has ``s_id``, ``played`` has ``p_id``; all their other columns are prefixed.
    """
    keys = list(keys)
    s = score.select(*keys, "s_id", *[F.col(c).alias(f"s_{c}") for c in score.columns
                                      if c not in (*keys, "s_id")])
    p = played.select(*keys, "p_id", *[F.col(c).alias(f"p_{c}") for c in played.columns
                                       if c not in (*keys, "p_id")])
    return pairs.join(s, [*keys, "s_id"], "left").join(p, [*keys, "p_id"], "left")


def write_aligned_notes(facts: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write the fact table by piece bucket; several files per bucket, rows sorted by score."""
    (
        facts.withColumn("piece_bucket", piece_bucket(F.col("piece_id")))
        .repartition("piece_bucket", "performance_id")
        .sortWithinPartitions("piece_bucket", "piece_id", *order)
        .write.mode("overwrite").partitionBy("piece_bucket")
        .option("compression", "zstd").parquet(path)
    )


def load_piece_notes(
    spark: SparkSession, path: str, piece_id: str, *, columns: Sequence[str] | None = None,
    labels: Sequence[str] | None = None, bad: DataFrame | None = None,
) -> DataFrame:
    """Aligned notes of one piece; the bucket filter prunes directories.

    A piece that is not in the table raises ``KeyError``; nothing left after the filters is fine.
    """
    one = spark.range(1).select(piece_bucket(F.lit(piece_id)).alias("b")).first()["b"]
    facts = spark.read.parquet(path).where(
        (F.col("piece_bucket") == int(one)) & (F.col("piece_id") == piece_id))
    if facts.isEmpty():
        raise KeyError(piece_id)
    out = select_notes(facts, labels=labels, bad=bad).drop("piece_bucket")
    return out.select(*columns) if columns else out


def select_notes(
    facts: DataFrame, *, labels: Sequence[str] | None = None, bad: DataFrame | None = None
) -> DataFrame:
    """Label filter (pushed to the scan) and anti join of bad performances."""
    if labels:
        facts = facts.where(F.col("label").isin(*labels))
    if bad is not None:
        facts = facts.join(bad.select("performance_id"), "performance_id", "left_anti")
    return facts


def performance_record(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Note counts per label and duration of each performance."""

    def cnt(label: str) -> Column:
        return F.count(F.when(F.col("label") == label, 1)).alias(f"n_{label}")

    played = F.col("label") != "deletion"
    end = F.max(F.when(played, F.col("onset_us") + F.col("duration_us")))
    start = F.min(F.when(played, F.col("onset_us")))
    return facts.groupBy(*keys).agg(
        cnt("match"), cnt("interpolated"), cnt("insertion"), cnt("deletion"),
        F.count(F.when(F.col("label") != "insertion", 1)).alias("n_score_notes"),
        F.count(F.when(played, 1)).alias("n_perf_notes"),
        ((end - start) / 1e6).alias("duration_sec"))


def load_pieces(pieces: DataFrame, performances: DataFrame, bad: DataFrame) -> DataFrame:
    """Piece manifest without the bad performances; pieces left with none vanish."""
    lost = performances.join(bad, "performance_id", "left_semi").groupBy("piece_id").agg(
        F.count("*").alias("__n"))
    n = F.col("n_performances") - F.coalesce("__n", F.lit(0))
    return pieces.join(lost, "piece_id", "left").withColumn("n_performances", n).where(
        "n_performances > 0").drop("__n")


def demote_ambiguous(
    rows: DataFrame, keys: Sequence[str], piece_id: str, fallback: Column
) -> DataFrame:
    """Give the fallback id to canonical ids reached from two different title keys.

    Counted over the whole table, before any filter, so that ids do not depend on the filter.
    """
    n = rows.select(*keys, piece_id).distinct().groupBy(piece_id).agg(F.count("*").alias("__n"))
    clash = (F.col("__n") > 1) & ~F.col(piece_id).contains(":")
    return rows.join(n, piece_id, "left").withColumn(
        piece_id, F.when(clash, fallback).otherwise(F.col(piece_id))).drop("__n")


def select_tier(
    rows: DataFrame, tier: str, *, split: str | None = None, bad: DataFrame | None = None
) -> DataFrame:
    """Metadata of one quality tier (``c`` = all rows), split and bad-row filter."""
    if bad is not None:
        rows = rows.join(bad, "performance_id", "left_anti")
    if tier != "c":
        rows = rows.where(F.col(f"tier_{tier}"))
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows


def piece_counts(meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per piece: all, tiers, sensor rows, distinct performers and scores in tier a."""

    def n(c: Column) -> Column:
        return F.count(F.when(c, 1))

    a = F.col("tier_a")
    return meta.groupBy(*keys).agg(
        F.count("*").alias("n_c"), n(F.col("tier_b")).alias("n_b"), n(a).alias("n_a"),
        n(F.col("tier_a_star")).alias("n_a_star"), n(a & F.col("sensor")).alias("n_a_sensor"),
        F.countDistinct(F.when(a, F.col("performer_id"))).alias("n_a_performers"),
        F.countDistinct(F.when(a, F.col("score_id"))).alias("n_scores_a"))


def datasets_by_piece(crosswalk: DataFrame) -> DataFrame:
    """Canonical piece -> sorted distinct data sets (a data set list is bounded)."""
    return crosswalk.where("canonical").groupBy("piece_id").agg(
        F.array_sort(F.collect_set("dataset")).alias("datasets"))


def corpus_counters(pairs: DataFrame, score: DataFrame, played: DataFrame) -> DataFrame:
    """Corpus-level counters of an alignment set in one row."""

    def n(c: Column, name: str) -> Column:
        return F.count(F.when(c, 1)).alias(name)

    s = score.select("performance_id", "s_id").distinct()
    p = played.select("performance_id", "p_id").distinct()
    j = pairs.join(s.withColumn("__s", F.lit(1)), ["performance_id", "s_id"], "left").join(
        p.withColumn("__p", F.lit(1)), ["performance_id", "p_id"], "left")
    main = j.agg(
        F.countDistinct("performance_id").alias("n_performances"),
        n(F.col("label") == "match", "n_match"), n(F.col("label") == "insertion", "n_insertion"),
        n(F.col("label") == "deletion", "n_deletion"),
        n(F.col("s_id").isNotNull() & F.col("__s").isNull(), "n_unknown_score_ids"),
        n(F.col("p_id").isNotNull() & F.col("__p").isNull(), "n_unknown_performance_ids"))
    us = s.join(pairs, ["performance_id", "s_id"], "left_anti").agg(
        F.count("*").alias("n_unreferenced_score"))
    up = p.join(pairs, ["performance_id", "p_id"], "left_anti").agg(
        F.count("*").alias("n_unreferenced_played"))
    return main.crossJoin(F.broadcast(us)).crossJoin(F.broadcast(up))


def training_items(
    notes: DataFrame, keys: Sequence[str], fields: Sequence[str], order: Sequence[str],
    part: Column, min_notes: int = 16,
) -> DataFrame:
    """Parallel arrays of matched notes per performance, cut into ordered parts.

    ``part`` (for example 30 s of playing) bounds the arrays whatever the length of a recording;
    performances with fewer than ``min_notes`` notes are skipped.
    """
    keys = list(keys)
    n = notes.groupBy(*keys).agg(F.count("*").alias("n_notes")).where(
        F.col("n_notes") >= min_notes)
    g = notes.join(n, keys).groupBy(*keys, "n_notes", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(*order, *fields))).alias("a"))
    return g.select(*keys, "n_notes", "part", *[F.col(f"a.{c}").alias(c) for c in fields])


def label_pairs(labels: DataFrame) -> DataFrame:
    """Alignment from mistake labels: a wrong pitch is a deletion plus an insertion."""
    none = F.lit(None).cast("bigint")

    def row(label: str, s: Column, p: Column) -> Column:
        return F.struct(F.lit(label).alias("pair_label"), s.alias("s_id"), p.alias("p_id"))

    s, p = F.col("s_id"), F.col("p_id")
    both = F.array(row("deletion", s, none), row("insertion", none, p))
    rows = (
        F.when(F.col("label") == "wrong_pitch", both)
        .when(F.col("label") == "missed", F.array(row("deletion", s, none)))
        .when(F.col("label") == "extra", F.array(row("insertion", none, p)))
        .otherwise(F.array(row("match", s, p))))
    keep = [c for c in labels.columns if c not in ("s_id", "p_id", "label")]
    return labels.select(*keep, F.inline(rows))


def file_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths of the files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true").load(path).select("path", "length")


def listing_index(
    listing: DataFrame, path: str, pattern: str, parts: Sequence[str], id_parts: Sequence[str], *,
    lookup: DataFrame | None = None, on: Sequence[str] = (),
) -> DataFrame:
    """A dimension from a file listing: parts of each path, and an id derived from them.

    ``pattern`` has one group per name in ``parts``; paths that do not match go. The id joins the
    given parts with underscores, in lower case. ``lookup`` adds columns (a level, a split) by
    ``on``; paths it does not know keep nulls.
    """
    cells = [F.regexp_extract(path, pattern, i + 1).alias(p) for i, p in enumerate(parts)]
    d = listing.where(F.col(path).rlike(pattern)).select("*", *cells)
    d = d.withColumn("item_id", F.lower(F.concat_ws("_", *id_parts)))
    return d if lookup is None else d.join(lookup, list(on), "left")
