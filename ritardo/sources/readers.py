"""Readers and sinks for the file formats of note-event corpora.

Schemas are given, never inferred. Each reader is a plain Spark scan plus column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIGNMENT_SCHEMA = "xml_id string, midi_id string, track string, channel string, pitch string, " \
    "onset string"


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def read_alignment_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Note alignment file: ``insertion`` / ``deletion`` markers become null sides."""
    a = read_tsv(spark, path, ALIGNMENT_SCHEMA)
    s = F.when(F.col("xml_id") != "insertion", F.col("xml_id"))
    p = F.when(F.col("midi_id") != "deletion", F.col("midi_id"))
    label = F.when(s.isNull(), "insertion").when(p.isNull(), "deletion").otherwise("match")
    return a.select(label.alias("label"), s.alias("s_id"), p.alias("p_id"))


def wide_to_long(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    """One column per recording (or question) -> one row per cell; empty cells go."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def ratings_from_wide(
    df: DataFrame, ids: Sequence[str], questions: Sequence[str], limit: float
) -> DataFrame:
    """Wide ratings to long: drop rows with any value above ``limit``, exact duplicates, blanks
    and zeros."""
    cells = F.array(*[F.col(c).cast("double") for c in questions])
    ok = ~F.exists(cells, lambda v: F.coalesce(v > limit, F.lit(False)))
    d = df.where(ok).dropDuplicates([*ids, *questions])
    d = d.select(*ids, *[F.col(c).cast("double").alias(c) for c in questions])
    return d.unpivot(list(ids), list(questions), "dimension", "value").where(
        F.col("value").isNotNull() & (F.col("value") != 0))


def performer_number(recording: Column) -> Column:
    """Performer id of a recording name ``pid<digits>[letter]-...``."""
    x = F.regexp_extract(recording, r"^pid(\d+)[a-z]?-", 1)
    return F.when(x != "", x.cast("bigint"))


def parse_segment_name(name: Column) -> Column:
    """``<work>_<n>bars_<segment>_<player>.mid`` -> struct of its parts."""
    p = r"^(.+)_(\d+)bars_(\d+)_(\d+)(?:\.midi?)?$"
    part = [F.regexp_extract(name, p, i) for i in range(1, 5)]
    return F.when(name.rlike(p), F.struct(
        part[0].alias("work"), part[1].cast("int").alias("bars"),
        part[2].cast("int").alias("segment"), part[3].cast("int").alias("player")))


def fraction(s: Column) -> Column:
    """``3/8`` or ``2`` as a double; null if it is neither."""
    num, den = F.regexp_extract(s, r"^(-?\d+)/(\d+)$", 1), F.regexp_extract(s, r"^(-?\d+)/(\d+)$", 2)
    return F.when(den != "", num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))).when(
        s.rlike(r"^-?\d+(\.\d+)?$"), s.cast("double"))


def beat_alignment(lines: DataFrame, line: str) -> DataFrame:
    """Text rows ``bar+num/den time`` -> bar, fraction of the bar, seconds; blank rows go."""
    p = r"^(\d+)\+(\d+)/(\d+)\s+(-?\d+(?:\.\d+)?)$"
    g = [F.regexp_extract(F.trim(line), p, i) for i in range(1, 5)]
    return lines.where(F.trim(line).rlike(p)).select(
        *[c for c in lines.columns if c != line], g[0].cast("bigint").alias("bar"),
        (g[1].cast("double") / g[2].cast("double")).alias("beat_frac"),
        g[3].cast("double").alias("time_sec"))


def nested_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON object ``{id: {...}}`` as one row per id (values stay JSON text)."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("id", "entry"))


def vectors_by_id(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """JSON dictionary id -> value vector as a wide table with the given column names."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))
    v = raw.select(F.explode(m).alias("id", "v"))
    return v.select("id", *[F.get("v", i).alias(n) for i, n in enumerate(names)])


def json_report(df: DataFrame, keys: Sequence[str], name: str = "report") -> DataFrame:
    """Every other column as one JSON object per row; NaN and infinities become null."""
    cols = []
    for f in df.schema.fields:
        if f.name in keys:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(~bad, c)
        cols.append(c.alias(f.name))
    return df.select(*keys, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias(name))


def beat_table(
    times: DataFrame, loudness: DataFrame, ids: Sequence[str], recordings: Sequence[str]
) -> DataFrame:
    """Beat times and loudness of recordings, one column each, as one long table.

    Every timed beat stays; loudness is null where its table lacks the beat or the recording. The
    performer's number is read from the recording's name.
    """
    both = [c for c in recordings if c in loudness.columns]
    t = wide_to_long(times, ids, recordings, "recording", "time")
    v = wide_to_long(loudness, ids, both, "recording", "loudness")
    return t.join(v, [*ids, "recording"], "left").withColumn("performer", performer_number(F.col(
        "recording")))
