"""The given tables in their note-event roles, as DataFrames and as the same SQL.

No music ships with the repository, so the operators are exercised on the given tables, whole:

``notes``    events: user = performance, time = onset, ``k`` = pitch, value = loudness
``score``    lineitem: supplier = score, ship day = position, part = pitch
``curves``   embeddings: vector = performance, label = piece, index = beat
``ratings``  events: user = rater, ``k`` = segment, event type = dimension
``takes``    orders: customer = performer, order = performance

Positions are 64-bit integers in micro-units (one quarter, second or beat = 1,000,000), so that
keys join exactly. One day of events is one second of playing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MICRO = 1_000_000
NOTE_CHUNK = 8 * MICRO
"""Chunk width for played notes: 8 s of playing."""
SCORE_CHUNK = 512 * MICRO
"""Chunk width for score positions, in micro-quarters."""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    us = F.expr(
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 86400")
    return e.select(
        F.col("user_id").alias("performance_id"),
        F.col("event_id").alias("note_id"),
        us.alias("onset_us"),
        (F.lit(50000) + F.floor(F.col("value") * 10000)).cast("bigint").alias("duration_us"),
        (F.lit(38) + k % 24).cast("bigint").alias("pitch"),
        (F.floor(F.col("value")) % 127 + 1).cast("bigint").alias("velocity"),
        F.col("value"),
        k.cast("bigint").alias("k"),
        "event_type",
        F.when(F.col("event_type").isin("view", "click"), "match")
        .when(F.col("event_type") == "purchase", "interpolated")
        .when(F.col("event_type") == "error", "deletion")
        .otherwise("insertion")
        .alias("label"),
    )


NOTES_SQL = """notes AS (
  SELECT user_id AS performance_id, event_id AS note_id,
    (epoch_us(ts) - 1704067200000000) // 86400 AS onset_us,
    CAST(50000 + floor(value * 10000) AS BIGINT) AS duration_us,
    CAST(38 + CAST(json_extract_string(props, '$.k') AS INT) % 24 AS BIGINT) AS pitch,
    CAST(CAST(floor(value) AS BIGINT) % 127 + 1 AS BIGINT) AS velocity,
    value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'match'
         WHEN event_type = 'purchase' THEN 'interpolated'
         WHEN event_type = 'error' THEN 'deletion' ELSE 'insertion' END AS label
  FROM events)"""


def score(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    q = F.col("l_quantity").cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("score_id"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast(
                "decimal(18,2)").cast("string")
        ).alias("note_id"),
        (day.cast("bigint") * MICRO).alias("onset_uq"),
        ((q % 8 + 1) * MICRO).cast("bigint").alias("duration_uq"),
        (F.lit(21) + F.col("l_partkey") % 88).cast("bigint").alias("pitch"),
        (F.col("l_linenumber") % 2 + 1).cast("bigint").alias("staff"),
        F.col("l_returnflag").alias("voice"),
        F.col("l_linestatus").alias("status"),
        q.alias("quantity"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.floor(day / 28).cast("bigint").alias("measure_idx"),
    )


SCORE_SQL = """score AS (
  SELECT l_suppkey AS score_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey,
              CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS note_id,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000000
      AS onset_uq,
    (CAST(l_quantity AS BIGINT) % 8 + 1) * 1000000 AS duration_uq,
    CAST(21 + l_partkey % 88 AS BIGINT) AS pitch,
    CAST(l_linenumber % 2 + 1 AS BIGINT) AS staff, l_returnflag AS voice,
    l_linestatus AS status, CAST(l_quantity AS BIGINT) AS quantity, l_orderkey AS order_id,
    l_extendedprice AS price, l_discount AS discount,
    CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 28.0) AS BIGINT)
      AS measure_idx
  FROM lineitem)"""


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per 28 quarters that the score has a note in."""
    return (
        score(spark, sf)
        .select("score_id", "measure_idx")
        .distinct()
        .select(
            "score_id",
            "measure_idx",
            (F.col("measure_idx") * 28 * MICRO).alias("start_uq"),
            ((F.col("measure_idx") * 28 + 27) * MICRO).alias("end_uq"),
        )
    )


BARS_SQL = """bars AS (
  SELECT DISTINCT score_id, measure_idx, measure_idx * 28000000 AS start_uq,
    (measure_idx * 28 + 27) * 1000000 AS end_uq FROM score)"""


def curves(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("bigint").alias("piece_id"),
        F.col("vec_id").alias("performance_id"),
        F.when(F.element_at("embedding", 1) >= 0, "sensor").otherwise("transcribed").alias(
            "provenance"),
        F.posexplode("embedding").alias("beat", "x"),
    ).select(
        "piece_id",
        "performance_id",
        "provenance",
        F.col("beat").cast("bigint").alias("beat"),
        F.col("x").cast("double").alias("x"),
    )


CURVES_SQL = """curves AS (
  SELECT CAST(label AS BIGINT) AS piece_id, vec_id AS performance_id,
    CASE WHEN embedding[1] >= 0 THEN 'sensor' ELSE 'transcribed' END AS provenance,
    CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS beat,
    CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return notes(spark, sf).select(
        F.col("performance_id").alias("rater_id"),
        F.col("k").alias("segment_id"),
        F.col("event_type").alias("dimension"),
        "value",
    )


RATINGS_SQL = """ratings AS (
  SELECT performance_id AS rater_id, k AS segment_id, event_type AS dimension, value
  FROM notes)"""


def takes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("performance_id"),
        F.col("o_custkey").alias("performer_id"),
        F.col("o_orderstatus").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("tier"),
        F.col("o_totalprice").alias("price"),
        F.year("o_orderdate").cast("bigint").alias("year"),
    )


TAKES_SQL = """takes AS (
  SELECT o_orderkey AS performance_id, o_custkey AS performer_id, o_orderstatus AS status,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS tier, o_totalprice AS price,
    CAST(year(o_orderdate) AS BIGINT) AS year
  FROM orders)"""

PARTS = {
    "notes": [NOTES_SQL],
    "score": [SCORE_SQL],
    "bars": [SCORE_SQL, BARS_SQL],
    "curves": [CURVES_SQL],
    "ratings": [NOTES_SQL, RATINGS_SQL],
    "takes": [TAKES_SQL],
}


def sql(uses: str, body: str) -> str:
    """``WITH`` the named stand-ins, then ``body`` (which may open with more CTEs: ``, x AS``)."""
    parts: list[str] = []
    for u in uses.split():
        for p in PARTS[u]:
            if p not in parts:
                parts.append(p)
    return "WITH " + ",\n".join(parts) + "\n" + body
