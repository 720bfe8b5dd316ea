"""A training-corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ritardo.llm import decontamination, lang_id, pieces, secrets, simhash
from ritardo.llm.common import row_key, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MODEL = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters, and longer ones that no learned language explains."""
    return lang_id.predict(docs, lang_id.fit(docs)).where("fits").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document of
    the smallest id stays."""
    return simhash.keep_one_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which passages of the benchmark make up a twentieth or more."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key("doc_id", "text")).join(
        bad, "__key", "left_anti").drop("__key")


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; all documents stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids in place of the texts, how many there are, and whether they decode to the text."""
    out = pieces.encode(docs, pieces.load(public_tokenizers.path(MODEL)), keep_text=False)
    return out.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)).cast("bigint"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
    ("secrets", secret_spans), ("encoded", encoded),
]
#: No SQL: language models, XXH64 and piece ids cannot be had there; a test holds it to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a stored table that the next one reads."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
