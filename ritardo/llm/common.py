"""Helpers shared by the corpus operators: tables, row keys, stored stages, span digests."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees; a folder of its own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
    own = os.path.join(tempfile.mkdtemp(prefix="spark-"), "shared")
    spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: cuts lineage, survives executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a row by id and whole text: equal rows share one, and all results. 64 bits tell
    different rows apart but for one pair in 2**64."""
    return F.xxhash64(F.col(id_col), F.length(text_col), F.col(text_col))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, all else as it is (``lower`` would also change other scripts)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def joined_spans(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind in the order given, then end; comma-joined.

    ``spans``: array of struct(s, k, e) with ``k`` the index in ``kinds``.
    """
    names = F.array(*[F.lit(k) for k in kinds])
    one = F.transform(F.array_sort(spans), lambda x: F.concat(
        F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    return F.array_join(one, ",")
