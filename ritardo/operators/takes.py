"""Repeated takes of one passage: consistent and take-specific parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.operators.consensus import center


def common_keys(df: DataFrame, piece: str, take: str, obs: str) -> DataFrame:
    """Rows whose observation key is present in every take of the piece."""
    k = df.groupBy(piece).agg(F.countDistinct(take).alias("__k"))
    n = df.groupBy(piece, obs).agg(F.countDistinct(take).alias("__n"))
    full = n.join(k, piece).where("__n = __k").select(piece, obs)
    return df.join(full, [piece, obs], "left_semi")


def decompose(df: DataFrame, piece: str, take: str, obs: str, value: str) -> DataFrame:
    """Centre per take; ``consistent`` = mean over takes, ``specific`` = the rest."""
    c = center(common_keys(df, piece, take, obs), [piece, take], value, "y")
    m = c.groupBy(piece, obs).agg(F.avg("y").alias("consistent"))
    return c.join(m, [piece, obs]).withColumn("specific", F.col("y") - F.col("consistent")).select(
        piece, take, obs, "y", "consistent", "specific")


def bar_table(parts: DataFrame, keys: Sequence[str], obs: str) -> DataFrame:
    """Per bar: consistent mean and SD, specific rms over observations and takes (k - 1)."""
    per = parts.groupBy(*keys, obs).agg(
        F.count("*").alias("__k"), F.max("consistent").alias("__c"),
        F.sum(F.col("specific") * F.col("specific")).alias("__ss"))
    n = F.count("*")
    return per.groupBy(*keys).agg(
        n.alias("n"), F.avg("__c").alias("consistent_mean"),
        F.when(n > 1, F.stddev_pop("__c")).alias("consistent_sd"),
        F.sqrt(F.sum("__ss") / (n * (F.max("__k") - 1))).alias("specific_rms"))
