"""Folds along long runs of rows, in blocks of bounded size that hand a carry on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.operators.ordered import scan
from ritardo.session import cut_lineage

BLOCK = 1024  # rows that one array holds


def blocks_of(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, size: int = BLOCK
) -> DataFrame:
    """keys, ``block`` from 0, ``items``: the rows of a key in order, ``size`` to a block."""
    n = scan(df.withColumn("__one", F.lit(1).cast("bigint")), keys, order, chunk, __n=("sum", "__one"))
    return n.groupBy(*keys, F.floor((F.col("__n") - 1) / size).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("items"))


def carried_fold(
    blocks: DataFrame, keys: Sequence[str], fold: Callable[[Column], Column], empty: Column
) -> DataFrame:
    """Inlined ``out`` of folding each key's blocks in order.

    ``fold(carry)`` gives struct(carry, out) of a block's ``items``. All blocks start from an empty
    carry at once; those whose true carry turns out otherwise are folded again, until none
    changes. Folds forget what lies far behind, so a few rounds do; a run of one block takes none.
    """
    keys = list(keys)
    b = cut_lineage(blocks.select(*keys, "block", "items", empty.alias("__in")))
    cur = b.withColumn("__acc", fold(F.col("__in")))
    if not b.where("block > 0").isEmpty():
        cur = cut_lineage(cur)
        before = W.partitionBy(*keys).orderBy("block")
        own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        at = F.col("block") == F.col("__b")
        for i, k in enumerate(keys):
            at = at & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        while True:
            # only (keys, block, carry) go through the task of a key; the rows stay with their block
            carry = cur.select(*own, F.col("block").alias("__b"), F.coalesce(
                F.lag("__acc.carry").over(before), empty).alias("__new"))
            same = F.col("__new").eqNullSafe(F.col("__in"))
            nxt = cur.join(carry, at).select(*keys, "block", "items", F.col("__new").alias(
                "__in"), same.alias("__same"), F.when(same, F.col("__acc")).otherwise(
                fold(F.col("__new"))).alias("__acc"))
            cur = cut_lineage(nxt)
            if cur.where("not __same").isEmpty():
                break
    return cur.select(*keys, F.inline("__acc.out"))
