"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ritardo.llm.common import stored


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes (null: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def text_crc32(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null: of no bytes, 0)."""
    return F.crc32(F.coalesce(F.encode(text, "utf-8"), F.lit(b"")))


def byte_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text"
                ) -> DataFrame:
    """Cut the documents, ordered by id, into ``n_shards`` contiguous shards of near-equal bytes.

    Rows are range-partitioned by id; each partition's total is one row, the exclusive prefix sums
    of those totals are the partitions' offsets, and a row goes to the shard that holds the middle
    of its bytes when the whole corpus is cut at ``n_shards`` equal targets. A shard thus differs
    from its target by less than the largest row. Result: id, ``size``, ``text_crc32``, ``shard``,
    ``slot`` (gapless from 0 in a shard, in id order).

    Null ids come first; equal ids follow checksum and size; fully equal rows are split like any
    others, by their place in the input, so a hot id is dealt over many partitions. Null and empty
    texts have the overhead only. An empty table gives no rows; further columns are ignored. Equal
    texts may lie in different shards: with a third of all rows in one group, keeping it whole
    would break the equal sizes.
    """
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), text_size(text_col).alias("size"),
        text_crc32(text_col).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie")), "sizes")
    order = ["doc_id", "text_crc32", "size", "tie"]
    dealt = stored(
        rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # one row per partition: a plain running sum over a few thousand rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({
        "upto": F.sum("size").over(upto), "nth": F.row_number().over(inside).cast("bigint") - 1})
    placed = placed.join(F.broadcast(offsets), "part")
    cut = stored(placed.select(
        "doc_id", "size", "text_crc32", (F.col("n0") + F.col("nth")).alias("place"),
        F.expr(f"((2 * (bytes0 + upto) - size) * {n_shards}) div (2 * total)").cast(
            "int").alias("shard")), "cut")
    first = cut.groupBy("shard").agg(F.min("place").alias("first"))  # n_shards rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
