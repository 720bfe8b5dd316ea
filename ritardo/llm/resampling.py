"""Importance resampling of documents towards a target text: hashed n-gram weights, exact draw."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ritardo.llm.common import stored

#: UTF-8 bytes to lower case, with every ASCII byte that is no letter or digit as a blank.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
              for b in range(256))
BLOCK = 1 << 20  # features that a task holds as numbers at a time
RESTORE = 8  # the keys are written anew once so few of them (one in ...) are still in question
WORTH = 1 << 20  # ... and there were more than this; results do not depend on either


def words_of(text: str | None) -> list[bytes]:
    return [] if not text else text.encode().translate(PLAIN).split()


def hashed(words: list[bytes], runs: int) -> Iterator[np.ndarray]:
    """CRC-32 of every run of 1 to ``runs`` words, joined by a blank, in blocks of bounded size.

    A run's checksum goes on from that of the run without its last word, so no run is spelled out.
    """
    open_: list[int] = []  # checksums of the runs that end at the word before, and of a blank
    out: list[int] = []
    for w in words:
        ends = [crc32(w)]
        ends += [crc32(w, c) for c in open_]
        out += ends
        if runs > 1:
            open_ = [crc32(b" ", c) for c in ends[:runs - 1]]
        if len(out) >= BLOCK:
            yield np.array(out, dtype=np.uint32)
            out = []
    if out:
        yield np.array(out, dtype=np.uint32)


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array of fixed length."""

    def counted(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                for h in hashed(words_of(t.as_py()), runs):
                    total += np.bincount(h % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    parts = texts.select(F.col(text_col)).mapInArrow(counted, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for b, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket at most
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's shares in target and source, floored."""
    k = len(source)
    s_all, t_all = float(source.sum()) + k, float(target.sum()) + k
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel draw of the id, floored; a null id is written as nothing."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int = 2, seed: int = 7, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, tie): weights looked up in the array of gains."""
    k = len(gain)

    def rows(batches):
        for batch in batches:
            cols: list[list[int]] = [[], [], [], []]
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                words, n, total = words_of(t.as_py()), 0, 0
                for h in hashed(words, runs):
                    n += len(h)
                    total += int(gain[h % k].sum())
                weight = total // n if n else 0
                for c, v in zip(cols, (len(words), n, weight, weight + noise(seed, i.as_py())),
                                strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols], batch.column(2)],
                ["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                    F.xxhash64(F.col(text_col)).alias("tie"))
    return d.mapInArrow(rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, "
                              "score bigint, tie bigint")


KEYS = ("k0", "k1", "k2", "k3", "k4")


def with_key(rows: DataFrame) -> DataFrame:
    """Five numbers that order all rows: less a score, no id, id, hash of the text, number of the row.

    The last, given once and stored, tells equal rows apart, so that no two keys are equal.
    """
    return rows.select(
        "*", (-F.col("score")).alias("k0"), F.col("doc_id").isNull().cast("bigint").alias("k1"),
        F.coalesce("doc_id", F.lit(0)).alias("k2"), F.col("tie").alias("k3"),
        F.monotonically_increasing_id().alias("k4"))


def _before(a: np.ndarray, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a key matrix come before ``key``, and which are equal to it."""
    less, same = np.zeros(len(a), bool), np.ones(len(a), bool)
    for c, v in enumerate(key):
        less |= same & (a[:, c] < v)
        same &= a[:, c] == v
    return less, same


def _median(a: np.ndarray) -> tuple[int, ...] | None:
    """The lower median row of a key matrix: column by column among those that are still equal."""
    if not len(a):
        return None
    at = (len(a) - 1) // 2
    out = []
    for c in range(a.shape[1]):
        v = np.partition(a[:, c], at)[at]
        out.append(int(v))
        at -= int((a[:, c] < v).sum())
        a = a[a[:, c] == v]
    return tuple(out)


def _weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    medians.sort()
    half, upto = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        upto += n
        if upto >= half:
            return key
    raise ValueError("no medians")


def _split(keys: DataFrame, low: tuple | None, high: tuple | None,
           pivot: tuple | None) -> list[tuple[int, int, tuple | None, int, tuple | None]]:
    """Of each partition: how many keys between ``low`` and ``high`` (both left out) come before the
    pivot, at it and after it, with the medians of those before and after. One row a partition."""

    def part(batches):
        held = []
        for batch in batches:
            a = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            if low is not None:
                less, same = _before(a, low)
                a = a[~less & ~same]
            if high is not None:
                a = a[_before(a, high)[0]]
            held.append(a)
        a = np.concatenate(held) if held else np.zeros((0, 5), np.int64)
        if not len(a):
            return
        if pivot is None:
            lo, same, hi = a, 0, a[:0]
        else:
            less, eq = _before(a, pivot)
            lo, same, hi = a[less], int(eq.sum()), a[~less & ~eq]
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(lo)]), pa.array([_median(lo)], pa.list_(pa.int64())), pa.array([same]),
             pa.array([len(hi)]), pa.array([_median(hi)], pa.list_(pa.int64()))],
            ["n_lo", "m_lo", "n_eq", "n_hi", "m_hi"])

    out = keys.select(*KEYS).mapInArrow(
        part, "n_lo bigint, m_lo array<bigint>, n_eq bigint, n_hi bigint, m_hi array<bigint>")
    return out.collect()


def cutoff_key(keys: DataFrame, k: int) -> tuple[int, ...] | None:
    """The key of place ``k`` (from 1) in the order of all keys; None if k is 0 or there are fewer.

    Each partition reports the median of its keys that are still in question. At least a quarter of
    them stands on either side of the median of these medians, weighted by how many each speaks
    for, so every round drops a quarter at the least, about half as a rule. Only the medians, one a
    partition, come to the driver. Keys are unique, so the search ends on the very key.
    """
    if k < 1:
        return None
    low = high = pivot = None
    there = None
    while True:
        parts = _split(keys, low, high, pivot)
        n_lo, n_eq, n_hi = (sum(p[f] for p in parts) for f in ("n_lo", "n_eq", "n_hi"))
        if pivot is None:
            there = n_lo
            if k > n_lo:
                return None
            side, left = "lo", n_lo
        elif k <= n_lo:
            high, side, left = pivot, "lo", n_lo
        elif k <= n_lo + n_eq:
            return pivot
        else:
            low, side, left, k = pivot, "hi", n_hi, k - n_lo - n_eq
        pivot = _weighted_median([(tuple(p[f"m_{side}"]), p[f"n_{side}"]) for p in parts
                                  if p[f"n_{side}"]])
        if there > WORTH and left * RESTORE < there:
            keys, there = stored(_between(keys.select(*KEYS), low, high), "keys"), left


def _after(key: tuple[int, ...]):
    """Column: the row's key comes after ``key``."""
    c, same = F.lit(False), F.lit(True)
    for name, v in zip(KEYS, key, strict=True):
        c, same = c | (same & (F.col(name) > F.lit(v))), same & (F.col(name) == F.lit(v))
    return c


def _between(keys: DataFrame, low: tuple | None, high: tuple | None) -> DataFrame:
    if low is not None:
        keys = keys.where(_after(low))
    if high is not None:
        at = F.lit(True)
        for name, v in zip(KEYS, high, strict=True):
            at = at & (F.col(name) == F.lit(v))
        keys = keys.where(~_after(high) & ~at)
    return keys


def ranked(winners: DataFrame) -> DataFrame:
    """``rank`` 1, 2, ... in order of the keys: sorted in ranges, numbered within, then shifted."""
    spread = winners.repartitionByRange(*KEYS)
    parts = stored(spread.withColumn("range", F.spark_partition_id()), "winners")
    n = parts.groupBy("range").count().select("range", (F.sum("count").over(
        Window.orderBy("range")) - F.col("count")).alias("shift"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("range").orderBy(*KEYS))
    return parts.join(F.broadcast(n), "range").withColumn(
        "rank", (own + F.col("shift")).cast("bigint"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20,
             runs: int = 2, buckets: int = 10000, seed: int = 7, id_col: str = "doc_id",
             text_col: str = "text", target_text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents of ``min_words`` words or more, likelier ones first.

    Weights are the floored mean of bucket gains, from counts over all documents and all target
    texts; Gumbel noise by hash of the id turns the order of scores into draws without replacement.
    Returns (doc_id, n_words, n_features, weight, score, rank), one row for each input row, with
    null ``rank`` where it was not drawn.

    Null and empty texts have no words, weight 0, and are never drawn (min_words > 0). A null id
    takes part, after all others of its score. Repeated rows are rows of their own: all of them
    count in the corpus, and get neighbouring ranks until the draw is full. Rows of one id and
    score with different texts go by a hash of the text. Empty tables give an empty result or, for
    the target, the gains of no evidence. Extra columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, runs, buckets),
                 bucket_counts(target, target_text, runs, buckets))
    rows = stored(with_key(scored(docs, gain, runs, seed, id_col, text_col)), "scored")
    able = F.col("n_words") >= min_words
    n = rows.where(able).count()
    cut = cutoff_key(rows.where(able), percent * n // 100)
    shown = ("doc_id", "n_words", "n_features", "weight", "score")
    none = F.lit(None).cast("bigint").alias("rank")
    if cut is None:
        return rows.select(*shown, none)
    drawn = able & ~_after(cut)
    return rows.where(~drawn).select(*shown, none).unionByName(
        ranked(rows.where(drawn)).select(*shown, "rank"))
