"""Repeated material of a score: runs of equal bars by prefix doubling, and how alike they are played."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.session import cut_lineage

SMALL = 512  # bars of one key that a task compares with each other
CELLS = 1 << 21  # bar pairs that are held at a time
BLOCK = 256  # bars whose notes lie together
PAIRS = 1 << 20  # note pairs that are held at a time


def bar_fingerprints(notes: DataFrame, keys: Sequence[str], bar: str, content: Sequence[str],
                     min_notes: int = 4) -> DataFrame:
    """keys, bar, ``fp``: one number for each bar of enough notes, equal where the notes are."""
    g = notes.groupBy(*keys, F.col(bar).alias("bar")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*content))).alias("c"))
    return g.where(F.col("n") >= min_notes).select(*keys, "bar", F.xxhash64("c").alias("fp"))


def _joined(a: DataFrame, b: DataFrame, keys: list[str], by: int) -> DataFrame:
    """Blocks of ``a`` followed, ``by`` bars on, by those of ``b``."""
    nxt = b.select(*keys, (F.col("bar") - by).alias("bar"), F.col("fp").alias("__n"))
    return a.join(nxt, [*keys, "bar"]).select(*keys, "bar", F.xxhash64("fp", "__n").alias("fp"))


def _diagonals(bar: np.ndarray, fp: np.ndarray, there: np.ndarray, min_bars: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, places of both begins and length of the runs of several scores, one to a row of bars."""
    n = bar.shape[1]
    eq = (fp[:, :, None] == fp[:, None, :]) & there[:, :, None] & there[:, None, :]
    eq &= np.arange(n)[:, None] < np.arange(n)
    go = np.zeros(bar.shape, bool)  # the next bar follows
    go[:, :-1] = there[:, 1:] & (bar[:, 1:] == bar[:, :-1] + 1)
    size = np.zeros((len(bar), n + 1, n + 1), np.int16)
    for i in range(n - 1, -1, -1):
        on = go & go[:, i, None]
        size[:, i, :-1] = eq[:, i] * (1 + on * size[:, i + 1, 1:])
    begin = eq.copy()
    begin[:, 1:, 1:] &= ~(eq[:, :-1, :-1] & go[:, :-1, None] & go[:, None, :-1])
    row, a, b = np.nonzero(begin & (size[:, :-1, :-1] >= min_bars))
    length = np.minimum(size[row, a, b], bar[row, b] - bar[row, a])
    keep = length >= min_bars
    return row[keep], a[keep], b[keep], length[keep]


def _short_runs(bars: DataFrame, keys: list[str], min_bars: int) -> DataFrame:
    """The runs of keys of at most ``SMALL`` bars: all bars of a key are compared in its task."""
    a = bars.dropna().repartition(*keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("bar", "fp"))).alias("a"))
    rows = a.select(*keys, F.col("a.bar").alias("bar"), F.col("a.fp").alias("fp"))
    kinds = dict(bars.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.select(keys)
            count = b.column("bar").value_lengths().to_numpy(zero_copy_only=False)
            start = np.cumsum(count) - count
            bar, fp = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                       for c in ("bar", "fp"))
            order, at = np.argsort(-count, kind="stable"), 0
            while at < len(order):
                n = int(count[order[at]])
                some = order[at:at + max(1, CELLS // (n * n))]
                at += len(some)
                there = np.arange(n) < count[some, None]
                place = np.where(there, start[some, None] + np.arange(n), 0)
                row, x, y, length = _diagonals(bar[place], fp[place], there, min_bars)
                k = own.take(pa.array(some[row]))
                place = place[row]
                r = np.arange(len(row))
                yield pa.RecordBatch.from_arrays(
                    [*k.columns, *[pa.array(v.astype(np.int64)) for v in (
                        bar[place[r, x]], bar[place[r, y]], length)]],
                    [*keys, "first", "again", "n_bars"])

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    out = rows.mapInArrow(run, f"{head}, first bigint, again bigint, n_bars bigint")
    return out.select(*keys, *[F.col(c).cast(kinds["bar"]).alias(c) for c in ("first", "again")], "n_bars")


def repeat_runs(bars: DataFrame, keys: Sequence[str], min_bars: int = 1) -> DataFrame:
    """keys, first, again, n_bars: all longest runs of equal bars that do not reach into each other.

    ``bars``: keys, bar, fp. A run (a, b, n) has equal bars a + i and b + i for i < n <= b - a, and
    cannot begin a bar earlier. Keys of up to ``SMALL`` bars are compared each in one task. For larger
    ones, blocks of 1, 2, 4, ... bars get one number each from the two halves
    before; runs begin where blocks of ``min_bars`` are equal and the bars before are not, and grow
    by the largest block that still fits, then smaller ones. Begins are found between groups of
    blocks with different bars before, so a bar that stands a thousand times in a row gives a
    thousand begins, not a million pairs.
    """
    keys = list(keys)
    every = cut_lineage(bars.select(*keys, "bar", "fp"))
    large = every.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SMALL)
    large = cut_lineage(large.select(*keys))
    if large.isEmpty():
        return _short_runs(every, keys, min_bars)
    return _short_runs(every.join(large, keys, "left_anti"), keys, min_bars).unionByName(
        _long_runs(every.join(large, keys, "left_semi"), keys, min_bars))


def _long_runs(bars: DataFrame, keys: list[str], min_bars: int) -> DataFrame:
    """The runs by prefix doubling, of any number of bars."""
    levels = [cut_lineage(bars)]
    # blocks of min_bars from the binary digits of the number
    seed, size, left = None, 0, min_bars
    j = 0
    while left >> j:
        if j == len(levels):
            levels.append(cut_lineage(_joined(levels[-1], levels[-1], keys, 1 << (j - 1))))
        if left >> j & 1:
            seed = levels[j] if seed is None else _joined(levels[j], seed, keys, 1 << j)
            size += 1 << j
        j += 1
    before = levels[0].select(*keys, (F.col("bar") + 1).alias("bar"), F.col("fp").alias("prev"))
    at = cut_lineage(seed.join(before, [*keys, "bar"], "left"))
    kind = at.groupBy(*keys, "fp", "prev").agg(F.count("*").alias("n"))
    one, two = kind.select(*keys, "fp", F.col("prev").alias("pa"), F.col("n").alias("na")), kind.select(
        *keys, "fp", F.col("prev").alias("pb"), F.col("n").alias("nb"))
    # groups with nothing before meet themselves; all others only groups of another bar before
    differ = F.col("pa").isNull() | F.col("pb").isNull() | (F.col("pa") != F.col("pb"))
    met = one.join(two, [*keys, "fp"]).where(differ).select(*keys, "fp", "pa", "pb")
    a = at.select(*keys, "fp", F.col("prev").alias("pa"), F.col("bar").alias("first"))
    b = at.select(*keys, "fp", F.col("prev").alias("pb"), F.col("bar").alias("again"))

    def has(left: DataFrame, right: DataFrame, c: str) -> DataFrame:
        on = F.col("__c").eqNullSafe(F.col(c))
        for k in (*keys, "fp"):
            on = on & (F.col(f"__{k}") == F.col(k))
        r = right.withColumnsRenamed({k: f"__{k}" for k in (*keys, "fp")}).withColumnRenamed(c, "__c")
        return left.join(r, on).drop("__c", *[f"__{k}" for k in (*keys, "fp")])

    runs = has(has(met, a, "pa"), b, "pb").where("first < again and again - first >= " + str(
        min_bars)).select(*keys, "first", "again", F.lit(size).cast("bigint").alias("n_bars"))
    runs = cut_lineage(runs)
    if runs.isEmpty():
        return runs
    # double while some block still has an equal one further on
    while True:
        nxt = cut_lineage(_joined(levels[-1], levels[-1], keys, 1 << (len(levels) - 1)))
        if nxt.groupBy(*keys, "fp").count().where("count > 1").isEmpty():
            break
        levels.append(nxt)
    for j in range(len(levels) - 1, -1, -1):
        ends = [levels[j].select(*keys, F.col("bar").alias(f"__{c}"), F.col("fp").alias(f"__f{c}"))
                for c in ("first", "again")]
        r = runs.withColumn("__first", F.col("first") + F.col("n_bars")).withColumn(
            "__again", F.col("again") + F.col("n_bars"))
        r = r.join(ends[0], [*keys, "__first"], "left").join(ends[1], [*keys, "__again"], "left")
        grows = F.coalesce(F.col("__ffirst") == F.col("__fagain"), F.lit(False))
        runs = r.select(*keys, "first", "again", F.when(grows, F.col("n_bars") + (1 << j)).otherwise(
            F.col("n_bars")).alias("n_bars"))
    return cut_lineage(runs.withColumn("n_bars", F.least("n_bars", F.col("again") - F.col("first"))))


def _met_notes(meet: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, again, n_bars, and of the notes paired in each piece: n, means and centred sums.

    ``meet``: keys, ``runs`` (pieces of runs: first, again, n_bars, and their bars from ``lo`` to ``hi``)
    and both sides' notes in order of bar and content.
    """
    kinds = dict(meet.dtypes)
    sums = ("ma", "mb", "saa", "sbb", "sab", "sdd")

    def measured(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat = b.column("runs").flatten()
        first, again, n_bars, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
        row = np.repeat(np.arange(b.num_rows), b.column("runs").value_lengths().to_numpy(zero_copy_only=False))
        side = []
        for c in ("x", "y"):
            notes, size = b.column(c), b.column(c).value_lengths().fill_null(0)
            size, notes = size.to_numpy(zero_copy_only=False), notes.flatten()
            side.append([np.repeat(np.arange(b.num_rows), size), *[notes.field(i).to_numpy(
                zero_copy_only=False) for i in range(3)]])
        # one number for the place of a bar in its row, and one for a note in its bar
        (rx, bx, cx, vx), (ry, by, cy, vy) = side
        ends = np.concatenate([bx, by, first + lo, again + lo])
        low = int(ends.min()) if len(ends) else 0
        wide = int(ends.max()) - low + int((hi - lo).max(initial=0)) + 2 if len(ends) else 1
        px = rx * wide + bx - low
        names, ids = np.unique(np.concatenate([cx, cy]), return_inverse=True)
        ny = (ry * wide + by - low) * max(len(names), 1) + ids[len(cx):]
        turn = np.argsort(ny, kind="stable")
        ny, vy = ny[turn], vy[turn]
        at = row * wide + first + lo - low
        begin, end = np.searchsorted(px, at), np.searchsorted(px, at + hi - lo)
        size = end - begin
        upto, done = np.cumsum(size), 0
        while done < len(row):
            top = max(done + 1, int(np.searchsorted(upto, upto[done] - size[done] + PAIRS, "right")))
            s = size[done:top]
            run = np.repeat(np.arange(top - done), s)
            note = np.arange(len(run)) - np.repeat(np.cumsum(s) - s, s) + begin[done:top][run]
            to = (px[note] + (again - first)[done:top][run]) * max(len(names), 1) + ids[:len(cx)][note]
            hit = np.searchsorted(ny, to)
            found = np.zeros(len(to), bool)
            if len(ny):
                hit = np.minimum(hit, len(ny) - 1)
                found = ny[hit] == to
            run, u, v = run[found], vx[note[found]], vy[hit[found]]
            n = np.bincount(run, minlength=top - done)
            some = np.maximum(n, 1)

            def total(w, run=run, k=top - done):
                return np.bincount(run, weights=w, minlength=k)

            mu, mv = total(u) / some, total(v) / some
            du, dv = u - mu[run], v - mv[run]
            yield pa.RecordBatch.from_arrays([
                *b.select(keys).take(pa.array(row[done:top])).columns,
                *[pa.array(w[done:top]) for w in (first, again, n_bars)], pa.array(n.astype(np.int64)),
                *[pa.array(w) for w in (mu, mv, total(du * du), total(dv * dv), total(du * dv),
                                        total((v - u) ** 2))]],
                [*keys, "first", "again", "n_bars", "n", *sums])
            done = top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                yield from measured(b.slice(i, 64))

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return meet.mapInArrow(run, f"{head}, first bigint, again bigint, n_bars bigint, n bigint, "
                           + ", ".join(f"{c} double" for c in sums))


def repeat_agreement(runs: DataFrame, notes: DataFrame, keys: Sequence[str], bar: str,
                     content: Sequence[str], value: str) -> DataFrame:
    """How alike the two passes of each run are in ``value``: n, r, ccc, mean_diff, rms_diff.

    Notes of equal ``content`` (distinct in a bar) are paired; null values take no part. ``r`` and
    ``ccc`` need three pairs, and ``r`` some spread on both sides. Notes lie in blocks of ``BLOCK`` bars;
    runs are cut where a block ends, and the pieces of a run meet both blocks in a task.
    """
    keys = list(keys)
    n = notes.dropna(subset=[*keys, bar, *content, value]).groupBy(*keys, bar, *content).agg(
        F.min(value).cast("double").alias("v"))
    blocks = cut_lineage(n.groupBy(*keys, F.expr(f"cast(floor(`{bar}` / {BLOCK}) as bigint)").alias("__x")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(bar).cast("bigint").alias("b"), F.xxhash64(
            *content).alias("c"), "v"))).alias("x")))
    pieces = runs.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in ("first", "again", "n_bars")])

    def block(c: str) -> Column:
        return F.floor(F.expr(c) / BLOCK).cast("bigint")

    inside = (block("first") == block("first + n_bars - 1")) & (block("again") == block("again + n_bars - 1"))
    piece = F.struct("first", "again", "n_bars", "lo", "hi")
    whole = pieces.where(inside & (block("first") == block("again"))).withColumns({
        "lo": F.lit(0).cast("bigint"), "hi": F.col("n_bars"), "__x": block("first")})
    meet = whole.groupBy(*keys, "__x").agg(F.collect_list(piece).alias("runs")).join(
        blocks, [*keys, "__x"], "left").withColumn("y", F.col("x"))
    g = _met_notes(meet.select(*keys, "runs", "x", "y"), keys)
    if blocks.select("__x").distinct().limit(2).count() > 1:
        # runs that reach over the end of a block, or from one block to another
        cut = pieces.where(~(inside & (block("first") == block("again"))))
        cuts = F.expr(f"array_sort(array_distinct(concat(array(0L), "
                      f"transform(sequence(1L, (n_bars div {BLOCK}) + 1), i -> i * {BLOCK} - pmod(first, {BLOCK})), "
                      f"transform(sequence(1L, (n_bars div {BLOCK}) + 1), i -> i * {BLOCK} - pmod(again, {BLOCK})))))")
        cut = cut.withColumn("lo", F.explode(F.filter(cuts, lambda i: i < F.col("n_bars")))).withColumns({
            "hi": F.least("n_bars", F.col("lo") + BLOCK - F.greatest(F.expr(
                f"pmod(first + lo, {BLOCK})"), F.expr(f"pmod(again + lo, {BLOCK})"))),
            "__x": block("first + lo"), "__y": block("again + lo")})
        far = cut.groupBy(*keys, "__x", "__y").agg(F.collect_list(piece).alias("runs")).join(
            blocks, [*keys, "__x"], "left").join(blocks.withColumnsRenamed({"x": "y", "__x": "__y"}),
                                                 [*keys, "__y"], "left")
        parts = _met_notes(far.select(*keys, "runs", "x", "y"), keys).groupBy(
            *keys, "first", "again", "n_bars").agg(F.collect_list(F.struct(
                "n", "ma", "mb", "saa", "sbb", "sab", "sdd")).alias("p"))
        g = g.unionByName(parts.withColumn("__s", F.expr("""aggregate(p, struct(0L as n, 0D as ma, 0D as mb,
            0D as saa, 0D as sbb, 0D as sab, 0D as sdd), (s, p) -> struct(s.n + p.n as n,
            s.ma + (p.ma - s.ma) * p.n / greatest(s.n + p.n, 1) as ma,
            s.mb + (p.mb - s.mb) * p.n / greatest(s.n + p.n, 1) as mb,
            s.saa + p.saa + (p.ma - s.ma) * (p.ma - s.ma) * s.n * p.n / greatest(s.n + p.n, 1) as saa,
            s.sbb + p.sbb + (p.mb - s.mb) * (p.mb - s.mb) * s.n * p.n / greatest(s.n + p.n, 1) as sbb,
            s.sab + p.sab + (p.ma - s.ma) * (p.mb - s.mb) * s.n * p.n / greatest(s.n + p.n, 1) as sab,
            s.sdd + p.sdd as sdd))""")).select(*keys, "first", "again", "n_bars", "__s.*"))
    any_ = F.col("n") > 0
    va, vb, cab = (F.when(any_, F.col(c) / F.col("n")) for c in ("saa", "sbb", "sab"))
    spread = (F.col("n") >= 3) & (va > 1e-24) & (vb > 1e-24)
    den = va + vb + (F.col("ma") - F.col("mb")) ** 2
    return g.select(*keys, "first", "again", "n_bars", "n", F.when(spread, cab / F.sqrt(va * vb)).alias("r"),
                    F.when(F.col("n") >= 3, F.when(den > 0, 2 * cab / den).otherwise(1.0)).alias("ccc"),
                    F.when(any_, F.col("mb") - F.col("ma")).alias("mean_diff"),
                    F.when(any_, F.sqrt(F.col("sdd") / F.col("n"))).alias("rms_diff"))


def repeat_summary(agreement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n_runs, n_pairs, and the mean correlation by Fisher's z with weights n - 3."""
    z = F.atanh(F.least(F.greatest(F.col("r"), F.lit(-0.999999)), F.lit(0.999999)))
    w = F.when(F.col("r").isNotNull() & (F.col("n") > 3), F.col("n") - 3)
    return agreement.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.sum("n").alias("n_pairs"),
        F.tanh(F.sum(w * z) / F.sum(w)).alias("r_mean"),
        F.avg(F.abs("mean_diff")).alias("level_diff"))
