"""Mapping one score's positions onto another's: offset votes and the best path through offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ritardo.operators.ordered import chunk_of, scan
from ritardo.session import cut_lineage

BLOCK = 4096  # positions of one pitch that a task correlates with as many of the other score
SPAN = 64  # chunks of positions whose notes of one pitch are put in order together
FEW = 4096  # pairs of positions that are built rather than correlated
CHUNK = 4096  # source positions of a stretch of the path
GROUP = 128  # stretches that are walked side by side
SMALL = 2048  # notes of both readings of one key that a task maps by itself
PAIRS = 1 << 20  # pairs of notes that it holds at a time
UNIT = 1_000_000  # rewards are whole millionths, so that sums do not depend on their order
FAR = -(1 << 60)


def _blocks(notes: DataFrame, keys: Sequence[str], name: str, width: int) -> DataFrame:
    """keys, pitch and, for at most ``BLOCK`` positions in order, these and how often each is there.

    Notes are shuffled once, by stretches of ``SPAN`` chunks; counts, order and blocks follow in place.
    """
    k = [*keys, "pitch"]
    parts = notes.select(*k, "pos", chunk_of("pos", width * SPAN).alias("__c")).repartition(*k, "__c")
    n = parts.groupBy(*k, "__c", "pos").agg(F.count("*").alias("n"))
    i = F.row_number().over(W.partitionBy(*k, "__c").orderBy("pos"))
    g = n.withColumn("__b", F.floor((i - 1) / BLOCK)).groupBy(*k, "__c", "__b").agg(
        F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("a"))
    return g.select(*k, F.col("a.pos").alias(f"p_{name}"), F.col("a.n").alias(f"n_{name}"))


def correlate(ps: np.ndarray, ns: np.ndarray, pr: np.ndarray, nr: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """(difference, votes) over two blocks of counts: a convolution on their common lattice, or sums
    over the few positions where the lattice is wide. Both give whole numbers, the same."""
    step = max(1, int(np.gcd.reduce(np.concatenate([ps - ps[0], pr - pr[0]]))))
    s, r = (ps - ps[0]) // step, (pr - pr[0]) // step
    size = int(s[-1] + r[-1] + 1)
    if size * max(1, size.bit_length()) < 4 * len(s) * len(r):
        a, b = np.zeros(int(s[-1]) + 1), np.zeros(int(r[-1]) + 1)
        a[s[-1] - s], b[r] = ns, nr
        n = 1 << (size - 1).bit_length()
        votes = np.rint(np.fft.irfft(np.fft.rfft(a, n) * np.fft.rfft(b, n), n)[:size]).astype(np.int64)
        at = np.flatnonzero(votes)
        return (at - s[-1]) * step + (pr[0] - ps[0]), votes[at]
    d = np.concatenate([pr - p for p in ps])
    at, inv = np.unique(d, return_inverse=True)
    votes = np.bincount(inv, weights=np.concatenate([nr * n for n in ns]))
    return at, votes.astype(np.int64)


def offset_votes(source: DataFrame, reference: DataFrame, keys: Sequence[str], width: int
                 ) -> DataFrame:
    """How many pairs of notes of one pitch lie each (reference less source) difference apart.

    No pair of notes is built: counts by position are correlated, block by block, and a task gets
    one block of either score. Differences that no pair has give no row.
    """
    keys = list(keys)
    both = _blocks(source, keys, "s", width).join(_blocks(reference, keys, "r", width),
                                                  [*keys, "pitch"])
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["p_s"].map(len).to_numpy() * pdf["p_r"].map(len).to_numpy()
            for i in np.flatnonzero(size > FEW):
                at, n = correlate(*[np.asarray(pdf[c].iloc[i], dtype=np.int64)
                                    for c in ("p_s", "n_s", "p_r", "n_r")])
                yield pdf[keys].iloc[np.full(len(at), i)].assign(offset=at, votes=n)
            few = pdf[size <= FEW].reset_index(drop=True)
            if len(few):
                s, r, row = _meetings(few)
                d = np.concatenate(few["p_r"].to_numpy())[r] - np.concatenate(few["p_s"].to_numpy())[s]
                n = np.concatenate(few["n_r"].to_numpy())[r] * np.concatenate(few["n_s"].to_numpy())[s]
                yield few[keys].iloc[row].assign(offset=d, votes=n)

    parts = both.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys)
                             + ", offset bigint, votes bigint")
    return parts.groupBy(*keys, "offset").agg(F.sum("votes").alias("votes"))


def _meetings(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all pairs of a source and a reference position of one row, and their row."""
    ls, lr = (pdf[c].map(len).to_numpy(np.int64) for c in ("p_s", "p_r"))
    row = np.repeat(np.arange(len(pdf)), ls * lr)
    at = np.arange(len(row)) - np.repeat(np.cumsum(ls * lr) - ls * lr, ls * lr)
    s, r = np.divmod(at, lr[row])
    return s + (np.cumsum(ls) - ls)[row], r + (np.cumsum(lr) - lr)[row], row


def candidates(votes: DataFrame, keys: Sequence[str], most: int = 8) -> DataFrame:
    """The ``most`` offsets with the most votes, numbered from 1;
    the smaller offset on ties."""
    w = W.partitionBy(*keys).orderBy(F.desc("votes"), "offset")
    return votes.withColumn("cand", F.row_number().over(w)).where(F.col("cand") <= most)


def _rewards(source: DataFrame, reference: DataFrame, cands: DataFrame, keys: list[str], most: int,
             width: int) -> DataFrame:
    """keys, pos, r: of each candidate, the share of the position's notes found there less a half, in
    millionths; last the state of no candidate, 0. Candidates that are not there are out of reach."""
    listed = cands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cand", "offset"))).alias(
        "__l")).select(*keys, F.col("__l.offset").alias("offsets"))
    both = _blocks(source, keys, "s", width).join(_blocks(reference, keys, "r", width).drop("n_r"),
                                                  [*keys, "pitch"]).join(listed, keys)
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # only what is found is passed on, not every position for every candidate
        for pdf in batches:
            rows, pos, cand, found = [], [], [], []
            for i, (ps, ns, pr, offs) in enumerate(zip(
                    pdf["p_s"], pdf["n_s"], pdf["p_r"], pdf["offsets"], strict=True)):
                at = ps[None, :] + offs[:, None]
                c, x = np.nonzero(pr[np.minimum(np.searchsorted(pr, at), len(pr) - 1)] == at)
                rows.append(np.full(len(c), i))
                pos.append(ps[x])
                cand.append(c + 1)
                found.append(ns[x])
            if rows:
                yield pdf[keys].iloc[np.concatenate(rows)].assign(
                    pos=np.concatenate(pos), cand=np.concatenate(cand), found=np.concatenate(found))

    hits = both.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys)
                            + ", pos bigint, cand bigint, found bigint")
    per = source.select(*keys, "pos", F.lit(None).cast("bigint").alias("cand"), F.lit(1).cast(
        "bigint").alias("found")).unionByName(hits).groupBy(*keys, "pos").agg(
        F.coalesce(F.sum(F.when(F.col("cand").isNull(), F.col("found"))), F.lit(0)).alias("n"),
        *[F.coalesce(F.sum(F.when(F.col("cand") == i, F.col("found"))), F.lit(0)).alias(f"h{i}")
          for i in range(1, most + 1)])
    every = per.join(listed.select(*keys, F.size("offsets").alias("__m")), keys, "left")
    states = [F.expr(f"case when __m >= {i} then {UNIT} * h{i} div n - {UNIT // 2} else {FAR}L end").cast(
        "bigint") for i in range(1, most + 1)]
    return every.select(*keys, "pos", F.array(*states, F.lit(0).cast("bigint")).alias("r"))


def _through(rewards: list[np.ndarray], score: np.ndarray, penalty: int, first: np.ndarray,
             keep: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
    """Stretches, longest first, walked side by side: scores (stretch, start, state) at their ends,
    and by position the state that each came from. Staying wins ties; a first position has no change."""
    length = np.array([len(r) for r in rewards])
    r = np.zeros((len(rewards), length[0], score.shape[2]), np.int64)
    for i, one in enumerate(rewards):
        r[i, :len(one)] = one
    r, stay, back = np.maximum(r, FAR >> 2), np.arange(score.shape[2]), []
    for j in range(length[0]):
        n = int((length > j).sum())
        now = score[:n]
        best = now.argmax(axis=2)[..., None]
        jump = np.take_along_axis(now, best, 2) - penalty
        went = jump > now
        if j == 0:
            went[first] = False
        score[:n] = np.where(went, jump, now) + r[:n, j][:, None]
        if keep:
            back.append(np.where(went, best, stay)[:, 0].astype(np.int16))
    return score, back


def best_path(rewards: DataFrame, keys: Sequence[str], states: int, penalty: int, width: int
              ) -> DataFrame:
    """keys, pos, state (from 0): the path of most reward, less ``penalty`` for each change.

    Max-plus steps are associative: each stretch of ``CHUNK`` positions becomes one matrix of scores
    from state to state, the matrices of a key run past a carried vector in order, and stretches are
    then walked again on their own, from their true start. Only the small matrices of a key are
    seen by one task, one after the other. Ties stay, then go to the lower state.
    """
    keys = list(keys)
    i = scan(rewards.withColumn("__one", F.lit(1).cast("bigint")), keys, ["pos"],
             chunk_of("pos", width), __i=("sum", "__one"))
    rows = cut_lineage(i.groupBy(*keys, F.expr(f"(__i - 1) div {CHUNK}").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "r"))).alias("a")).select(
        *keys, "chunk", F.col("a.pos").alias("pos"), F.flatten("a.r").alias("r")))
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", chunk bigint"

    def each(make):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                order = np.argsort(-pdf["r"].map(len).to_numpy(), kind="stable")
                for at in range(0, len(order), GROUP):
                    some = pdf.iloc[order[at:at + GROUP]]
                    r = [np.asarray(x, dtype=np.int64).reshape(-1, states) for x in some["r"]]
                    yield some[[*keys, "chunk"]].assign(**make(some, r, some["chunk"].to_numpy() == 0))
        return run

    def begin(some):
        return np.stack([np.asarray(x, dtype=np.int64) for x in some["start"]])[:, None]

    def matrix(some, r, first):
        start = np.full((len(r), states, states), FAR >> 1, dtype=np.int64)
        start[:, np.arange(states), np.arange(states)] = 0
        start[first] = 0
        return {"m": list(_through(r, start, penalty, first, keep=False)[0].reshape(len(r), -1))}

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, score = None, np.zeros(states, dtype=np.int64)
        for pdf in batches:
            starts = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, score = own, np.zeros(states, dtype=np.int64)
                starts.append(score)
                m = np.asarray(row.m, dtype=np.int64).reshape(states, states)
                score = m[0] if row.chunk == 0 else (score[:, None] + m).max(axis=0)
                score = np.maximum(score - score.max(), FAR >> 1)
            yield pdf[[*keys, "chunk"]].assign(start=starts)

    def traced(some, r, first):
        score, back = _through(r, begin(some), penalty, first)
        came = np.tile(np.arange(states), (len(r), 1))
        for b in back[::-1]:
            came[:len(b)] = np.take_along_axis(b, came[:len(b)], 1)
        return {"came": list(came), "last": score[:, 0].argmax(axis=1)}

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, 0
        for pdf in batches:
            ends = []
            for row in pdf.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, int(row.last)
                ends.append(state)
                state = int(row.came[state])
            yield pdf[[*keys, "chunk"]].assign(end=ends)

    def walked(some, r, first):
        _, back = _through(r, begin(some), penalty, first)
        state, out = some["end"].to_numpy().copy(), np.zeros((len(r), len(back)), np.int64)
        for j in range(len(back) - 1, -1, -1):
            n = len(back[j])
            out[:n, j] = state[:n]
            state[:n] = back[j][np.arange(n), state[:n]]
        return {"pos": list(some["pos"]), "state": [o[:len(x)] for o, x in zip(out, r, strict=True)]}

    k = [*keys, "chunk"]
    m = rows.mapInPandas(each(matrix), f"{head}, m array<bigint>")
    starts = cut_lineage(m.repartition(*keys).sortWithinPartitions(*k).mapInPandas(
        passed, f"{head}, start array<bigint>"))
    begun = rows.join(starts, k)
    t = begun.mapInPandas(each(traced), f"{head}, came array<bigint>, last bigint")
    ends = t.repartition(*keys).sortWithinPartitions(*keys, F.desc("chunk")).mapInPandas(
        chosen, f"{head}, end bigint")
    out = begun.join(ends, k).mapInPandas(
        each(walked), f"{head}, pos array<bigint>, state array<bigint>")
    return out.select(*keys, F.inline(F.arrays_zip("pos", "state")))


def _counted(*cols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns in order, and how often each is there."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.diff(np.append(at, len(order)))


def _ranges(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each item lies in, and its place there, of ranges one after the other."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _mapped(src: list[np.ndarray], ref: list[np.ndarray], rows: int, most: int, penalty: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, position, offset and whether there is one, of some keys' notes (row, pitch, pos)."""
    (row, pitch, pos), n = _counted(*src)
    (r_row, r_pitch, r_pos), r_n = _counted(*ref)
    # notes of one row and pitch
    names, both = np.unique(np.concatenate([pitch, r_pitch]), return_inverse=True)
    tone, r_tone = row * len(names) + both[:len(row)], r_row * len(names) + both[len(row):]
    begin = np.searchsorted(r_tone, tone)
    i, j = _ranges(np.searchsorted(r_tone, tone, "right") - begin)
    j += begin[i]
    d, w = r_pos[j] - pos[i], n[i] * r_n[j]
    order = np.lexsort((d, row[i]))
    v_row, d, w = row[i][order], d[order], w[order]
    first = np.ones(len(d), bool)
    first[1:] = (v_row[1:] != v_row[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    v_row, d, w = v_row[at], d[at], np.add.reduceat(w, at) if len(at) else w
    order = np.lexsort((d, -w, v_row))
    v_row, d = v_row[order], d[order]
    _, rank = _ranges(np.bincount(v_row, minlength=rows))
    offs, has = np.zeros((rows, most), np.int64), np.zeros((rows, most), bool)
    top = rank < most
    offs[v_row[top], rank[top]] = d[top]
    has[v_row[top], rank[top]] = True
    # what each candidate finds at the places of a row
    (p_row, p_pos), _ = _counted(row, pos)
    turn = np.lexsort((pos, row))
    place = np.empty(len(row), np.int64)
    place[turn] = np.cumsum(np.append(0, (row[turn][1:] != row[turn][:-1]) | (pos[turn][1:] != pos[turn][:-1]))
                            ) if len(row) else turn
    total = np.bincount(place, weights=n, minlength=len(p_row)).astype(np.int64)
    known = np.unique(r_pos)
    code = r_tone * len(known) + np.searchsorted(known, r_pos)
    reward = np.zeros((len(p_row), most + 1), np.int64)
    for c in range(most):
        found = np.zeros(len(row), bool)
        if len(code):
            to = pos + offs[row, c]
            near = np.minimum(np.searchsorted(known, to), len(known) - 1)
            own = tone * len(known) + near
            found = (known[near] == to) & (code[np.minimum(np.searchsorted(code, own), len(code) - 1)] == own)
        h = np.bincount(place, weights=n * found, minlength=len(p_row)).astype(np.int64)
        reward[:, c] = np.where(has[p_row, c], UNIT * h // total - UNIT // 2, FAR)
    # the path through each row's places, longest first
    size = np.bincount(p_row, minlength=rows)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    state = np.zeros(len(p_row), np.int64)
    for g in range(0, len(order), GROUP):
        some = order[g:g + GROUP]
        score, back = _through([reward[start[x]:start[x] + size[x]] for x in some], np.zeros(
            (len(some), 1, most + 1), np.int64), penalty, np.ones(len(some), bool))
        now = score[:, 0].argmax(axis=1)
        for k in range(len(back) - 1, -1, -1):
            m = len(back[k])
            state[start[some[:m]] + k] = now[:m]
            now[:m] = back[k][np.arange(m), now[:m]]
    at = np.minimum(state, most - 1)
    there = (state < most) & has[p_row, at]
    return p_row, p_pos, offs[p_row, at], there


def _pairs(row: np.ndarray, side: np.ndarray, pitch: np.ndarray, rows: int) -> np.ndarray:
    """How many pairs of notes of one pitch each row has."""
    names, tone = np.unique(pitch, return_inverse=True)
    code = row * len(names) + tone
    (a, n), (b, m) = (np.unique(code[side == i], return_counts=True) for i in (0, 1))
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return np.bincount(both // max(len(names), 1), weights=n[i] * m[j], minlength=rows)


def _map_small(notes: DataFrame, keys: list[str], most: int, penalty: int) -> DataFrame:
    """The map of keys of few notes (keys, side, pitch, pos): all notes of a key come to one task."""
    kinds = dict(notes.dtypes)
    rows = notes.repartition(*keys).groupBy(*keys).agg(F.collect_list(F.struct("side", "pitch", "pos")).alias("a"))

    def part(b: pa.RecordBatch, cols: list[np.ndarray]) -> pa.RecordBatch:
        row, side, pitch, pos = cols
        src, ref = ([x[side == i] for x in (row, pitch, pos)] for i in (0, 1))
        at, p, o, there = _mapped(src, ref, b.num_rows, most, penalty)
        return pa.RecordBatch.from_arrays([*b.select(keys).take(pa.array(at)).columns, pa.array(p),
                                           pa.array(o, mask=~there)], [*keys, "pos", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = b.column("a").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column("a").flatten()
            side, pitch, pos = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.cumsum(count)
            for at in range(0, len(count), GROUP):
                size = count[at:at + GROUP]
                own = slice(ends[at] - size[0], ends[at + len(size) - 1])
                row = np.repeat(np.arange(len(size)), size)
                upto = np.cumsum(_pairs(row, side[own], pitch[own], len(size)))
                begin = 0
                while begin < len(size):
                    top = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right"))
                    top = max(top, begin + 1)
                    here = (row >= begin) & (row < top)
                    yield part(b.slice(at + begin, top - begin), [row[here] - begin, *[
                        x[own][here] for x in (side, pitch, pos)]])
                    begin = top

    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.mapInArrow(run, f"{head}, pos bigint, offset bigint")


def map_positions(source: DataFrame, reference: DataFrame, keys: Sequence[str], width: int, *,
                  most: int = 8, penalty: int = 3 * UNIT) -> DataFrame:
    """keys, pos, offset: where each source position lies in the reference, null where it does not.

    ``source``, ``reference``: keys, ``pos``, ``pitch``, one row for each note. The commonest offsets
    stand for election; a path picks one or none at every position. Keys of at most ``SMALL`` notes
    are mapped each in a task; notes of larger ones, or with nulls, are dealt by pitch and stretch.
    """
    keys = list(keys)
    cols = [*keys, *[F.col(c).cast("bigint").alias(c) for c in ("pitch", "pos")]]
    every = source.select(*cols, F.lit(0).cast("bigint").alias("side")).unionByName(
        reference.select(*cols, F.lit(1).cast("bigint").alias("side")))
    odd = F.count(F.when(F.col("pitch").isNull() | F.col("pos").isNull(), 1))
    sizes = every.groupBy(*keys).agg(F.count("*").alias("__n"), odd.alias("__odd"))
    large = cut_lineage(sizes.where((F.col("__n") > SMALL) | (F.col("__odd") > 0)).select(*keys))
    if large.isEmpty():
        return _map_small(every, keys, most, penalty)
    few = _map_small(every.join(large, keys, "left_anti"), keys, most, penalty)
    many = _map_large(source.join(large, keys, "left_semi"), reference.join(large, keys, "left_semi"), keys,
                      width, most, penalty)
    return few.unionByName(many)


def _map_large(source: DataFrame, reference: DataFrame, keys: list[str], width: int, most: int,
               penalty: int) -> DataFrame:
    cands = cut_lineage(candidates(offset_votes(source, reference, keys, width), keys, most))
    path = best_path(_rewards(source, reference, cands, keys, most, width), keys, most + 1,
                     penalty, width)
    return path.withColumn("cand", F.col("state") + 1).join(
        cands.select(*keys, "cand", "offset"), [*keys, "cand"], "left").select(*keys, "pos", "offset")
