"""Whitening of embeddings by the singular values of their centred rows: QR in blocks, bidiagonal
form, qd iterations for the values, twisted factorisations for the directions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.llm.common import stored

BLOCK = 2048  # rows that are reduced to a triangle at a time
EPS = float(np.finfo(float).eps)
SCALE, SHIFT = 64, 1_000_000
WIDEST = 2.0**45  # scaled entries beyond this are taken as this, so that all sums stay exact
LONG = (1 << 63) - 1


# ---- one small matrix: bidiagonal form, values, directions ------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w): U' r w is upper bidiagonal with diagonal a >= 0 and b >= 0 above it, w orthogonal.

    Householder reflections from the left clear columns, from the right rows; the left ones are not
    kept, the right ones make ``w``.
    """
    m, d = r.copy(), r.shape[1]
    w = np.eye(d)

    def reflect(x: np.ndarray) -> tuple[np.ndarray, float]:
        v, s = x.copy(), float(np.sqrt(x @ x))
        if s == 0:
            return v, 0.0
        v[0] += s if v[0] >= 0 else -s
        return v, 2.0 / float(v @ v)

    for k in range(d):
        v, f = reflect(m[k:, k])
        m[k:, k:] -= f * np.outer(v, v @ m[k:, k:])
        if k + 2 <= d - 1:
            v, f = reflect(m[k, k + 1:])
            m[k:, k + 1:] -= f * np.outer(m[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= f * np.outer(w[:, k + 1:] @ v, v)
    a, b = np.diag(m).copy(), np.diag(m, 1).copy()
    sign = 1.0  # columns (and rows, not kept) are flipped until no entry is negative
    for k in range(d - 1):
        side = np.sign(a[k]) * sign or 1.0
        turn = np.sign(b[k] * side) or 1.0
        a[k], b[k] = abs(a[k]), abs(b[k])
        w[:, k] *= sign
        sign = turn
    w[:, d - 1] *= sign
    a[d - 1] = abs(a[d - 1])
    return a, b, w


def dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential qd transform with shift: new q and e, and the least of the d's."""
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        nq[i] = d + e[i]
        if nq[i] == 0:
            ne[i], d = 0.0, q[i + 1] - shift
        else:
            t = q[i + 1] / nq[i]
            ne[i], d = e[i] * t, d * t - shift
        least = min(least, d)
        if not least >= 0 and shift > 0:
            return nq, ne, -1.0  # too far: nothing of this transform is used
    nq[n - 1] = d
    return nq, ne, least


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), each to high relative accuracy.

    dqds: shifts from below never make a d negative, so sums and products only; a shift that would
    is drawn back, at last to none. What stands below an entry that has faded splits off.
    """
    out: list[float] = []
    work = [(a * a, b * b, 0.0)]
    while work:
        q, e, base = work.pop()
        guard = 0
        while len(q):
            n = len(q)
            if n == 1:
                out.append(base + q[0])
                break
            faded = e <= EPS * EPS * (base + np.minimum(q[:-1], q[1:]))
            faded |= (e == 0)
            if faded.any():
                cut = int(np.flatnonzero(faded)[-1]) + 1
                work.append((q[:cut], e[:cut - 1], base))
                q, e = q[cut:], e[cut:]
                guard = 0
                continue
            if guard % 4 == 0 and q[0] * 2 < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()  # the same values, the least one last
            # the lower value of the last two rows is no less than the least of all
            x, y, z = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            half = (x - y) / 2
            root = hypot(half, z**0.5)
            low = y - z / (half + root) if half > 0 else (x + y) / 2 - root
            low = max(0.0, min(low, y))
            for shift in (low * (1 - 1e-8), low * (1 - 1e-3), low * 0.5, q.min() * 0.125, 0.0):
                nq, ne, least = dqds_step(q, e, shift)
                if least >= 0:
                    break
            q, e, base = nq, ne, base + shift
            guard += 1
            if guard > 200 + 30 * n:
                raise ArithmeticError("qd iterations do not fade")
    return np.sort(np.array(out))[::-1]


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for ``value`` where B is the bidiagonal (a, b).

    L D L' of B'B is shifted from the top (stationary) and from the bottom (progressive); both are
    joined at the row where what is left is least, and the vector is read off from there.
    """
    n = len(a)
    d = a * a
    tiny = EPS * EPS * max(float(d.max()), 1e-300)
    low = np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)
    s, up = np.empty(n), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        p = d[i] + s[i]
        p = p if abs(p) > tiny else -tiny
        up[i] = low[i] * d[i] / p
        s[i + 1] = up[i] * low[i] * s[i] - value
    p, down = np.empty(n), np.empty(n - 1)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        m = d[i] * low[i] * low[i] + p[i + 1]
        m = m if abs(m) > tiny else -tiny
        t = d[i] / m
        down[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -down[i] * z[i]
        if abs(z[i + 1]) < 1e-300:
            break
    return z / np.sqrt(z @ z)


def directions(r: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the widest eigenvalues of r'r / n, falling, with unit eigenvectors as rows.

    Values that are nothing beside the largest one (its square root times 64 d eps) are left out:
    along them rows do not differ. Vectors of values that lie close together are turned within
    their span by a small eigenproblem, until they are eigenvectors and at right angles.
    """
    d = r.shape[1]
    if d == 0 or not np.abs(r).max() > 0:
        return np.zeros(0), np.zeros((0, d))
    a, b, w = bidiagonal(r)
    # rows and columns that do not touch the rest are solved alone
    cuts = [0, *(np.flatnonzero(b <= EPS * (a[:-1] + a[1:])) + 1).tolist(), d]
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        for v in squared_values(a[lo:hi], b[lo:hi - 1]):
            found.append((float(v), lo, hi))
    found.sort(key=lambda x: -x[0])
    floor = found[0][0] * (64 * d * EPS) ** 2
    found = [x for x in found if x[0] > floor]
    keep = min(most, len(found))
    while keep < len(found) and found[keep][0] > found[keep - 1][0] * (1 - 1e-3):
        keep += 1  # the rest of a close group, to turn it as a whole
    z = np.zeros((keep, d))
    for j, (v, lo, hi) in enumerate(found[:keep]):
        z[j, lo:hi] = twisted_vector(a[lo:hi], b[lo:hi - 1], v)
    j = 0
    while j < keep:
        k = j + 1
        while k < keep and found[k][0] > found[k - 1][0] * (1 - 1e-3):
            k += 1
        if k - j > 1:
            z[j:k] = _turned(z[j:k], z[:j], a, b)
        j = k
    values = np.array([x[0] for x in found[:keep]])
    return values[:most] / n, z[:most] @ w.T


def _times(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of z times B'B."""
    y = z * a
    y[:, :-1] += z[:, 1:] * b
    x = y * a
    x[:, 1:] += y[:, :-1] * b
    return x


def _turned(z: np.ndarray, before: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors in the span of a close group; gaps of the span are filled first."""
    rnd = np.random.default_rng(0)
    base: list[np.ndarray] = []
    mid = float(np.mean([(x * _times(x[None], a, b)[0]).sum() for x in z]))
    for x in z:
        for _ in range(8):
            for _ in range(2):
                for y in [*before, *base]:
                    x = x - (x @ y) * y
            size = float(np.sqrt(x @ x))
            if size > 1e-2:
                break
            x = _solved(rnd.normal(size=len(a)), mid, a, b)  # a start of its own in the same span
        base.append(x / size)
    m = np.array(base)
    _, turn = np.linalg.eigh(m @ _times(m, a, b).T)
    return turn.T[::-1] @ m


def _solved(x: np.ndarray, value: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two steps of inverse iteration near ``value`` from ``x``."""
    t = np.diag(a * a - value)
    t[1:, 1:] += np.diag(b * b)
    t += np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t += np.eye(len(a)) * EPS * float((a * a).max())
    for _ in range(2):
        x = np.linalg.solve(t, x)
        x = x / np.sqrt(x @ x)
    return x


# ---- over Spark ---------------------------------------------------------------------------------


@dataclass
class Model:
    """Of vectors of one length: how many were fitted, their sums, and the directions, as rows."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers: 64 bits, or Python's where that would not hold them."""
        mid = self.sums // self.n
        far = x - mid.astype(np.int64)
        if np.abs(far).max(initial=0) < (1 << 62) // self.n - 1:
            return far * self.n - (self.sums - mid * self.n).astype(np.int64)
        return far.astype(object) * self.n - (self.sums - mid * self.n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.times_n(x) / self.n).astype(float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors.T) / np.sqrt(self.values)


def scaled(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): entries as whole numbers; rows with null, NaN or infinite entries are left out."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & F.forall(
        v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: (F.least(F.greatest(F.floor(F.least(F.greatest(
        c * SCALE, F.lit(-WIDEST)), F.lit(WIDEST))), F.lit(-int(WIDEST))), F.lit(int(WIDEST)))
        + SHIFT).cast("bigint"))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, their vectors), a length at a time, blocks of bounded size."""
    col = batch.column(at)
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy()
    starts = np.concatenate([[0], np.cumsum(ends)[:-1]]).astype(np.int64)
    for d in np.unique(ends):
        every = np.flatnonzero(ends == d)
        for k in range(0, len(every), BLOCK):
            rows = every[k:k + BLOCK]
            yield int(d), rows, flat[starts[rows, None] + np.arange(d)].astype(np.int64)


def _sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Of each vector length: number of distinct vectors and exact sums. One row for each entry."""

    def part(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for d, rows, x in _matrices(batch):
                had = held.setdefault(d, [0, [0] * d])
                had[0] += len(rows)
                had[1] = [a + b for a, b in zip(had[1], x.sum(axis=0).tolist(), strict=True)]
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d + 1)), pa.array(range(-1, d)),
                 pa.array([n, *s], pa.decimal128(38, 0))], ["d", "at", "v"])

    out = fit.select("x").mapInArrow(part, "d bigint, at bigint, v decimal(38,0)")
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for d, at, v in out.groupBy("d", "at").agg(F.sum("v").cast("decimal(38,0)")).collect():
        n, s = sums.get(d, (0, np.zeros(d, dtype=object)))
        if at < 0:
            n = int(v)
        else:
            s[at] = int(v)
        sums[d] = (n, s)
    return sums


def _triangle(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _reduced(fit: DataFrame, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The triangle of the centred rows of each vector length, by blocks, tasks and groups of tasks."""

    def part(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                n, s = sums[d]
                own = Model(n, s, np.zeros(0), np.zeros((0, d)), 0.0)
                if d:
                    held[d] = _triangle(held.get(d), own.centred(x))
        for d, r in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d]), pa.array([TaskContext.get().partitionId()], pa.int32()),
                 pa.array([r.ravel().tolist()])], ["d", "part", "r"])

    def joined(pdf):
        d, r = int(pdf["d"].iloc[0]), None
        for x in pdf.sort_values("part")["r"]:
            r = _triangle(r, np.asarray(x).reshape(-1, d))
        return pdf.iloc[:1].assign(part=int(pdf["part"].min()), r=[r.ravel().tolist()])[
            ["d", "part", "r"]]

    kind = "d bigint, part int, r array<double>"
    tasks = stored(fit.select("x").mapInArrow(part, kind), "triangles")
    groups = max(1, isqrt(tasks.count()))
    some = tasks.groupBy("d", (F.col("part") % groups).alias("g")).applyInPandas(joined, kind)
    last = some.groupBy("d").applyInPandas(joined, kind)
    return {d: np.array(r).reshape(-1, d) for d, _, r in last.collect()}


def fit(x: DataFrame, most: int) -> dict[int, Model]:
    """A model for each vector length, from each distinct vector once.

    To the driver come, for each length, one triangle and one covariance of the result.
    """
    once = stored(x.select("x").distinct(), "distinct")
    sums = _sums(once)
    models = {}
    for d, r in _reduced(once, sums).items():
        n, s = sums[d]
        if len(r) < d:
            r = np.vstack([r, np.zeros((d - len(r), d))])
        values, vectors = directions(r, n, most)
        models[d] = Model(n, s, values, vectors, float((r * r).sum()) / n)
    for d, error in _errors(once, models).items():
        models[d].error = error
    return models


def _errors(once: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the whitened rows' covariance, less the identity, by vector length."""

    def part(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                if d in models and len(models[d].values):
                    y = models[d].project(x)
                    held[d] = held.get(d, 0) + y.T @ y
        for d, m in held.items():
            k = m.size
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * k), pa.array(range(k)), pa.array(m.ravel())], ["d", "at", "v"])

    out = once.select("x").mapInArrow(part, "d bigint, at bigint, v double")
    found: dict[int, float] = {}
    for d, at, v in out.groupBy("d", "at").agg(F.sum("v")).collect():
        k = len(models[d].values)
        found[d] = max(found.get(d, 0.0), abs(v / models[d].n - (at // k == at % k)))
    return found


def whiten(vectors: DataFrame, most: int = 16, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Each row along the widest directions of all distinct rows, in units of their deviation.

    Returns (vec_id, component, n, deviation, whitened, explained, identity_error), a row for each
    input row and component from 1 to ``most``. Entries c become floor(64 c) + 1000000.

    Rows whose vector is null or holds null, NaN or infinite entries are left out; entries beyond
    2**45 are taken as 2**45. Vectors of different lengths are fitted apart, since they share no
    directions. Directions along which the rows do not differ have no variance to divide by: they
    and vectors without entries give no rows; where all vectors are equal there is no row at all.
    Repeated rows are fitted once and all returned; null ids are kept. ``deviation`` is exact, and
    null where it passes a 64-bit number. Empty tables give an empty result. Extra columns are
    ignored.
    """
    x = scaled(vectors, id_col, vec_col)
    models = fit(x, most)

    def rows(batches):
        for batch in batches:
            for d, at, m in _matrices(batch, 1):
                model = models.get(d)
                k = 0 if model is None else len(model.values)
                if not k:
                    continue
                far = model.times_n(m)
                if not np.abs(far).max(initial=0) < (LONG / d) ** 0.5:
                    far = far.astype(object)
                dev = [int(v) if v <= LONG else None for v in (far * far).sum(axis=1)]
                out = {"vec_id": batch.column(0).take(pa.array(np.repeat(at, k))),
                       "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                       "n": pa.array(np.full(len(at) * k, model.n)),
                       "deviation": pa.array([v for v in dev for _ in range(k)], pa.int64()),
                       "whitened": pa.array(model.project(m).ravel()),
                       "explained": pa.array(np.tile(model.values / model.trace, len(at))),
                       "identity_error": pa.array(np.full(len(at) * k, model.error))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = dict(x.dtypes)["vec_id"]
    return x.mapInArrow(rows, f"vec_id {kind}, component int, n bigint, deviation bigint, "
                              "whitened double, explained double, identity_error double")
