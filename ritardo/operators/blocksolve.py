"""Banded systems of many sizes, one for each key, solved by Spark in blocks.

A symmetric system of bandwidth 3 is a chain of nodes of three unknowns, each coupled to the next.
Every ``SPAN``-th node is kept and those between are eliminated, all spans of all keys at once;
what remains is a chain of the same kind, ``SPAN`` times shorter. When one node is left it is
solved, and the spans are filled in again on the way back. No task sees more than whole spans,
so one key may have any length. The blocks of the inverse beside the diagonal, which degrees of
freedom need, come along: they are a span's own inverse plus what its ends add.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.session import cut_lineage

NODE = 3  # unknowns of a node: the bandwidth
SPAN = 128  # nodes of a span
TOGETHER = 256  # spans that are held as arrays at a time
D9, E9, R3 = ([f"{c}{i}" for i in range(n)] for c, n in (("d", 9), ("e", 9), ("r", 3)))


def _forward(d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Pivot blocks of the chain (spans, nodes, 3, 3), one node after the other."""
    p = d.copy()
    for k in range(1, d.shape[1]):
        p[:, k] -= np.swapaxes(e[:, k - 1], 1, 2) @ np.linalg.solve(p[:, k - 1], e[:, k - 1])
    return p


def _solve(p: np.ndarray, e: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions for the right-hand columns ``b`` (spans, nodes, 3, columns)."""
    y = b.copy()
    n = b.shape[1]
    for k in range(1, n):
        y[:, k] -= np.swapaxes(e[:, k - 1], 1, 2) @ np.linalg.solve(p[:, k - 1], y[:, k - 1])
    x = np.empty_like(y)
    x[:, n - 1] = np.linalg.solve(p[:, n - 1], y[:, n - 1])
    for k in range(n - 2, -1, -1):
        x[:, k] = np.linalg.solve(p[:, k], y[:, k] - e[:, k] @ x[:, k + 1])
    return x


def _ends(d: np.ndarray, e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivots of the inner nodes and their solutions for [left end | right end | right-hand side]."""
    n, m = d.shape[:2]
    b = np.zeros((n, m - 1, 3, 7))
    b[:, 0, :, :3] = np.swapaxes(e[:, 0], 1, 2)
    b[:, -1, :, 3:6] = e[:, m - 1]
    b[..., 6] = r[:, 1:]
    p = _forward(d[:, 1:], e[:, 1:])
    return p, _solve(p, e[:, 1:], b)


def eliminate(d: np.ndarray, e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is left of each span: own block, coupling to the next span's first node and right-hand
    side, then what is added to that next node's block and right-hand side."""
    own, link, rhs = d[:, 0].copy(), np.zeros_like(e[:, 0]), r[:, 0].copy()
    if d.shape[1] == 1:
        return own, e[:, 0].copy(), rhs, np.zeros_like(own), np.zeros_like(rhs)
    _, x = _ends(d, e, r)
    last = np.swapaxes(e[:, -1], 1, 2)
    own -= e[:, 0] @ x[:, 0, :, :3]
    link -= e[:, 0] @ x[:, 0, :, 3:6]
    rhs -= (e[:, 0] @ x[:, 0, :, 6:])[..., 0]
    return own, link, rhs, -last @ x[:, -1, :, 3:6], -(last @ x[:, -1, :, 6:])[..., 0]


def expand(d: np.ndarray, e: np.ndarray, r: np.ndarray, xl: np.ndarray, xr: np.ndarray,
           ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unknowns of all nodes and the inverse's blocks (k, k) and (k, k + 1), given those of the
    span's ends: ``xl``, ``xr`` and the inverse over both ends, 6 x 6."""
    n, m = d.shape[:2]
    x = np.zeros((n, m, 3))
    v, u = np.zeros((n, m, 3, 3)), np.zeros((n, m, 3, 3))
    x[:, 0], v[:, 0] = xl, ends[:, :3, :3]
    if m == 1:
        u[:, 0] = ends[:, :3, 3:]
        return x, v, u
    p, s = _ends(d, e, r)
    f = -s[..., :6]
    x[:, 1:] = s[..., 6] + np.einsum("nkij,nj->nki", f, np.concatenate([xl, xr], axis=1))
    z = np.zeros((n, m - 1, 3, 3))
    zu = np.zeros_like(z)
    eye = np.broadcast_to(np.eye(3), (n, 3, 3))
    z[:, m - 2] = np.linalg.solve(p[:, m - 2], eye)
    for k in range(m - 3, -1, -1):
        g = np.linalg.solve(p[:, k], e[:, k + 1])
        zu[:, k] = -g @ z[:, k + 1]
        z[:, k] = np.linalg.solve(p[:, k], eye) - zu[:, k] @ np.swapaxes(g, 1, 2)
    fv = f @ ends[:, None]
    v[:, 1:] = z + fv @ np.swapaxes(f, 2, 3)
    u[:, 0] = (ends @ np.swapaxes(f[:, 0], 1, 2))[:, :3]
    u[:, 1:m - 1] = (zu[:, :-1] + fv[:, :-1] @ np.swapaxes(f[:, 1:], 2, 3))
    u[:, m - 1] = fv[:, -1, :, 3:]
    return x, v, u


def _padded(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the spans of a frame, filled up with nodes that stand alone."""
    m = int(pdf["m"].max())
    n = len(pdf)
    d = np.tile(np.eye(3), (n, m, 1, 1))
    e, r = np.zeros((n, m, 3, 3)), np.zeros((n, m, 3))
    for i, (k, a, b, c) in enumerate(zip(pdf["m"], pdf["d"], pdf["e"], pdf["r"], strict=True)):
        d[i, :k] = np.asarray(a).reshape(k, 3, 3)
        e[i, :k] = np.asarray(b).reshape(k, 3, 3)
        r[i, :k] = np.asarray(c).reshape(k, 3)
    return d, e, r


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.sort_values("m", kind="stable")  # short spans are not padded to the longest
        for k in range(0, len(pdf), TOGETHER):
            yield pdf.iloc[k:k + TOGETHER]


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    t = dict(df.dtypes)
    return ", ".join(f"`{k}` {t[k]}" for k in keys)


def _reduced(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The shorter chain as spans again: keys, span, m, d, e, r."""
    cols = [*keys, "node", *D9, *E9, *R3]

    def run(batches):
        for pdf in _pieces(batches):
            d, e, r = _padded(pdf)
            own, link, rhs, more, more_rhs = eliminate(d, e, r)
            n = len(pdf)
            for node, a, b, c in ((0, own, link, rhs), (1, more, np.zeros_like(link), more_rhs)):
                flat = np.concatenate([a.reshape(n, 9), b.reshape(n, 9), c], axis=1)
                out = pd.DataFrame(flat, columns=[*D9, *E9, *R3])
                for k in keys:
                    out[k] = pdf[k].to_numpy()
                out["node"] = pdf["span"].to_numpy() + node
                # past the last span there is no node to add to
                yield out.loc[(pdf["more"].to_numpy() | (node == 0)), cols]

    kinds = _kinds(spans, keys) + ", node bigint, " + ", ".join(
        f"{c} double" for c in (*D9, *E9, *R3))
    nodes = spans.mapInPandas(run, kinds).groupBy(*keys, "node").agg(
        *[F.sum(c).alias(c) for c in (*D9, *E9, *R3)])
    return spans_of(nodes, keys)


def spans_of(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes (keys, node, d0.., e0.., r0..) as rows of at most ``SPAN`` nodes, in order."""
    one = F.struct("node", F.array(*D9).alias("d"), F.array(*E9).alias("e"),
                   F.array(*R3).alias("r"))
    g = nodes.groupBy(*keys, F.expr(f"node div {SPAN}").alias("span")).agg(
        F.array_sort(F.collect_list(one)).alias("a"))

    def flat(c: str) -> Column:
        return F.flatten(F.transform("a", lambda x: x[c])).alias(c)

    top = nodes.groupBy(*keys).agg(F.max(F.expr(f"node div {SPAN}")).alias("__top"))
    return g.join(top, list(keys)).select(
        *keys, "span", F.size("a").alias("m"), flat("d"), flat("e"), flat("r"),
        (F.col("span") < F.col("__top")).alias("more"))


ENDS = "xl array<double>, xr array<double>, ends array<double>"


def _ends_of(x: np.ndarray, v: np.ndarray, u: np.ndarray, xr: np.ndarray, vr: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node: its unknowns, the next one's, and the inverse over both (n, m, 6, 6)."""
    nx = np.concatenate([x[:, 1:], xr[:, None]], axis=1)
    nv = np.concatenate([v[:, 1:], vr[:, None]], axis=1)
    top = np.concatenate([v, u], axis=3)
    low = np.concatenate([np.swapaxes(u, 2, 3), nv], axis=3)
    return x, nx, np.concatenate([top, low], axis=2)


def opened(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """``expand`` of the spans of a frame that has its ends: d, e, x, v, u and the right ends."""
    d, e, r = _padded(pdf)
    xl, xr = np.stack(pdf["xl"].to_numpy()), np.stack(pdf["xr"].to_numpy())
    ends = np.stack(pdf["ends"].to_numpy()).reshape(-1, 6, 6)
    x, v, u = expand(d, e, r, xl, xr, ends)
    return x, v, u, xr, ends[:, 3:, 3:]


def _solved_nodes(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, span (a node's number), xl, xr, ends: what the level below needs of each node."""
    size = SPAN

    def run(batches):
        for pdf in _pieces(batches):
            x, v, u, xr, vr = opened(pdf)
            a, b, c = _ends_of(x, v, u, xr, vr)
            take = np.repeat(np.arange(len(pdf)), pdf["m"])
            at = np.concatenate([np.arange(m) for m in pdf["m"]])
            out = {k: pdf[k].to_numpy()[take] for k in keys}
            out["span"] = pdf["span"].to_numpy()[take] * size + at
            out["xl"], out["xr"] = list(a[take, at]), list(b[take, at])
            out["ends"] = list(c[take, at].reshape(-1, 36))
            yield pd.DataFrame(out)

    return spans.mapInPandas(run, f"{_kinds(spans, keys)}, span bigint, {ENDS}")


def _solved_top(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last level: chains of one node."""

    def run(batches):
        for pdf in _pieces(batches):
            d, _, r = _padded(pdf)
            x = np.linalg.solve(d[:, 0], r[:, 0, :, None])[..., 0]
            ends = np.zeros((len(pdf), 6, 6))
            ends[:, :3, :3] = np.linalg.inv(d[:, 0])
            out = {k: pdf[k].to_numpy() for k in keys}
            out |= {"span": pdf["span"].to_numpy(), "xl": list(x), "xr": list(np.zeros_like(x)),
                    "ends": list(ends.reshape(-1, 36))}
            yield pd.DataFrame(out)

    return spans.mapInPandas(run, f"{_kinds(spans, keys)}, span bigint, {ENDS}")


def span_ends(spans: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``spans`` (keys, span, m, d, e, r, more, ...) with the solution at both ends of each span.

    ``most`` is the number of nodes of the longest chain. Fill a span in with :func:`opened`.
    """
    keys = list(keys)
    levels = [spans]
    while most > 1:
        most = -(-most // SPAN)
        levels.append(cut_lineage(_reduced(levels[-1].select(
            *keys, "span", "m", "d", "e", "r", "more"), keys)))
    ends = _solved_top(levels[-1], keys)
    for level in reversed(levels[1:-1]):
        ends = _solved_nodes(level.join(ends, [*keys, "span"]), keys)
    return spans.join(ends, [*keys, "span"])
