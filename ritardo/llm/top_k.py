"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ritardo.llm.common import stored

LEAF = 128  # points of a leaf
FAN = 16  # children of a node
PIVOTS = 64  # cells the candidates are dealt into, at most, per dimension
SAMPLE = 4096  # rows that pivots and first bounds come from; results do not depend on them
PART = 16384  # candidates, and queries, that one task takes at a time


@dataclass
class Node:
    """Points ``lo`` to ``hi`` of the tree's order, all within ``radius`` of ``center``."""

    lo: int
    hi: int
    center: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


def farthest_first(x: np.ndarray, k: int) -> list[int]:
    """Up to ``k`` rows, each the farthest from those before it: a net of the points."""
    first = int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    net, near = [first], ((x - x[first]) ** 2).sum(axis=1)
    while len(net) < k and near.max() > 0:
        net.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[net[-1]]) ** 2).sum(axis=1))
    return net


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    d = (centers ** 2).sum(axis=1)[None, :] - 2 * x @ centers.T
    return d.argmin(axis=1)


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, Node]:
    """Order of the points and the root; children are nets of their parent's points.

    Equal points cannot be told apart by distance and are cut into leaves as they come.
    """
    order = np.arange(len(x))

    def build(lo: int, hi: int, center: np.ndarray) -> Node:
        p = x[order[lo:hi]]
        r = float(np.sqrt(((p - center) ** 2).sum(axis=1).max()))
        node = Node(lo, hi, center, r, float(np.sqrt((center ** 2).sum())))
        if hi - lo <= LEAF:
            return node
        if r == 0:
            step = max(LEAF, -(-(hi - lo) // FAN))
            node.children = [build(a, min(a + step, hi), center) for a in range(lo, hi, step)]
            return node
        net = p[farthest_first(p, FAN)]
        cell = _nearest(p, net)
        order[lo:hi] = order[lo:hi][np.argsort(cell, kind="stable")]
        at = lo
        for c, n in enumerate(np.bincount(cell, minlength=len(net))):
            if n:
                node.children.append(build(at, at + int(n), net[c]))
                at += int(n)
        return node

    return order, build(0, len(x), x.mean(axis=0))


def dual_tree(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, x: np.ndarray, x_id: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (n queries, k), best first, ties to the smaller id; -inf where there are fewer.

    ``floor``: a score known to be reached by k candidates somewhere. A pair of nodes is left out
    when the most its points can score, given centers and covering radii, is below the worst kth
    score of the query node's points. The own id is no candidate.
    """
    qo, qroot = cover_tree(q)
    xo, xroot = cover_tree(x)
    q, q_id, x, x_id = q[qo], q_id[qo], x[xo], x_id[xo]
    best = np.full((len(q), k), -np.inf)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)
    kth = floor[qo].astype(float)

    def most(a: Node, b: Node) -> float:
        top = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + (
            a.radius * b.radius)
        return top + 1e-9 * (abs(top) + a.norm * b.norm) + 1e-6  # rounding

    def leaves(a: Node, b: Node) -> None:
        s = q[a.lo:a.hi] @ x[b.lo:b.hi].T
        s[q_id[a.lo:a.hi, None] == x_id[None, b.lo:b.hi]] = -np.inf
        rows = np.flatnonzero((s >= kth[a.lo:a.hi, None]).any(axis=1) & (s > -np.inf).any(axis=1))
        if not len(rows):
            return
        at = rows + a.lo
        score = np.hstack([best[at], s[rows]])
        name = np.hstack([ids[at], np.broadcast_to(x_id[b.lo:b.hi], (len(rows), b.hi - b.lo))])
        pick = np.lexsort((name, -score), axis=1)[:, :k]
        best[at] = np.take_along_axis(score, pick, 1)
        ids[at] = np.take_along_axis(name, pick, 1)
        kth[at] = np.maximum(kth[at], best[at, -1])

    stack = [(qroot, xroot)]
    while stack:
        a, b = stack.pop()
        if most(a, b) < kth[a.lo:a.hi].min():
            continue
        if not a.children and not b.children:
            leaves(a, b)
        elif a.children and (not b.children or a.radius >= b.radius):
            stack += [(c, b) for c in a.children]
        else:  # the most promising is taken first
            stack += sorted(((a, c) for c in b.children), key=lambda p: most(*p))
    back = np.empty_like(qo)
    back[qo] = np.arange(len(qo))
    return ids[back], best[back]


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v, dim) with v = floor(scale * x). Rows with a null id, a null vector, or a null or
    non-finite component take no part; equal rows are one."""
    x = F.col(vector_col)
    ok = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    d = rows.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    return d.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"),
                    F.size(x).alias("dim"))


def top_k(rows: DataFrame, every: int, k: int, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS,
          sample: int = SAMPLE, part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is
    divisible by ``every``; fewer where there are fewer; ties to the smaller id.

    Candidates lie in cells around pivots, the top of the cover tree; cells larger than ``part``
    are dealt by id, so a vector shared by a third of all rows is no hot group. A query goes to the
    cells that the covering radius does not rule out, given the kth best of its scores in the
    sample. A task then searches one part of candidates and one block of queries tree against tree.

    Vectors meet those of their own length; empty ones score 0. Scores are exact below 2**53. Rows
    that share the query's id are its own and no candidates. Extra columns are ignored; an empty
    table, or one without queries, gives no rows.
    """
    spark = rows.sparkSession
    v = stored(quantised(rows, id_col, vector_col, scale), "vectors")
    some = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # bounded
    by_dim = {int(d): (g["vec_id"].to_numpy(), np.stack(g["v"].to_numpy()) if d else np.zeros(
        (len(g), 0))) for d, g in some.groupby("dim")}
    nets = {d: x[farthest_first(x, pivots)] if d else x[:1] for d, (_, x) in by_dim.items()}
    shared = spark.sparkContext.broadcast((by_dim, nets))

    def matrix(col: pd.Series, dim: int) -> np.ndarray:
        return np.stack(col.to_numpy()) if dim else np.zeros((len(col), 0))

    @F.pandas_udf("cell int, far double")
    def cell_of(vs: pd.Series, dims: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"cell": np.zeros(len(vs), np.int32), "far": np.zeros(len(vs))})
        for dim, ix in dims.groupby(dims.to_numpy()).groups.items():
            net = shared.value[1].get(int(dim))
            if net is None or not dim:  # a length the sample does not have: one cell, never pruned
                out.loc[ix, "far"] = 0.0 if not dim else np.inf
                continue
            x = matrix(vs[ix], dim)
            c = _nearest(x, net)
            out.loc[ix, "cell"] = c.astype(np.int32)
            out.loc[ix, "far"] = np.sqrt(((x - net[c]) ** 2).sum(axis=1))
        return out

    placed = stored(v.withColumn("at", cell_of("v", "dim")).select("vec_id", "v", "dim", "at.*"),
                    "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("r"))
    known = spark.sparkContext.broadcast(cells.toPandas())  # pivots per length: bounded
    q = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim")
    blocks = max(1, -(-q.count() // part))

    @F.pandas_udf("floor double, cells array<int>")
    def reach(qid: pd.Series, vs: pd.Series, dims: pd.Series) -> pd.DataFrame:
        (samples, net), info = shared.value, known.value
        floors, lists = np.full(len(vs), -np.inf), [None] * len(vs)
        spots = pd.Series(range(len(vs)))
        for dim, ix in spots.groupby(dims.to_numpy()).groups.items():
            ix = np.asarray(ix)
            here = info[info["dim"] == dim]
            x = matrix(vs.iloc[ix], dim)
            if int(dim) in samples:
                sid, sx = samples[int(dim)]
                uid, first = np.unique(sid, return_index=True)  # an id counts once
                s = x @ sx[first].T
                s[qid.to_numpy()[ix][:, None] == uid[None, :]] = -np.inf
                if s.shape[1] >= k:
                    floors[ix] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                c = net[int(dim)][here["cell"].to_numpy()]
            else:
                c = np.zeros((len(here), dim))
            top = x @ c.T + np.sqrt((x ** 2).sum(axis=1))[:, None] * here["r"].to_numpy()[None, :]
            keep = ~(top + 1e-9 * np.abs(top) + 1e-6 < floors[ix][:, None])
            for i, row in zip(ix, keep, strict=True):
                lists[i] = here["cell"].to_numpy()[row].astype(np.int32)
        return pd.DataFrame({"floor": floors, "cells": lists})

    deal = cells.select("dim", "cell", F.ceil(F.col("n") / part).cast("int").alias("deals"))
    hashed = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    left = placed.join(F.broadcast(deal), ["dim", "cell"]).select(
        "dim", "cell", F.pmod(hashed, F.col("deals")).cast("int").alias("deal"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
    right = q.withColumn("to", reach("vec_id", "v", "dim")).select(
        "vec_id", "v", "dim", "to.floor", F.explode("to.cells").alias("cell"),
        F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"))
    right = right.join(F.broadcast(deal), ["dim", "cell"]).select(
        "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), "block",
        "vec_id", "v", "floor")

    def unique(ids: pd.Series, vs: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal rows once. A row's bytes stand for it, zero being of one sign."""
        m = matrix(vs, dim) + 0.0
        first = np.flatnonzero(~pd.Series(list(zip(
            ids, (r.tobytes() for r in m), strict=True))).duplicated().to_numpy())
        return m[first], ids.to_numpy()[first], first

    def search(key: tuple, xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(qs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

        x, x_id, _ = unique(xs["vec_id"], xs["v"], key[0])
        qm, q_id, first = unique(qs["q_vec_id"], qs["q_v"], key[0])
        floor = qs["q_floor"].to_numpy()[first]
        ids, score = dual_tree(qm, q_id, floor, x, x_id, k)
        ok = score > -np.inf
        return pd.DataFrame({"query_id": np.repeat(q_id, k)[ok.ravel()], "vec_id": ids[ok],
                             "score": score[ok].astype(np.int64)})

    keys = ["dim", "cell", "deal", "block"]
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])
    found = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(
        search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

