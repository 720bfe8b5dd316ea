"""Ordered (window-like) operators that do not need a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sorts every row of a key in one task, so one
performance with a third of all notes stalls the job. Here each key is cut along its order into
chunks (``chunk`` is any non-decreasing function of the order, normally ``floor(pos / width)``):

1. rows are hash partitioned once on ``(keys, chunk)`` and the window runs inside the chunk;
2. every chunk is summarised to one row (same exchange, reused);
3. the few summary rows of a key are scanned in order and the carry is joined back.

The result equals the plain window whatever the chunk width is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = "__chunk"


def chunk_of(pos: Column | str, width: int) -> Column:
    """Chunk number of an integer position."""
    if isinstance(pos, str):
        return F.expr(f"cast(floor(`{pos}` / {float(width)!r}D) as bigint)")
    return F.floor(pos / F.lit(float(width))).cast("bigint")


def _parts(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    return df.withColumn(CHUNK, chunk).repartition(*keys, CHUNK)


def _list(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _join_carry(left: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(carry, [*keys, CHUNK], "left")


# kind -> (chunk summary, carry over the summaries, value inside the chunk, combination); {v} the
# column, {o} the order struct, {s} summary, {c} carry, {x} inside, {w} windows by name
_FOLD = ("{f}({v})", "{f}({s}) over {before}", "{f}({v}) over {up}")
_KINDS = {
    "sum": (*(t.replace("{f}", "sum") for t in _FOLD), "coalesce({x} + {c}, {x}, {c})"),
    "max": (*(t.replace("{f}", "max") for t in _FOLD), "greatest({x}, {c})"),
    "min": (*(t.replace("{f}", "min") for t in _FOLD), "least({x}, {c})"),
    "last": ("max_by({v}, case when {v} is not null then {o} end)",
             "last({s}, true) over {before}", "last({v}, true) over {up}", "coalesce({x}, {c})"),
    "next": ("min_by({v}, case when {v} is not null then {o} end)",
             "first({s}, true) over {after}", "first({v}, true) over {down}",
             "coalesce({x}, {c})"),
    "prev": ("max_by(struct({v} as v), {o})", "lag({s}) over {chunks}",
             "lag(struct({v} as v)) over {rows}", "coalesce({x}, {c}).v"),
    "lead": ("min_by(struct({v} as v), {o})", "lead({s}) over {chunks}",
             "lead(struct({v} as v)) over {rows}", "coalesce({x}, {c}).v"),
}


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    combine: bool = False,
    **outputs: tuple[str, str],
) -> DataFrame:
    """Running values in ``order`` inside ``keys``.

    Each output is ``name=(kind, column)``. Kinds: ``sum`` / ``max`` / ``min`` (rows up to and
    including this one), ``last`` (last non-null up to and including this one), ``next``
    (first non-null from this row on), ``prev`` (value of the row before, null at the start),
    ``lead`` (value of the row after). With ``combine``, chunks are summarised before the shuffle:
    rows with columns that no output uses would be shuffled again, without them, to be summarised.
    """
    keys, order = list(keys), list(order)
    parts = _parts(df, keys, chunk)
    rows = f"partition by {_list([*keys, CHUNK])} order by {_list(order)}"
    chunks = f"partition by {_list(keys)} order by `{CHUNK}`"
    names = {
        "o": f"struct({_list(order)})", "rows": f"({rows})", "chunks": f"({chunks})",
        "up": f"({rows} rows between unbounded preceding and current row)",
        "down": f"({rows} rows between current row and unbounded following)",
        "before": f"({chunks} rows between unbounded preceding and 1 preceding)",
        "after": f"({chunks} rows between 1 following and unbounded following)",
    }
    summary, carry, local, final = [], [], [], []
    for name, (kind, col) in outputs.items():
        if kind not in _KINDS:
            raise ValueError(f"unknown scan kind {kind!r}")
        s, c, x = f"`__s_{name}`", f"`__c_{name}`", f"`__l_{name}`"
        fill = {**names, "v": f"`{col}`", "s": s, "c": c, "x": x}
        one, over, inside, both = (t.format(**fill) for t in _KINDS[kind])
        summary.append(f"{one} as {s}")
        carry.append(f"{over} as {c}")
        local.append(f"{inside} as {x}")
        final.append(f"{both} as `{name}`")
    key_list = [f"`{k}`" for k in [*keys, CHUNK]]
    whole = df.withColumn(CHUNK, chunk) if combine else parts
    carries = (
        whole.groupBy(*keys, CHUNK).agg(*[F.expr(e) for e in summary])
        .selectExpr(*key_list, *carry)
    )
    joined = _join_carry(parts.selectExpr("*", *local), carries, keys)
    keep = [f"`{c}`" for c in df.columns if c not in outputs]
    return joined.selectExpr(*keep, *final)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    uses: Sequence[str],
    name: str = "island",
) -> DataFrame:
    """Number (from 1) of the run each row is in: gaps-and-islands in one exchange.

    ``breaks(prev, cur)`` says whether a row starts a new run, given accessors for the columns
    named in ``uses`` of the row before and of this row. The first row of a key starts run 1.
    """
    keys, order = list(keys), list(order)
    parts = _parts(df, keys, chunk)
    rows_w = f"partition by {_list([*keys, CHUNK])} order by {_list(order)}"
    chunks_w = f"partition by {_list(keys)} order by `{CHUNK}`"
    o, box = f"struct({_list(order)})", f"struct({_list(uses)})"

    def acc(side: str) -> Callable[[str], Column]:
        return lambda c: F.col(f"{side}.{c}")

    is_break = F.when(breaks(acc("__prev"), acc("__cur")), 1).otherwise(0)
    start = F.when(F.col("__prev").isNull(), 0).otherwise(is_break)
    opens = F.when(F.col("__prev").isNull(), 1).otherwise(is_break)
    rows = parts.selectExpr("*", f"{box} as __cur", f"lag({box}) over ({rows_w}) as __prev")
    rows = rows.withColumn("__start", start)
    ends = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.expr(f"min_by(__cur, {o}) as __cur"), F.expr(f"max_by(__cur, {o}) as __last"),
             F.expr("sum(__start) as __inside"))
        .selectExpr("*", f"lag(__last) over ({chunks_w}) as __prev")
        .withColumn("__open", opens)
        .selectExpr(
            *[f"`{k}`" for k in [*keys, CHUNK]],
            f"sum(__open + __inside) over ({chunks_w}) - __inside as __base")
    )
    rows = rows.selectExpr("*", f"sum(__start) over ({rows_w} rows between unbounded preceding"
                           " and current row) as __local")
    keep = [f"`{c}`" for c in df.columns if c != name]
    return _join_carry(rows, ends, keys).selectExpr(
        *keep, f"cast(__base + __local as bigint) as `{name}`")


def with_halo(
    df: DataFrame, pos: str, width: int, before: int, after: int, home: str = "__home"
) -> DataFrame:
    """Copy each row into every chunk whose rows may look at it.

    A row at ``pos`` is needed by rows in ``[pos - after, pos + before]``. ``home`` is true in
    the chunk the row belongs to; a bounded RANGE window over ``(keys, __chunk)`` followed by
    ``where(home)`` then equals the same window over the whole key.
    """
    own = chunk_of(pos, width)
    lo = chunk_of(F.col(pos) - F.lit(after), width)
    hi = chunk_of(F.col(pos) + F.lit(before), width)
    return (
        df.withColumn("__own", own)
        .withColumn(CHUNK, F.explode(F.sequence(lo, hi)))
        .withColumn(home, F.col(CHUNK) == F.col("__own"))
        .drop("__own")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    values: Sequence[str],
    width: int,
    *,
    direction: str = "backward",
    strict: bool = False,
    right_tie: str | None = None,
) -> DataFrame:
    """As-of join: for each left row the last (or next) right row of the same key.

    ``backward`` takes the last right row with ``right_pos <= left_pos`` (``<`` when
    ``strict``), ``forward`` the first with ``right_pos >= left_pos``. Written as a union of both
    sides and one :func:`scan`, so no side is broadcast and no range join is needed.
    """
    keys, values = list(keys), list(values)
    side_right = 0 if (direction == "backward") != strict else 1
    payload = [c for c in left.columns if c not in keys]
    key_list = [f"`{k}`" for k in keys]
    l2 = left.selectExpr(
        *key_list, f"`{left_pos}` as __pos", f"{1 - side_right} as __side",
        "cast(null as bigint) as __tie", f"struct({_list(payload)}) as __left")
    tie = f"cast(`{right_tie}` as bigint)" if right_tie else "cast(null as bigint)"
    r2 = right.selectExpr(
        *key_list, f"`{right_pos}` as __pos", f"{side_right} as __side", f"{tie} as __tie",
        f"struct({_list([right_pos, *values])}) as __right")
    both = l2.unionByName(r2, allowMissingColumns=True)
    kind = "last" if direction == "backward" else "next"
    hit = scan(
        both,
        keys,
        ["__pos", "__side", "__tie"],
        chunk_of("__pos", width),
        combine=True,
        __hit=(kind, "__right"),
    ).where("__left is not null")
    return hit.selectExpr(
        *key_list,
        *[f"__left.`{c}` as `{c}`" for c in payload],
        f"__hit.`{right_pos}` as `hit_{right_pos}`",
        *[f"__hit.`{v}` as `{v}`" for v in values],
    )
