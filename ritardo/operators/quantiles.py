"""Exact quantiles, medians, robust spread and ranks without one task per group.

``percentile`` keeps every distinct value of a group in one aggregation buffer. Here values are
first counted per ``(group, value bucket)`` with map-side combine; the bucket counts show which
buckets hold the wanted ranks and only those rows are ranked. Results are exact (linear
interpolation between order statistics).

Expressions are written as SQL text: a column object costs a round trip to the JVM per operator.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_PER_E = 512.0
SMALL = 4096  # values of a group that one array holds


def value_bucket_sql(v: str) -> str:
    """A non-decreasing integer function of a double: log-spaced on both sides of zero."""
    mag = f"(cast(floor(ln(abs({v})) * {BUCKETS_PER_E}D) as bigint) + 1048576L)"
    return f"(case when {v} = 0 then 0L when {v} > 0 then {mag} else -{mag} end)"


def value_bucket(v: str) -> Column:
    return F.expr(value_bucket_sql(f"`{v}`"))


def _list(cols: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in cols]


def _over(keys: Sequence[str], order: str | None = None) -> str:
    part = f"partition by {', '.join(_list(keys))}" if keys else ""
    return f"over ({part}{f' order by {order}' if order else ''})"


def _value_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """Distinct values of each group with their counts, bucketed."""
    keep = [f"`{weight}`"] if weight else []
    n = f"sum(`{weight}`) as __m" if weight else "count(*) as __m"
    return (
        df.selectExpr(*_list(keys), f"cast(`{value}` as double) as __v", *keep)
        .where("__v is not null and not isnan(__v)")
        .groupBy(*keys, value_bucket("__v").alias("__b"), "__v")
        .agg(F.expr(n))
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float | str],
    count: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group with the given quantiles (name -> probability) of ``value``.

    A text in place of a probability picks the order statistic at that 0-based rank, as SQL over
    the count ``__n``. Nulls and NaN are ignored; a group with no value gives no row. ``count``
    names an optional column with the number of values; ``weight`` an optional column of
    whole-number weights.
    """
    keys = list(keys)
    # both branches below read this one shuffle, so the input is computed once
    vals = _value_counts(df, keys, value, weight)
    hist = (
        vals.groupBy(*keys, "__b").agg(F.expr("sum(__m) as __c"))
        .selectExpr(
            "*", f"sum(__c) {_over(keys)} as __n",
            f"sum(__c) {_over(keys, '__b')} - __c as __before")
    )
    ranks: dict[str, tuple[str, str]] = {}
    for name, q in probs.items():
        if isinstance(q, str):
            ranks[name] = (f"cast({q} as bigint)",) * 2
        else:
            h = f"(__n - 1) * {float(q)!r}D"
            ranks[name] = (f"cast(floor({h}) as bigint)", f"cast(ceil({h}) as bigint)")
    wanted = ", ".join(dict.fromkeys(r for pair in ranks.values() for r in pair))
    need = hist.where(
        f"exists(array({wanted}), r -> r >= __before and r < __before + __c)"
    ).selectExpr(*_list(keys), "__b", "__before", "__n")
    ranked = vals.join(need, [*keys, "__b"]).selectExpr(
        *_list(keys), "__v", "__n", "__m",
        f"__before + sum(__m) {_over([*keys, '__b'], '__v')} - __m as __at")
    aggs, cols = ["max(__n) as __n"], []
    for name, (lo, hi) in ranks.items():
        for side, r in (("lo", lo), ("hi", hi)):
            aggs.append(f"max(case when {r} >= __at and {r} < __at + __m then __v end)"
                        f" as `__{side}_{name}`")
        if isinstance(probs[name], str):
            cols.append(f"`__lo_{name}` as `{name}`")
        else:
            h = f"(__n - 1) * {float(probs[name])!r}D"
            cols.append(f"`__lo_{name}` + (`__hi_{name}` - `__lo_{name}`) * ({h} - floor({h}))"
                        f" as `{name}`")
    if count:
        cols.append(f"cast(__n as bigint) as `{count}`")
    out = ranked.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    return out.selectExpr(*_list(keys), *cols)


def group_values(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame | None:
    """keys and the sorted values of each group, as doubles, in one shuffle; None if a group has more
    than ``SMALL`` of them. Nulls and NaN are ignored; a group with no value gives no row."""
    keys = list(keys)
    v = df.selectExpr(*_list(keys), f"cast(`{value}` as double) as __v").where(
        "__v is not null and not isnan(__v)")
    if not v.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > SMALL).isEmpty():
        return None
    return v.repartition(*keys).groupBy(*keys).agg(F.expr(f"array_sort(collect_list(__v)) as `{name}`"))


def median_sql(values: str) -> str:
    """The median of an array of :func:`group_values`."""
    h = f"((size({values}) - 1) * 0.5D)"
    lo, hi = (f"{values}[cast({r}({h}) as int)]" for r in ("floor", "ceil"))
    return f"({lo} + ({hi} - {lo}) * ({h} - floor({h})))"


def loo_median_sql(values: str, own: str) -> str:
    """The median of such an array without one value of its own; null if there is no other."""
    n, h = f"size({values})", f"((size({values}) - 2) * 0.5D)"
    lo, hi = (f"if({own} > {values}[cast({r}({h}) as int)], {values}[cast({r}({h}) as int)],"
              f" {values}[cast(least({r}({h}) + 1, {n} - 1) as int)])" for r in ("floor", "ceil"))
    return f"(case when {n} >= 2 then {lo} + ({hi} - {lo}) * ({h} - floor({h})) end)"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join, or a one-row cross join when there is no key."""
    return left.join(right, list(keys), how) if keys else left.crossJoin(F.broadcast(right))


def robust_sd(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "robust_sd", scale: float = 1.4826
) -> DataFrame:
    """``1.4826 * median(|x - median(x)|)`` per group, plus the median and the count.

    Works on the distinct values and their counts, so the input is read and shuffled once.
    """
    keys = list(keys)
    d = _value_counts(df, keys, value).selectExpr(*_list(keys), "__v as __x", "__m as __w")
    med = exact_quantiles(d, keys, "__x", {"__med": 0.5}, count="__n0", weight="__w")
    dev = join_on(d, med.select(*keys, "__med"), keys, "inner").selectExpr(
        *_list(keys), "__w", "abs(__x - __med) as __dev")
    mad = exact_quantiles(dev, keys, "__dev", {"__mad": 0.5}, weight="__w")
    return join_on(med, mad, keys, "inner").selectExpr(
        *_list(keys), f"__mad * {scale!r}D as `{name}`", f"__med as `{name}_median`",
        f"__n0 as `{name}_n`")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Mid-rank of each row inside its group (ties share the mean rank), from counts per value."""
    keys = list(keys)
    by_value = _value_counts(df, keys, value)
    base = by_value.groupBy(*keys, "__b").agg(F.expr("sum(__m) as __c")).selectExpr(
        *_list(keys), "__b", f"sum(__c) {_over(keys, '__b')} - __c as __before")
    ranks = by_value.join(base, [*keys, "__b"]).selectExpr(
        *_list(keys), "__v",
        f"__before + sum(__m) {_over([*keys, '__b'], '__v')} - __m + (__m + 1) / 2.0D"
        f" as `{name}`")
    return df.withColumn("__v", F.expr(f"cast(`{value}` as double)")).join(
        ranks, [*keys, "__v"], "left").drop("__v")


def loo_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    count: str = "n_others",
) -> DataFrame:
    """Quantiles of the *other* rows of the group, for every row, without pairing rows.

    With the sorted group ``v`` and the own value ``x`` taken out, the rest has ``v[i]`` at place
    ``i`` when ``x > v[i]`` and ``v[i + 1]`` otherwise, so four order statistics per quantile are
    enough. Rows whose own value is null see the whole group.
    """
    keys = list(keys)
    stats: dict[str, float | str] = {}
    cols = []
    x = f"`{value}`"
    own = f"({x} is not null and not isnan(cast({x} as double)))"
    for name, q in probs.items():
        h = f"(__n - 2) * {float(q)!r}D"
        for side, r in (("0", f"floor({h})"), ("1", f"ceil({h})")):
            for step in (0, 1):
                stats[f"__{name}_{side}{step}"] = f"greatest(least({r} + {step}, __n - 1), 0)"
        stats[f"__{name}_all"] = q
        lo, hi = (f"(case when {x} > `__{name}_{s}0` then `__{name}_{s}0`"
                  f" else `__{name}_{s}1` end)" for s in "01")
        hc = f"(__cnt - 2) * {float(q)!r}D"
        cols.append(
            f"case when not {own} then `__{name}_all` when __cnt >= 2 then"
            f" {lo} + ({hi} - {lo}) * ({hc} - floor({hc})) end as `{name}`")
    g = exact_quantiles(df, keys, value, stats, count="__cnt")
    return join_on(df, g, keys, "left").selectExpr(
        *_list(df.columns), *cols,
        f"cast(coalesce(__cnt - cast({own} as int), 0) as bigint) as `{count}`")
