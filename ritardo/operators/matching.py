"""One-to-one and tolerance joins of note streams.

Range conditions become equi joins on a time bucket of the tolerance's size, so a hot performance
spreads over many tasks and no pair outside the tolerance is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.operators.folds import blocks_of, carried_fold
from ritardo.operators.ordered import asof, chunk_of, islands, scan
from ritardo.operators.quantiles import (
    exact_quantiles, group_values, join_on, loo_median_sql, loo_quantiles, median_sql,
)
from ritardo.session import cut_lineage

IN_ORDER = 1 << 18  # candidates of one key that a single task runs through


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_pos: str, right_pos: str,
    before: int, after: int,
) -> DataFrame:
    """Pairs with ``left_pos - before <= right_pos <= left_pos + after`` on equal keys.

    Column names other than the keys must not clash.
    """
    size = max(before + after, 1)
    lb = left.withColumn(
        "__b",
        F.explode(F.sequence(chunk_of(F.col(left_pos) - before, size),
                             chunk_of(F.col(left_pos) + after, size))))
    rb = right.withColumn("__b", chunk_of(right_pos, size))
    return lb.join(rb, [*keys, "__b"]).where(
        (F.col(right_pos) >= F.col(left_pos) - before)
        & (F.col(right_pos) <= F.col(left_pos) + after)
    ).drop("__b")


def _greedy_in_order(cands: DataFrame, keys: list[str], ends: Sequence[tuple[str, str]]) -> DataFrame:
    """Sequential greedy choice, key by key as sorted rows stream by; a task holds the ends used in
    one key."""
    domains = [d for d, _ in ends]
    names = [f"__e{i}" for i in range(len(ends))]
    rows = cands.withColumns({n: F.col(c).cast("string") for n, (_, c) in zip(names, ends, strict=True)})
    rows = rows.withColumn("__k", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, used = None, set()
        for b in batches:
            keep = []
            for k, *ids in zip(*(b.column(n).to_pylist() for n in ("__k", *names)), strict=True):
                if k != key:
                    key, used = k, set()
                own = set(zip(domains, ids, strict=True))
                free = used.isdisjoint(own)
                keep.append(free)
                if free:
                    used |= own
            yield b.filter(pa.array(keep, pa.bool_()))

    spread = rows.repartition(*keys).sortWithinPartitions(*keys, "__o")
    return spread.mapInArrow(run, spread.schema).drop("__k", *names)


def greedy_one_to_one(
    cands: DataFrame, keys: Sequence[str], ends: Sequence[tuple[str, str]], order: Sequence[str]
) -> DataFrame:
    """Greedy selection in the total order ``order``; every end is used once.

    ``ends`` are ``(domain, column)``; two columns may share a domain. Candidates that agree in order
    go by their ends; of candidates that agree in these too one stays. Keys of up to ``IN_ORDER``
    candidates, and null ones, run past in order, each in one task. In larger ones, taking, in every round, the
    candidates that come first at all their ends gives the sequential result; rounds go on until
    no candidate is left, each with a checkpoint, so the plan stays flat.
    """
    keys, order = list(keys), list(order)
    slots = F.array_sort(F.array_distinct(F.array(*[F.struct(F.lit(d).alias("d"), F.col(c).cast(
        "string").alias("id")) for d, c in ends])))
    every = cands.withColumns({"__n": F.size(slots), "__slots": slots}).withColumn(
        "__o", F.struct(*order, "__slots"))
    every = cut_lineage(every)
    large = every.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("__c")).where(F.col("__c") > IN_ORDER)
    large = cut_lineage(large.select(*keys))
    if large.isEmpty():
        return _greedy_in_order(every, keys, ends).drop("__o", "__n", "__slots")
    kept = _greedy_in_order(every.join(large, keys, "left_anti"), keys, ends)
    rest = cut_lineage(every.join(large, keys, "left_semi").dropDuplicates([*keys, "__o"]))
    while not rest.isEmpty():
        ex = rest.select(*keys, "__o", "__n", F.explode("__slots").alias("__s"))
        first = ex.groupBy(*keys, "__s").agg(F.min("__o").alias("__o"))
        win = (
            ex.join(first, [*keys, "__s", "__o"], "left_semi")
            .groupBy(*keys, "__o").agg(F.count("*").alias("__c"), F.max("__n").alias("__n"))
            .where("__c = __n").select(*keys, "__o")
        )
        chosen = cut_lineage(rest.join(win, [*keys, "__o"], "left_semi"))
        kept = kept.unionByName(chosen)
        used = chosen.select(*keys, F.explode("__slots").alias("__s"))
        gone = ex.join(used, [*keys, "__s"], "left_semi").select(*keys, "__o").distinct()
        rest = cut_lineage(rest.join(gone, [*keys, "__o"], "left_anti"))
    return kept.drop("__o", "__n", "__slots")


def match_notes(
    ref: DataFrame, est: DataFrame, keys: Sequence[str], tol_us: int, width: int
) -> DataFrame:
    """Same-pitch one-to-one matches within ``tol_us``: earliest unused estimate, in time order.

    ``ref`` / ``est``: keys, ``note_id``, ``onset_us``, ``pitch``. Notes of one pitch separated by
    more than the tolerance cannot influence each other, so the fold runs inside such clusters, in
    blocks that hand on the notes still open.
    """
    k = [*keys, "pitch"]

    def side(df: DataFrame, s: int) -> DataFrame:
        return df.select(*k, "onset_us", F.lit(s).alias("side"), "note_id")

    both = side(ref, 0).unionByName(side(est, 1))
    cl = islands(both, k, ["onset_us", "side", "note_id"], chunk_of("onset_us", width),
                 lambda p, c: c("onset_us") - p("onset_us") > tol_us, ["onset_us"], "cluster")
    blocks = blocks_of(cl, [*k, "cluster"], ["onset_us", "side", "note_id"], chunk_of(
        "onset_us", width))
    item = "struct<onset_us:bigint,side:int,note_id:bigint>"
    pair = "struct<ref_id:bigint,est_id:bigint,ref_us:bigint,est_us:bigint>"
    none = F.expr(f"cast(array() as array<{item}>)")
    zero = F.expr(f"cast(array() as array<{pair}>)")

    def step(acc: Column, x: Column) -> Column:
        # open notes are all of one side (a possible match is taken at once)
        live = F.filter(acc["carry"], lambda o: x["onset_us"] - o["onset_us"] <= tol_us)
        hit = (F.size(live) > 0) & (F.get(live, F.lit(0))["side"] != x["side"])
        h = F.get(live, F.lit(0))
        ref_first = h["side"] == 0
        new = F.struct(
            F.when(ref_first, h["note_id"]).otherwise(x["note_id"]).alias("ref_id"),
            F.when(ref_first, x["note_id"]).otherwise(h["note_id"]).alias("est_id"),
            F.when(ref_first, h["onset_us"]).otherwise(x["onset_us"]).alias("ref_us"),
            F.when(ref_first, x["onset_us"]).otherwise(h["onset_us"]).alias("est_us"),
        )
        return F.struct(
            F.when(hit, F.slice(live, 2, F.greatest(F.size(live) - 1, F.lit(0))))
            .otherwise(F.concat(live, F.array(x))).alias("carry"),
            F.when(hit, F.concat(acc["out"], F.array(new))).otherwise(acc["out"]).alias("out"),
        )

    def fold(carry: Column) -> Column:
        return F.aggregate("items", F.struct(carry.alias("carry"), zero.alias("out")), step)

    return carried_fold(blocks, [*k, "cluster"], fold, none).drop("cluster")


def _on_one_clock(
    ref: DataFrame, est: DataFrame, keys: list[str], first_tol_us: int, width: int
) -> DataFrame:
    """The estimate with its median offset from the reference, of matches within
    ``first_tol_us``, taken off."""
    m0 = match_notes(ref, est, keys, first_tol_us, width).withColumn(
        "__d", F.col("est_us") - F.col("ref_us"))
    off = exact_quantiles(m0, keys, "__d", {"__off": 0.5})
    est = join_on(est, off, keys, "left").withColumn("__off", F.coalesce(
        F.round("__off").cast("bigint"), F.lit(0).cast("bigint")))
    return est.withColumn("onset_us", F.col("onset_us") - F.col("__off")).drop("__off")


def note_f1(
    ref: DataFrame, est: DataFrame, keys: Sequence[str], tol_us: int, width: int,
    first_tol_us: int | None = None,
) -> DataFrame:
    """Precision, recall, F1 and onset errors; ``first_tol_us`` removes a median clock offset."""
    keys = list(keys)
    if first_tol_us:
        est = _on_one_clock(ref, est, keys, first_tol_us, width)
    m = match_notes(ref, est, keys, tol_us, width)
    n = [
        ref.groupBy(*keys).agg(F.count("*").alias("n_ref")),
        est.groupBy(*keys).agg(F.count("*").alias("n_est")),
        m.groupBy(*keys).agg(
            F.count("*").alias("n_match"),
            (F.avg(F.col("est_us") - F.col("ref_us")) / 1000.0).alias("onset_err_mean_ms")),
    ]
    j = n[0].join(n[1], keys, "full").join(n[2], keys, "full")
    j = j.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint"))
                       for c in ("n_ref", "n_est", "n_match")})
    p = F.when(F.col("n_est") > 0, F.col("n_match") / F.col("n_est"))
    r = F.when(F.col("n_ref") > 0, F.col("n_match") / F.col("n_ref"))
    return j.withColumns({
        "precision": p, "recall": r,
        "f1": F.when(F.col("n_match") > 0, 2 * p * r / (p + r)).otherwise(0.0)})


def nearest_note(
    rows: DataFrame, notes: DataFrame, keys: Sequence[str], tol_us: int, width: int
) -> DataFrame:
    """For each label row the nearest note of the same pitch within the tolerance.

    The earlier note wins a tie. ``rows``: keys, ``pitch``, ``row_id``, ``row_us``.
    """
    k = [*keys, "pitch"]
    n = notes.select(*k, "onset_us", "note_id")
    lo = asof(rows, n, k, "row_us", "onset_us", ["note_id"], width, right_tie="note_id")
    lo = lo.withColumnsRenamed({"note_id": "lo_id", "hit_onset_us": "lo_us"})
    hi = asof(lo, n, k, "row_us", "onset_us", ["note_id"], width, direction="forward",
              strict=True, right_tie="note_id")
    hi = hi.withColumnsRenamed({"note_id": "hi_id", "hit_onset_us": "hi_us"})
    dl, dh = F.col("row_us") - F.col("lo_us"), F.col("hi_us") - F.col("row_us")
    take_lo = F.col("hi_us").isNull() | (dl <= dh)
    d = F.when(take_lo, dl).otherwise(dh)
    return hi.withColumn(
        "note_id", F.when(d <= tol_us, F.when(take_lo, F.col("lo_id")).otherwise(F.col("hi_id")))
    ).drop("lo_id", "lo_us", "hi_id", "hi_us")


def labelled_notes(
    rows: DataFrame, notes: DataFrame, keys: Sequence[str], tol_us: int, width: int
) -> tuple[DataFrame, DataFrame]:
    """Label rows on their notes (see ``nearest_note``), and per key what does not fit.

    ``rows`` and ``notes`` also have ``velocity``. The counts are of rows without a note, of rows
    that share a note with another, and of rows whose velocity is not the note's.
    """
    keys = list(keys)
    m = nearest_note(rows, notes, keys, tol_us, width)
    v = notes.groupBy(*keys, "note_id").agg(F.max("velocity").alias("__v"))
    n = m.where("note_id is not null").groupBy(*keys, "note_id").agg(F.count("*").alias("__n"))
    j = m.join(v, [*keys, "note_id"], "left").join(n, [*keys, "note_id"], "left")
    counts = j.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count(F.when(F.col("note_id").isNull(), 1)).alias("n_unmatched"),
        F.count(F.when(F.col("__n") > 1, 1)).alias("n_duplicate"),
        F.count(F.when(F.col("__v") != F.col("velocity"), 1)).alias("n_velocity_differs"))
    return m, counts


def require_fit(counts: DataFrame) -> None:
    """Raise if any label row is unmatched, shares its note, or differs in velocity."""
    names = ("n_unmatched", "n_duplicate", "n_velocity_differs")
    bad = counts.agg(*[F.sum(c).alias(c) for c in names]).first()
    if any(bad[c] for c in names):
        raise ValueError("labels do not fit the notes: " + ", ".join(f"{c}={bad[c]}" for c in names))


def boundary_prf(
    pred: DataFrame, true: DataFrame, keys: Sequence[str], tol: int, first: DataFrame | None = None
) -> DataFrame:
    """One-to-one boundary matching within ``tol``, closest first. ``pos`` on both sides.

    ``first``: keys and ``pos`` of the first onset of a piece, which is a boundary for nobody and
    counts on neither side.
    """
    keys = list(keys)
    if first is not None:
        f = first.select(*keys, "pos").distinct()
        pred, true = (d.join(f, [*keys, "pos"], "left_anti") for d in (pred, true))
    c = range_join(pred.select(*keys, F.col("pos").alias("p")),
                   true.select(*keys, F.col("pos").alias("t")), keys, "p", "t", tol, tol)
    c = c.withColumn("d", F.abs(F.col("p") - F.col("t")))
    tp = greedy_one_to_one(c, keys, [("p", "p"), ("t", "t")], ["d", "p", "t"])
    j = (
        pred.groupBy(*keys).agg(F.count("*").alias("n_pred"))
        .join(true.groupBy(*keys).agg(F.count("*").alias("n_true")), keys, "full")
        .join(tp.groupBy(*keys).agg(F.count("*").alias("tp")), keys, "left")
    )
    j = j.withColumns({x: F.coalesce(x, F.lit(0).cast("bigint"))
                       for x in ("n_pred", "n_true", "tp")})
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred"))
    r = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true"))
    return j.withColumns({"precision": p, "recall": r,
                          "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)})


def false_extras(
    ref: DataFrame, est: DataFrame, keys: Sequence[str], width: int, tol_us: int = 50_000,
    first_tol_us: int = 200_000,
) -> DataFrame:
    """``false_extra`` of every estimated note: 1 if no reference note of its pitch is matched
    within ``tol_us`` once the median offset of the clocks is taken off."""
    keys = list(keys)
    moved = _on_one_clock(ref, est, keys, first_tol_us, width)
    hit = match_notes(ref, moved, keys, tol_us, width).select(
        *keys, F.col("est_id").alias("note_id"), F.lit(0).alias("__h"))
    return est.join(hit, [*keys, "note_id"], "left").withColumn(
        "false_extra", F.coalesce("__h", F.lit(1))).drop("__h")


def set_prf(pred: DataFrame, true: DataFrame, keys: Sequence[str], on: Sequence[str],
            expected: DataFrame | None = None) -> DataFrame:
    """Set-wise precision / recall / F1 per key: both empty gives 1, one empty gives 0.

    Keys that neither side has are known from ``expected`` only.
    """
    keys, on = list(keys), list(on)
    p = pred.select(*keys, *on).distinct().withColumn("__p", F.lit(1))
    t = true.select(*keys, *on).distinct().withColumn("__t", F.lit(1))
    j = p.join(t, [*keys, *on], "full").groupBy(*keys).agg(
        F.count("__p").alias("n_pred"), F.count("__t").alias("n_true"),
        F.count(F.col("__p") + F.col("__t")).alias("n_correct"))
    if expected is not None:
        n = ("n_pred", "n_true", "n_correct")
        j = expected.select(*keys).distinct().join(j, keys, "left").fillna(0, list(n))
    none = F.when((F.col("n_pred") == 0) & (F.col("n_true") == 0), 1.0).otherwise(0.0)
    pr = F.when(F.col("n_pred") > 0, F.col("n_correct") / F.col("n_pred")).otherwise(none)
    rc = F.when(F.col("n_true") > 0, F.col("n_correct") / F.col("n_true")).otherwise(none)
    return j.withColumns({"precision": pr, "recall": rc,
                          "f1": F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0)})


def _mates_of_large(points: DataFrame, matched: DataFrame, med: DataFrame, keys: list[str], note: str
                    ) -> DataFrame:
    """Points with their own onset and their chord mates' median, for positions of any number of notes."""
    at = [*keys, "pos_uq"]
    own = matched.select(*keys, note, F.col("onset_us").cast("double").alias("__own"))
    pts = points.select(*keys, note, "pos_uq").join(own, [*keys, note], "left")
    # the group of a note is its own position's matches; a note without a match sees all of them
    others = points.select(*keys, note, "pos_uq").join(own, [*keys, note], "left_anti")
    grp = matched.select(*keys, note, "pos_uq", F.col("onset_us").cast("double").alias("__own"))
    mates = loo_quantiles(grp, at, "__own", {"__mate": 0.5}).select(*keys, note, "__mate")
    whole = others.join(med, at, "left").select(*keys, note, F.col("__m").alias("__mate"))
    return pts.join(mates.unionByName(whole), [*keys, note], "left")


def loo_expected_onsets(
    points: DataFrame, matched: DataFrame, keys: Sequence[str], note: str, width: int
) -> DataFrame:
    """Expected onset of score notes from the other matched notes.

    ``points``: keys, ``note``, ``pos_uq``; ``matched``: the same plus ``onset_us``. Chord mates
    give their median; otherwise the value lies between the (running-maximum) medians of the
    neighbouring positions, clamped at the ends. Null when no other match exists.
    """
    keys = list(keys)
    at = [*keys, "pos_uq"]
    values = group_values(matched, at, "onset_us", "__v")
    med = cut_lineage(exact_quantiles(matched, at, "onset_us", {"__m": 0.5}) if values is None else
                      values.withColumn("__m", F.expr(median_sql("__v"))))
    knots = scan(med, keys, ["pos_uq"], chunk_of("pos_uq", width), __k=("max", "__m")).select(
        *keys, F.col("pos_uq").alias("__kp"), "__k")
    if values is None:
        pts = _mates_of_large(points, matched, med, keys, note)
    else:
        own = matched.select(*keys, note, F.col("onset_us").cast("double").alias("__own"),
                             F.col("pos_uq").alias("__at"))
        mates = med.select(*keys, F.col("pos_uq").alias("__at"), "__v", "__m")
        pts = points.select(*keys, note, "pos_uq").join(own, [*keys, note], "left").withColumn(
            "__at", F.coalesce("__at", "pos_uq")).join(mates, [*keys, "__at"], "left").select(
            *keys, note, "pos_uq", "__own", F.expr(
                f"if(__own is null, __m, {loo_median_sql('__v', '__own')})").alias("__mate"))
    pts = cut_lineage(pts)
    lo = asof(pts, knots, keys, "pos_uq", "__kp", ["__k"], width, strict=True)
    lo = lo.withColumnsRenamed({"hit___kp": "__p0", "__k": "__k0"})
    hi = asof(lo, knots, keys, "pos_uq", "__kp", ["__k"], width, direction="forward",
              strict=True)
    hi = hi.withColumnsRenamed({"hit___kp": "__p1", "__k": "__k1"})
    between = F.col("__k0") + (F.col("__k1") - F.col("__k0")) * (
        F.col("pos_uq") - F.col("__p0")) / (F.col("__p1") - F.col("__p0"))
    return hi.select(
        *keys, note, "pos_uq",
        F.coalesce("__mate", between, "__k0", "__k1").alias("expected_us"))


def resolve_duplicates(
    pairs: DataFrame, keys: Sequence[str], width: int
) -> DataFrame:
    """Make candidate matches one-to-one.

    ``pairs``: keys, ``s_id``, ``p_id``, ``pos_uq``, ``s_pitch``, ``onset_us``, ``p_pitch``. Pairs
    alone at both ends stay; the rest go in order of pitch distance, distance to the onset
    expected from the unique pairs, score position, played onset and ids.
    """
    keys = list(keys)
    sc = pairs.groupBy(*keys, "s_id").agg(F.count("*").alias("__sc"))
    pc = pairs.groupBy(*keys, "p_id").agg(F.count("*").alias("__pc"))
    p = pairs.join(sc, [*keys, "s_id"]).join(pc, [*keys, "p_id"])
    p = cut_lineage(p.withColumn("__u", (F.col("__sc") == 1) & (F.col("__pc") == 1)))
    uniq = p.where("__u").select(*pairs.columns)
    dup = p.where("not __u").select(*pairs.columns).distinct()
    exp = loo_expected_onsets(
        dup.select(*keys, "s_id", "pos_uq").distinct(),
        uniq.select(*keys, "s_id", "pos_uq", "onset_us"), keys, "s_id", width)
    c = dup.join(exp.select(*keys, "s_id", "expected_us"), [*keys, "s_id"], "left").withColumns({
        "__dp": F.abs(F.col("p_pitch") - F.col("s_pitch")),
        "__dt": F.coalesce(F.abs(F.col("onset_us") - F.col("expected_us")),
                           F.lit(float("inf")))})
    won = greedy_one_to_one(c, keys, [("s", "s_id"), ("p", "p_id")],
                            ["__dp", "__dt", "pos_uq", "onset_us", "s_id", "p_id"])
    return uniq.unionByName(won.select(*pairs.columns))


def reassign_same_pitch(
    matched: DataFrame, free: DataFrame, keys: Sequence[str], width: int, *,
    margin_us: float = 30_000, window_us: int = 100_000,
) -> DataFrame:
    """Swaps of a match to a free same-pitch note nearer to where the note was due.

    ``matched``: keys, ``s_id``, ``p_id``, ``pos_uq``, ``pitch``, ``onset_us``, ``frozen``;
    ``free``: keys, ``p_id``, ``pitch``, ``onset_us``. A swap gains more than the margin, lands
    in the window, and moves each score note and each of its two played notes once.
    """
    keys = list(keys)
    cand = matched.where("not frozen")
    exp = loo_expected_onsets(cand, matched, keys, "s_id", width).select(
        *keys, "s_id", "expected_us").where("expected_us is not null")
    c = cand.join(exp, [*keys, "s_id"]).withColumn(
        "__e", F.round("expected_us").cast("bigint"))
    f = free.select(*keys, "pitch", F.col("p_id").alias("new_id"),
                    F.col("onset_us").alias("new_us"))
    o = range_join(c, f, [*keys, "pitch"], "__e", "new_us", window_us + 1, window_us + 1)
    d_old = F.abs(F.col("onset_us") - F.col("expected_us"))
    d_new = F.abs(F.col("new_us") - F.col("expected_us"))
    o = o.withColumn("loss", d_new - d_old).where(
        (d_new <= window_us) & (F.col("loss") < -margin_us))
    return greedy_one_to_one(
        o, keys, [("s", "s_id"), ("p", "p_id"), ("p", "new_id")],
        ["loss", "s_id", "p_id", "new_id"]
    ).select(*keys, "s_id", "p_id", "new_id")
