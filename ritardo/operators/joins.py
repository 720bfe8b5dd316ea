"""Key, set and span joins between scores, performances and annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.operators.matching import range_join
from ritardo.operators.ordered import chunk_of, scan
from ritardo.operators.quantiles import join_on, robust_sd


def beat_consistency(
    matched: DataFrame, downbeats: DataFrame, keys: Sequence[str], bar: str, tol_us: int,
    width: int,
) -> DataFrame:
    """Share of matched notes whose onset lies between its bar's downbeat and the next one."""
    keys = list(keys)
    span = scan(downbeats, keys, [bar], chunk_of(bar, width), __next=("lead", "downbeat_us"))
    t = F.col("onset_us")
    ok = (t >= F.col("downbeat_us") - tol_us) & (
        F.col("__next").isNull() | (t <= F.col("__next") + tol_us))
    return matched.join(span, [*keys, bar]).groupBy(*keys).agg(
        F.count("*").alias("n_checked"), F.avg(ok.cast("int")).alias("share_inside"))


def restrict_to_score(pairs: DataFrame, keep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cut an alignment to the notes of a smaller score.

    Pairs of score notes outside go, with the played notes matched there; unmatched played notes
    stay only between the first and last onset of the notes matched inside. ``onset_us`` is the
    played onset of the pair (null for a deletion's missing side is not used).
    """
    keys = list(keys)
    k = keep.select(*keys, "s_id", F.lit(True).alias("__in"))
    p = pairs.join(k, [*keys, "s_id"], "left").withColumn("__in", F.coalesce(
        "__in", F.lit(False)))
    inside = p.where("__in and label = 'match'").groupBy(*keys).agg(
        F.min("onset_us").alias("__lo"), F.max("onset_us").alias("__hi"))
    out = p.where("s_id is not null and not __in and p_id is not null").select(
        *keys, "p_id").distinct()
    p = p.join(inside, keys, "left")
    free = F.col("s_id").isNull()
    ok = F.col("__in") | (free & F.col("onset_us").between(F.col("__lo"), F.col("__hi")))
    return p.where(ok).join(out, [*keys, "p_id"], "left_anti").drop("__in", "__lo", "__hi")


def alias_conflicts(held: DataFrame, cand: DataFrame, is_catalogue: str | None = None
                    ) -> DataFrame:
    """Candidate pieces that may be held-out music under another id.

    Same surname, a shared catalogue token, and one token set inside the other. The inner set is
    found through its rarest token only, so common tokens never pair up whole corpora.
    ``is_catalogue`` is the pattern one shared token must match (default: no bare ``no<n>``).
    """
    both = held.select("surname", F.explode("tokens").alias("token")).unionByName(
        cand.select("surname", F.explode("tokens").alias("token")))
    freq = both.groupBy("surname", "token").agg(F.count("*").alias("__f"))

    def rarest(df: DataFrame, side: str) -> DataFrame:
        t = df.select("surname", F.col("piece_id").alias(f"{side}_id"), "tokens",
                      F.explode("tokens").alias("token")).join(freq, ["surname", "token"])
        return t.groupBy("surname", f"{side}_id").agg(
            F.min_by("token", F.struct("__f", "token")).alias("token"),
            F.first("tokens").alias(f"{side}_tokens"))

    def all_tokens(df: DataFrame, side: str) -> DataFrame:
        return df.select("surname", F.col("piece_id").alias(f"{side}_id"),
                         F.col("tokens").alias(f"{side}_tokens"),
                         F.explode("tokens").alias("token"))

    def inside(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        j = rarest(inner, i).join(all_tokens(outer, o), ["surname", "token"])
        return j.where(F.size(F.array_except(f"{i}_tokens", f"{o}_tokens")) == 0)

    pairs = inside(held, "h", cand, "c").select("c_id", "h_id", "c_tokens", "h_tokens").unionByName(
        inside(cand, "c", held, "h").select("c_id", "h_id", "c_tokens", "h_tokens"))
    shared = F.array_intersect("c_tokens", "h_tokens")
    if is_catalogue is None:
        ok = F.size(F.filter(shared, lambda t: ~t.startswith("no"))) > 0
    else:
        ok = F.size(F.filter(shared, lambda t: t.rlike(is_catalogue))) > 0
    return pairs.where((F.col("c_id") != F.col("h_id")) & ok).select(
        F.col("c_id").alias("piece_id"), F.col("h_id").alias("held_piece_id")).distinct()


def best_window(bars: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Window sharing the most bars with an issue; the first (``seq``) on ties."""
    keys = list(keys)
    w = windows.select(*keys, "window_id", "seq", F.explode("bars").alias("bar"))
    n = bars.select(*keys, "bar").distinct().join(w, [*keys, "bar"]).groupBy(
        *keys, "window_id", "seq").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("seq")).alias("s"), "window_id"))
    return n.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.window_id").alias("window_id"), F.col("b.n").alias("n_shared"))


def span_match(notes: DataFrame, other: DataFrame, keys: Sequence[str], tol_us: int) -> DataFrame:
    """Share of notes that have a note of the same pitch within ``tol_us`` in the other table."""
    k = [*keys, "pitch"]
    left = notes.select(*k, "note_id", F.col("onset_us").alias("__t"))
    right = other.select(*k, F.col("onset_us").alias("__u"))
    hit = range_join(left, right, k, "__t", "__u", tol_us, tol_us).select(
        *keys, "note_id").distinct().withColumn("__hit", F.lit(1))
    return left.join(hit, [*keys, "note_id"], "left").groupBy(*keys).agg(
        F.avg(F.coalesce("__hit", F.lit(0))).alias("share_found"))


def best_variant(variants: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reading whose id set has the highest Jaccard similarity with the truth."""
    keys = list(keys)
    v = variants.select(*keys, "variant", "id").distinct()
    t = truth.select(*keys, "id").distinct()
    nv = v.groupBy(*keys, "variant").agg(F.count("*").alias("nv"))
    nt = t.groupBy(*keys).agg(F.count("*").alias("nt"))
    nc = v.join(t, [*keys, "id"]).groupBy(*keys, "variant").agg(F.count("*").alias("nc"))
    c = F.coalesce("nc", F.lit(0))
    j = nv.join(nt, keys).join(nc, [*keys, "variant"], "left").withColumn(
        "jaccard", c / (F.col("nv") + F.col("nt") - c))
    best = j.groupBy(*keys).agg(F.min(F.struct((-F.col("jaccard")).alias("m"), "variant")).alias(
        "b"))
    return best.select(*keys, F.col("b.variant").alias("variant"), (-F.col("b.m")).alias(
        "jaccard"))


def staff_from_tracks(notes: DataFrame, tracks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staff by (onset, pitch) of the track file; 0 when the note is in both tracks."""
    k = [*keys, "onset_uq", "pitch"]
    t = tracks.groupBy(*k).agg(F.min("staff").alias("__a"), F.max("staff").alias("__b"))
    return notes.join(t, k, "left").withColumn(
        "track", F.when(F.col("__a") != F.col("__b"), F.lit(0).cast("bigint")).otherwise(
            F.col("__a"))).drop("__a", "__b")


def opening_match(
    notes: DataFrame, keys: Sequence[str], openings: DataFrame, segment: str, n: int
) -> DataFrame:
    """Places in a segment's own full score where its first ``n`` pitches occur in a row.

    ``notes``: keys (of the score), ``idx``, ``pitch``; ``openings``: keys, ``segment``, ``idx``
    from 1, ``pitch``. Every note is sent to the ``n`` windows that contain it, so the n-grams are
    grouped without ordering a whole score; a segment meets its own score only.
    """
    keys = list(keys)

    def grams(df: DataFrame, *more: str) -> DataFrame:
        own = [*keys, *more]
        w = df.select(*own, F.explode(F.sequence(F.col("idx") - (n - 1), F.col("idx"))).alias(
            "start"), "idx", "pitch")
        return w.groupBy(*own, "start").agg(
            F.count("*").alias("c"),
            F.array_sort(F.collect_list(F.struct("idx", "pitch"))).alias("g"),
        ).where(F.col("c") == n).select(
            *own, "start", F.concat_ws(",", F.transform("g", lambda x: x["pitch"].cast(
                "string"))).alias("gram"))

    full = grams(notes)
    seg = grams(openings, segment).where("start = 1").select(*keys, segment, "gram")
    return full.join(seg, [*keys, "gram"]).groupBy(segment, *keys).agg(
        F.min("start").alias("start_idx"), F.count("*").alias("n_places"))


def trimmed_line(
    df: DataFrame, keys: Sequence[str], x: str, y: str, *, rounds: int = 3, cut: float = 5.0,
    floor: float = 1e-3,
) -> DataFrame:
    """Clock line by rounds of least squares on the points within ``cut`` robust SDs."""
    keys = list(keys)
    kept = df
    for i in range(rounds):
        line = kept.groupBy(*keys).agg(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.count("*").alias("n_kept"))
        if i == rounds - 1:
            return line
        res = join_on(df, line, keys, "inner").withColumn(
            "__r", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
        # the spread is that of the points the line was fitted on
        fit = join_on(kept, line, keys, "inner").withColumn(
            "__r", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
        sd = robust_sd(fit, keys, "__r", "__sd")
        kept = join_on(res, sd, keys, "inner").where(
            F.abs(F.col("__r") - F.col("__sd_median"))
            < cut * F.greatest(F.col("__sd"), F.lit(floor))).select(*df.columns)
    raise ValueError("rounds must be at least 1")


def detection_counts(
    pred: DataFrame, truth: DataFrame, ignore: DataFrame, keys: Sequence[str], on: Sequence[str]
) -> DataFrame:
    """tp / fp / fn of key sets; predictions in ``ignore`` are no false positives."""
    k = [*keys, *on]
    p = pred.select(*k).distinct().withColumn("__p", F.lit(True))
    t = truth.select(*k).distinct().withColumn("__t", F.lit(True))
    g = ignore.select(*k).distinct().withColumn("__g", F.lit(True))
    j = p.join(t, k, "full").join(g, k, "left")
    a, b, c = (F.col(x).isNotNull() for x in ("__p", "__t", "__g"))
    n = j.groupBy(*keys).agg(
        F.count(F.when(a & b, 1)).alias("tp"), F.count(F.when(a & ~b & ~c, 1)).alias("fp"),
        F.count(F.when(b & ~a, 1)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": F.when(tp + fp > 0, tp / (tp + fp)),
                          "recall": F.when(tp + fn > 0, tp / (tp + fn))})


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and linearly weighted kappa of integer codes, from the confusion counts."""
    m = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("f"))
    fa = m.groupBy("a").agg(F.sum("f").alias("fa"))
    fb = m.groupBy("b").agg(F.sum("f").alias("fb"))
    n = m.agg(
        F.sum("f").alias("n"),
        (F.sum(F.when(F.col("a") == F.col("b"), F.col("f")).otherwise(0)) / F.sum("f")).alias("po"),
        (F.sum(F.abs(F.col("a") - F.col("b")) * F.col("f")) / F.sum("f")).alias("wo"))
    same = fa.join(fb, F.col("a") == F.col("b")).agg(F.sum(F.col("fa") * F.col("fb")).alias("pe"))
    # sum |i - j| fa fb from the cumulated marginals, so codes are never crossed
    codes = fa.select(F.col("a").alias("c"), "fa").join(
        fb.select(F.col("b").alias("c"), "fb"), "c", "full").na.fill(0).withColumn(
        "one", F.lit(1))
    cum = scan(codes, ["one"], ["c"], chunk_of("c", 4096), ca=("sum", "fa"), cb=("sum", "fb"),
               nxt=("lead", "c"))
    tot = codes.agg(F.sum("fa").alias("ta"), F.sum("fb").alias("tb"))
    gap = F.coalesce(F.col("nxt") - F.col("c"), F.lit(0))
    we = cum.crossJoin(F.broadcast(tot)).agg(F.sum(gap * (
        F.col("ca") * (F.col("tb") - F.col("cb")) + F.col("cb") * (F.col("ta") - F.col("ca"))
    )).alias("we"))
    nn = F.col("n") * F.col("n")
    return n.crossJoin(same).crossJoin(we).select(
        "n", ((F.col("po") - F.col("pe") / nn) / (1 - F.col("pe") / nn)).alias("kappa"),
        (1 - F.col("wo") / (F.col("we") / nn)).alias("weighted_kappa"))


def event_note_rows(
    score: DataFrame, played: DataFrame, keys: Sequence[str], event: str
) -> DataFrame:
    """Note rows of paired events: equal pitches match one to one, the rest are deletions and
    insertions. The n-th note of a pitch on one side meets the n-th on the other."""
    from pyspark.sql import Window as W

    k = [*keys, event, "pitch"]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(*k).orderBy("note_id")  # one pitch of one event
        return df.select(*k, F.col("note_id").alias(name), F.row_number().over(w).alias("__r"))

    j = numbered(score, "s_id").join(numbered(played, "p_id"), [*k, "__r"], "full")
    lab = F.when(F.col("p_id").isNull(), "deletion").when(
        F.col("s_id").isNull(), "insertion").otherwise("match")
    return j.select(*keys, event, lab.alias("label"), "s_id", "p_id")


def choose_reading(readings: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best of all readings by Dice ratio 2m / (s + p), ties to the smaller reading.

    ``readings``: keys, ``reading``, ``n_score``, ``n_played``; ``matches``: keys, ``reading``,
    ``n_match``.
    """
    keys = list(keys)
    c = readings.join(matches, [*keys, "reading"], "left")
    dice = 2 * F.coalesce("n_match", F.lit(0)) / (F.col("n_score") + F.col("n_played"))
    best = c.withColumn("dice", dice).groupBy(*keys).agg(
        F.min(F.struct((-F.col("dice")).alias("d"), "reading")).alias("b"))
    return best.select(*keys, F.col("b.reading").alias("reading"), (-F.col("b.d")).alias("dice"))


def place_marks(
    marks: DataFrame, passes: DataFrame, notes: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Put marks given by measure name and offset on every pass of that measure.

    ``marks``: keys, ``mark_id``, ``measure``, ``offset``; ``passes``: keys, ``measure``,
    ``start``; ``notes``: keys, ``pos``. One row per pass: the position and whether a note starts
    there; a mark whose measure is never played is one row ``unmapped``.
    """
    keys = list(keys)
    on = notes.select(*keys, "pos").distinct().withColumn("__n", F.lit(True))
    j = marks.join(passes.select(*keys, "measure", "start"), [*keys, "measure"], "left")
    j = j.withColumn("pos", F.col("start") + F.col("offset")).join(on, [*keys, "pos"], "left")
    out = F.when(F.col("start").isNull(), "unmapped").when(F.col("__n"), "on_note").otherwise(
        "off_onset")
    return j.select(*keys, "mark_id", "pos", out.alias("outcome"))


def commonest_offset(df: DataFrame, keys: Sequence[str], offset: str) -> DataFrame:
    """Most frequent offset per key; the smallest on ties."""
    n = df.groupBy(*keys, offset).agg(F.count("*").alias("n"))
    best = n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), offset)).alias("b"))
    return best.select(*keys, F.col(f"b.{offset}").alias(offset), (-F.col("b.m")).alias("n"))


def local_onset_error(
    df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], resid_ms: str, chunk: Column,
    *, half: int = 10, min_periods: int = 5,
) -> DataFrame:
    """Onset errors after removing a centred running median: robust SD, clipped rms, p90 of the
    absolute value and the share above 30 ms."""
    from ritardo.operators.ordered import CHUNK
    from ritardo.operators.quantiles import exact_quantiles
    from ritardo.operators.sequences import frame_halo, running_index

    keys = list(keys)
    halo, w = frame_halo(running_index(df, keys, order, chunk), keys, "idx", half, half)
    med = F.percentile(resid_ms, 0.5).over(w)
    d = halo.withColumn("__l", F.when(F.count(resid_ms).over(w) >= min_periods, F.col(
        resid_ms) - med)).where("__home").drop("__home", CHUNK)
    d = d.where("__l is not null").withColumn("__a", F.abs("__l"))
    clipped = F.least(F.greatest("__l", F.lit(-100.0)), F.lit(100.0))
    a = d.groupBy(*keys).agg(F.sqrt(F.avg(clipped * clipped)).alias("local_rms_ms"), F.avg(
        (F.col("__a") > 30).cast("int")).alias("share_gt30"))
    q = exact_quantiles(d, keys, "__a", {"p90_abs_ms": 0.9})
    sd = robust_sd(d, keys, "__l", "local_rsd_ms").select(*keys, "local_rsd_ms")
    return a.join(q, keys).join(sd, keys)
