"""SimHash near-duplicates by tables of Hamming distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ritardo.llm.common import row_key, stored
from ritardo.llm.components import components

BLOCKS = 32  # two bits each
GROUPS = 4  # of eight blocks
SMALL_BUCKET = 64  # candidates of a bucket are paired up to here; larger ones meet at midpoints
BANDS, ROWS = 18, 7  # keys of least hashes, and hashes a key
PART = 1024  # members of a large bucket that meet the others, or their centre, in one task
ROUNDS = 4  # centres of a large bucket, one after the other; at the last one all that is left meets
RADIUS = 20  # bits in which texts at 0.8 may differ: 9.7 are expected, deviation 2.9


def fingerprint(data: bytes | None, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of word shingles; no words give 0, few words one shingle."""
    # bytes.lower() changes A-Z alone, and bytes.split() cuts at x20 and x09-x0D
    words = data.lower().split() if data else []
    if not words:
        return 0
    n, text = max(len(words) - shingle + 1, 1), b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:n - 1] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join(
        [digest(text[a:b], seed) for a, b in zip(first, last, strict=True)]), np.uint8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 8 << 15):  # bounded memory for any length
        ones += np.unpackbits(raw[at:at + (8 << 15)].reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([fingerprint(x, shingle) for x in p], dtype="int64")

    return run(text.cast("binary"))


def references() -> list[int]:
    """Zero, and each block's two bits: 33 pivots (signed)."""
    return [0, *[int(np.uint64(3 << (2 * b)).astype(np.int64)) for b in range(BLOCKS)]]


def pivot_table(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """``pivots``: the Hamming distances of a fingerprint to all references."""
    return fps.withColumn("pivots", F.array(*[
        F.bit_count(F.col(fp).bitwiseXOR(F.lit(r).cast("bigint"))).cast("tinyint")
        for r in references()]))


def _bucket_keys() -> Column:
    """Two of four groups of pivot coordinates, as one number each: six keys.

    With d0 the distance to zero and db that to block b, (d0 + 2 - db) / 2 is the block's number
    of ones. Fingerprints within two bits differ in two blocks at most, hence agree on all
    coordinates of two groups at least.
    """
    per = BLOCKS // GROUPS

    def packed(g: int) -> Column:
        d0, out = F.col("pivots")[0].cast("bigint"), F.lit(0).cast("bigint")
        for b in range(g * per, (g + 1) * per):
            out = out * 4 + F.shiftright(d0 + 2 - F.col("pivots")[b + 1], 1)
        return out

    side = [packed(g) for g in range(GROUPS)]
    return F.array(*[F.lit(i << 40).cast("bigint") + side[a] * (1 << 16) + side[b]
                     for i, (a, b) in enumerate(combinations(range(GROUPS), 2))])


def near_links(fps: DataFrame, distance: int = 2, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within ``distance`` (up to 2) bits.

    Fingerprints whose pivot coordinates agree on two of four groups share a bucket; no pair
    within the distance is missed. In buckets of up to ``small_bucket`` members, pairs are formed,
    dropped where some coordinate differs by more than the distance, and verified by Hamming
    distance. Members of larger buckets are never paired: each gives its fingerprint and those one
    bit away, and all that give the same point lie within two bits of each other, so the least of
    them is linked to the rest. That is linear, and keeps every connection (at distance 2).
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    if distance < 2:
        small_bucket = 1 << 62  # midpoints prove two bits only
    t = pivot_table(fps.select("fp").distinct())
    keys = stored(t.select("fp", "pivots", F.explode(_bucket_keys()).alias("bucket")), "buckets")
    sizes = stored(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    held = keys.join(sizes.where(F.col("n") <= small_bucket).select("bucket"), "bucket")
    a = held.select("bucket", F.col("fp").alias("a"), F.col("pivots").alias("pa"))
    b = held.select("bucket", F.col("fp").alias("b"), F.col("pivots").alias("pb"))
    apart = F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)))
    pairs = a.join(b, "bucket").where("a < b").where(apart <= distance).where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
    big = keys.join(sizes.where(F.col("n") > small_bucket).select("bucket"), "bucket").select(
        "fp").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[
        F.lit(int(np.uint64(1 << i).astype(np.int64))).cast("bigint") for i in range(64)])
    points = stored(big.select("fp", F.explode(F.transform(
        flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("point")), "points")
    least = points.groupBy("point").agg(F.min("fp").alias("a"))
    met = points.join(least, "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, key, fp, root (least fingerprint of the group), component_id.

    ``component_id`` is the smallest id of the documents reachable over links, itself included.
    Exact copies are one fingerprint from the start. Null, empty and blank texts have no words and
    fingerprint 0, and are linked like any other. Null ids take the id of their group, if it has
    one. Repeated rows stay, with equal results; an empty table gives none; extra columns are
    ignored.
    """
    f = stored(docs.select(
        F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"),
        fingerprints(F.col(text_col), shingle).alias("fp")), "fingerprints")
    fps = stored(f.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(near_links(fps, distance), "a", "b")
    placed = fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "roots")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(named, "root").select("fp", "root", "component_id")
    return f.join(of, "fp").select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each group the row of the smallest id stays.

    Null ids come last; equal ids are told apart by the row key, and of equal rows one stays.
    """
    near = near_duplicates(docs, shingle, distance, id_col, text_col)
    return _least_of_groups(docs, near, id_col, text_col)


def _least_of_groups(docs: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    best = near.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("x"))
    best = stored(best.select(F.col("x.key").alias("__key")), "kept")
    d = docs.withColumn("__key", row_key(id_col, text_col))
    kept = d.join(best, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")


def _hashes(data: bytes | None, shingle: int, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 values of the word shingles; no words are one empty shingle."""
    words = data.lower().split() if data else []
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[:max(len(words) - shingle, 0)] + 1).tolist()]
    last = ends[min(shingle, len(words)) - 1:].tolist() if words else [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[a:b], seed) for a, b in zip(
        first, last, strict=True)], np.uint64))


def _majority(h: np.ndarray) -> int:
    """Signed SimHash of distinct hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):  # bounded memory for any length
        ones += np.unpackbits(h[at:at + (1 << 15)].astype(">u8").view(np.uint8).reshape(
            -1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


@lru_cache
def _permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and shifts of the permutations, and the factors that mix a band's values."""
    rng = np.random.default_rng(11)
    odd, plus = rng.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
    return odd * 2 + 1, plus, rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * 2 + 1


def _band_keys(h: np.ndarray) -> np.ndarray:
    """One key a band, of the least values of its ROWS permutations of the hashes."""
    odd, plus, mix = _permutations()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):  # bounded memory for any length
        v = h[at:at + 1024, None] * odd + plus
        least = np.minimum(least, v.min(axis=0))
    return (least.reshape(BANDS, ROWS) * mix).sum(axis=1, dtype=np.uint64)


def _sketches(text: Column, shingle: int) -> Column:
    """Per text: fingerprint of its distinct shingles, their number, band keys, as one array."""

    @F.pandas_udf("array<bigint>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            out = []
            for x in p:
                h = _hashes(x, shingle)
                out.append(np.concatenate([np.array([_majority(h), len(h)], np.int64),
                                           _band_keys(h).view(np.int64)]))
            yield pd.Series(out, dtype=object)

    return run(text.cast("binary"))


def _shingle_sets(text: Column, shingle: int) -> Column:
    """Distinct shingles as 32-bit numbers."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([np.unique((_hashes(x, shingle) >> np.uint64(32)).astype(
                np.uint32)).view(np.int32) for x in p], dtype=object)

    return run(text.cast("binary"))


def _band_pairs(nodes: DataFrame, small_bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a < b) of nodes that share a band's key: all pairs of a bucket of up to
    ``small_bucket``; the members of a larger one with its centre, the member whose buckets hold
    most members in all (the text that the others were copied from meets most of them). Also the
    members of the larger ones, whose other pairs are ``_pairs_apart``."""
    keys = stored(nodes.select("node", F.posexplode("bands").alias("band", "bucket")), "bands")
    sizes = keys.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(keys.join(sizes, ["band", "bucket"]), "held")
    small, big = held.where(F.col("n") <= small_bucket), held.where(F.col("n") > small_bucket)
    a = small.select("band", "bucket", F.col("node").alias("a"))
    b = small.select("band", "bucket", F.col("node").alias("b"))
    pairs = a.join(b, ["band", "bucket"]).where("a < b").select("a", "b")
    score = big.groupBy("node").agg(F.sum("n").alias("score"))
    ranked = big.join(score, "node")
    centre = ranked.groupBy("band", "bucket").agg(
        F.max(F.struct("score", "node")).alias("top")).select(
        "band", "bucket", F.col("top.node").alias("centre"))
    stars = big.join(centre, ["band", "bucket"]).where("node <> centre").select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    return pairs.unionByName(stars).distinct(), ranked.select("band", "bucket", "node", "score")


def _across(rows: DataFrame, k: list[str]) -> DataFrame:
    """Pairs (x, y) of rows of one key but different roots, at least one of them near, each once.

    Members of the root that most of a key has meet only those of other roots. The other side comes
    in parts of about ``PART`` rows.
    """
    size = rows.groupBy(*k, "root").agg(F.count("*").alias("m"), F.max("near").alias("near")).groupBy(
        *k).agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("all"), F.max(
            "near").alias("any")).where((F.col("all") > F.col("top.m")) & F.col("any")).select(
        *k, F.col("top.root").alias("most"), F.ceil(F.col("all") / PART).alias("parts"))
    held = stored(rows.join(size, k), "apart")
    one = F.struct("node", "root", "n", "inside", "near")
    x = held.where("root <> most").select(*k, one.alias("x"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    y = held.select(*k, one.alias("y"), (F.col("root") == F.col("most")).alias("main"),
                    F.pmod(F.xxhash64("node"), "parts").alias("part"))
    return x.join(y, [*k, "part"]).where("x.root <> y.root and (x.near or y.near) and "
                                         "(main or x.node < y.node)").drop("main", "part")


def _beside_centres(left: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the centre of their bucket (the best text that most of them meet in any bucket, so
    that the buckets of one group have one), and per (centre, node) the size ``n`` of its set, how much
    of it lies ``inside`` what a quarter of some 64 members hold, and what lies ``outside``."""
    k = ["band", "bucket"]
    top = left.groupBy(*k).agg(F.max(F.struct("score", "node")).alias("top"))
    top = stored(left.join(top, k), "tops")
    hub = top.groupBy("node").agg(F.max("top").alias("hub"))
    centre = top.join(hub, "node").groupBy(*k, "hub").count().groupBy(*k).agg(
        F.max_by("hub.node", F.struct("count", "hub")).alias("centre"))
    left = stored(left.join(centre, k), "left")
    met = left.select("centre", "node").distinct()
    size = met.groupBy("centre").agg(F.count("*").alias("m"))
    x = stored(met.join(size, "centre").join(sets, "node"), "beside")
    # any reference set gives right bounds, so a few members will do
    some = x.where(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / 64)) == 0)
    held = some.select("centre", F.explode("s").alias("member")).groupBy("centre", "member").count()
    common = held.join(some.groupBy("centre").agg(F.count("*").alias("of")), "centre").where(
        "4 * count > of").groupBy("centre").agg(F.collect_list("member").alias("sc"))
    parts = size.join(common, "centre", "left").select(
        "centre", F.coalesce("sc", F.array().cast("array<int>")).alias("sc"), F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.ceil(F.col("m") / PART) - 1)).alias("part"))
    out = x.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / PART))).join(
        parts, ["centre", "part"]).select(
        "centre", "node", F.size("s").alias("n"), F.array_except("s", "sc").alias("outside"))
    return left, stored(out.withColumn("inside", F.col("n") - F.size("outside")), "outside")


def _pairs_apart(rows: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of rows of one centre that no links join yet and that may be similar.

    Two sets share no more than the lesser of what each has inside a reference set, and what they share
    outside of it. So pairs either share a member outside, or each lies inside with as much as the two
    must share; which bounds the other's size. Nothing similar is left out.
    """
    def may(share: Column) -> Column:
        return share >= similarity * (F.col("x.n") + F.col("y.n") - share)

    least = F.least("x.inside", "y.inside")
    ends = (F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    shared = _across(rows.select("*", F.explode("outside").alias("member")).drop("outside"),
                     ["centre", "member"])
    # which of two is x may differ by member
    shared = shared.groupBy("centre", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count("*").alias("m")).where(
        may(least + F.col("m"))).select(*ends)
    # the other's size: from similarity * n up to this
    most = F.col("inside") * ((1 + similarity) / similarity) - F.col("n") + 1e-6
    able = rows.drop("outside").withColumn("most_n", most).where(
        F.col("most_n") >= similarity * F.col("n"))
    top = rows.groupBy("centre", "root").agg(F.count("*").alias("m")).groupBy("centre").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"))
    able = stored(able.join(top, "centre"), "able")

    def step(size: Column) -> Column:
        return F.floor(F.log(size) * 100)

    one = F.struct("node", "root", "n", "inside", "near")
    x = able.where("root <> main").select("centre", one.alias("x"), F.explode(F.sequence(
        step(similarity * F.col("n") - 1e-6), step(F.col("most_n")))).alias("step"))
    y = able.select("centre", one.alias("y"), (F.col("root") == F.col("main")).alias("main"),
                    step(F.col("n")).alias("step"))
    inside = x.join(y, ["centre", "step"]).where(
        may(least) & F.expr("x.root <> y.root and (x.near or y.near) and (main or x.node < y.node)"))
    return shared.unionByName(inside.select(*ends)).distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float,
                  radius: int, small_bucket: int, text_col: str) -> DataFrame:
    """Links (a, b) that join all different texts whose shingle sets have ``similarity`` or more
    and that share a band's key.

    Pairs of small buckets and of the members of large ones with their centre come first; then those
    pairs of large buckets that these links have not joined. Those of sizes too far apart, whose pivot
    coordinates differ by more than ``radius`` or whose fingerprints do, are discarded; survivors
    are verified on their sets of shingles.
    """
    t = pivot_table(nodes.select("node", "fp", "n"))
    side = {x: t.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"), F.col("n").alias(
        f"n{x}"), F.col("pivots").alias(f"p{x}")) for x in "ab"}
    apart = F.array_max(F.zip_with("pa", "pb", lambda x, y: F.abs(x - y)))

    def sets_of(need: DataFrame) -> DataFrame:
        need = stored(need.distinct(), "verify")
        texts = docs.select(text_key(text_col).alias("node"), F.col(text_col).alias("text"))
        texts = texts.join(need, "node", "left_semi").groupBy("node").agg(
            F.first("text").alias("text"))
        return stored(texts.select("node", _shingle_sets(F.col("text"), shingle).alias("s")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(side["a"], "a").join(side["b"], "b").where(
            F.least("na", "nb") >= similarity * F.greatest("na", "nb")).where(
            apart <= radius).where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius)
        met = stored(met.select("a", "b"), "survivors")
        sets = sets_of(met.select(F.explode(F.array("a", "b")).alias("node")))
        both = met.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"),
                           (F.size("sa") + F.size("sb")).alias("n"))
        return both.where(F.col("i") >= similarity * (F.col("n") - F.col("i"))).select("a", "b")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    pairs, big = _band_pairs(nodes, small_bucket)
    links, big = stored(verified(pairs), "links"), stored(big, "large")
    if big.isEmpty():
        return links
    roots = components(links, "a", "b")
    k = ["band", "bucket"]
    split = rooted(big, roots).groupBy(*k).agg(
        F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(*k)
    left = stored(big.join(split, k), "split")
    if left.isEmpty():
        return links
    sets = sets_of(left.select("node"))
    for r in range(ROUNDS):
        left, rows = _beside_centres(left, sets)
        if r:  # the first centres' links are there already
            star = rows.where("node <> centre").select(
                F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
            links = stored(links.unionByName(verified(star.distinct())), "links")
            roots = components(links, "a", "b")
        far = 2 * F.col("inside") < F.col("n")
        many = rows.where(far).groupBy("centre").agg(F.count("*").alias("many")).where(
            F.col("many") > (8 * small_bucket if r + 1 < ROUNDS else 1 << 62))
        rows = rows.join(many, "centre", "left").withColumn("near", ~far | F.isnull("many"))
        rows = stored(rooted(rows.drop("many"), roots), "rows")
        links = stored(links.unionByName(verified(_pairs_apart(rows, similarity))), "links")
        left = left.join(rows.where("not near").select("centre", "node"), ["centre", "node"]).drop("centre")
        left = stored(left.join(left.groupBy(*k).count().where("count > 1").select(*k), k), "split")
        if left.isEmpty():
            break
    return links


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.length(text_col), F.col(text_col))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8,
                   radius: int = RADIUS, small_bucket: int = 16, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, key, root; rows of one root are copies at ``similarity`` or more
    of the word shingles' Jaccard measure, directly or over others.

    At that measure fingerprints differ in about a seventh of their bits, too many to be found from
    the fingerprints alone: pairs come from bands of least shingle hashes (a pair at 0.8 shares one
    with a chance of 0.985, one at 0.9 of 0.9999), and pivots, fingerprints and sets discard
    and verify. Equal texts are one node from the start. Null, empty and blank texts are one group.
    Texts of fewer words than a shingle are one shingle. Repeated rows stay, with equal results; an
    empty table gives none; extra columns are ignored.
    """
    f = stored(docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"),
                           text_key(text_col).alias("node"),
                           _sketches(F.col(text_col), shingle).alias("x")), "sketches")
    nodes = f.groupBy("node").agg(F.first("x").alias("x"))
    nodes = stored(nodes.select("node", F.col("x")[0].alias("fp"), F.col("x")[1].alias("n"),
                                F.slice("x", 3, BANDS).alias("bands")), "nodes")
    links = similar_links(docs, nodes, shingle, similarity, radius, small_bucket, text_col)
    roots = components(links, "a", "b")
    return f.join(roots, "node", "left").select(
        "doc_id", "key", F.coalesce("root", "node").alias("root"))


def keep_one_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``keep_one``, of the groups of ``similar_groups``."""
    near = similar_groups(docs, shingle, similarity, id_col=id_col, text_col=text_col)
    return _least_of_groups(docs, near, id_col, text_col)
