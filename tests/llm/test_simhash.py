import random

import pytest
from brute import brute_fp, brute_groups, brute_shingles, brute_similar, brute_similar_groups
from pyspark.sql import functions as F

from ritardo.llm import simhash
from ritardo.llm.components import components


def test_all_documents_against_brute_force(spark, docs_of, sf_rows):
    extra = [(None, "A b C d"), (900001, None), (900002, ""), (900003, " \t"), (900004, "É b"),
             (900005, "a B c D"), (900005, "a B c D"), (900006, "x " * 30000)]
    rows = [(r[0], r[1]) for r in sf_rows] + extra
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(zip((str(r[0]) for r in rows), fps, map(str, brute_groups(
        [r[0] for r in rows], fps)), strict=True))
    df = docs_of(rows, key=F.lit(1), fp=F.lit("clash"), component_id=F.lit(None).cast("string"))
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fp, str(r.component_id)) for r in got) == want
    left = simhash.keep_one(df)
    assert left.columns == df.columns
    assert left.count() == len({(r.root) for r in got})


@pytest.mark.parametrize("small", [64, 2])
def test_links_of_close_fingerprints(spark, small):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    base = rnd.getrandbits(64)
    for _ in range(80):  # a dense group, and chains
        fps.append(base ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    for i in range(12):
        fps.append(fps[i] ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    fps = list(dict.fromkeys(f - (1 << 64) if f >> 63 else f for f in fps))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    root = {r.node: r.root for r in components(simhash.near_links(df, 2, small), "a", "b").collect()}
    assert [root.get(f, f) for f in fps] == brute_groups(fps, fps)


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_one(docs_of([])).count() == 0
    assert simhash.similar_groups(docs_of([])).count() == 0
    assert simhash.keep_one_similar(docs_of([])).count() == 0


def changed(rnd, text, share):
    words = text.split()
    for _ in range(int(len(words) * share) + 1):
        words[rnd.randrange(len(words))] = f"zq{rnd.randrange(10**6)}"
    return " ".join(words)


def test_similar_groups_against_brute_force(spark, docs_of, sf_rows):
    extra = [(None, "A b C d"), (900001, None), (900002, ""), (900003, " \t"), (900004, "É b"),
             (900005, "a B c D"), (900005, "a B c D"), (900006, "x " * 30000)]
    rows = [(r[0], r[1]) for r in sf_rows] + extra
    want = brute_similar_groups([t for _, t in rows])
    df = docs_of(rows, key=F.lit(1), node=F.lit("clash"), root=F.lit(None).cast("string"))
    got = simhash.similar_groups(df).collect()
    assert len(got) == len(rows)
    root = {r.doc_id: r.root for r in got}
    groups = {}
    for (i, _), c in zip(rows, want, strict=True):
        groups.setdefault(c, set()).add(root[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len({r.root for r in got}) == len(groups)
    left = simhash.keep_one_similar(df)
    assert left.columns == df.columns and left.count() == len(groups)


def test_recall_on_planted_copies(spark, docs_of, sf_rows):
    rnd = random.Random(3)
    base = [r for r in sf_rows if r[1] and 120 <= len(r[1].split()) <= 2000]
    rows, planted, hub = [(r[0], r[1]) for r in sf_rows], [], []
    for k in range(300):  # copies of many texts
        i, t = rnd.choice(base)[:2]
        rows.append((10**6 + k, changed(rnd, t, rnd.choice([.01, .015, .02, .024]))))
        planted.append((i, t, *rows[-1]))
    i, t = base[0][:2]
    for k in range(400):  # many copies of one text, most of them farther from each other than 0.8
        rows.append((2 * 10**6 + k, changed(rnd, t, .018)))
        hub.append((i, t, *rows[-1]))
    root = {r.doc_id: r.root for r in simhash.similar_groups(docs_of(rows)).collect()}
    for group in (planted, hub):
        near = [(a, b) for a, t, b, u in group
                if brute_similar(brute_shingles(t), brute_shingles(u)) >= 0.8]
        assert len(near) > 50
        assert sum(root[a] == root[b] for a, b in near) >= 0.97 * len(near)
    size = {}
    for i, t in rows[:len(sf_rows)]:  # clean texts stay apart
        size.setdefault(root[i], []).append(t)
    for texts in size.values():
        assert all(max(brute_similar(brute_shingles(t), brute_shingles(u)) for u in texts[:1] + [
            x[3] for x in planted + hub]) >= 0.8 for t in texts[1:])


def test_large_buckets_lose_no_link(spark, docs_of):
    """All texts share every bucket; two groups are similar within and not to the bucket's centre."""
    words = [[f"{g}{i}" for i in range(60)] for g in "abc"]
    texts = [" ".join([*w, *[f"tail{j}"] * (j > 0)]) for w in words[:2] for j in range(4)] + [
        " ".join(words[2])]
    docs = docs_of(list(enumerate(texts)))
    nodes = docs.select(simhash.text_key("text").alias("node"), simhash._sketches(
        F.col("text"), 5).alias("x")).select(
        "node", F.lit(0).cast("bigint").alias("fp"), F.col("x")[1].alias("n"),
        F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("bands"))
    key = {r.node: r.doc_id for r in docs.select("doc_id", simhash.text_key("text").alias("node")).collect()}
    for part in (2, 1024):
        simhash.PART, kept = part, simhash.PART
        try:
            links = simhash.similar_links(docs, nodes, 5, 0.8, 20, 2, "text").collect()
        finally:
            simhash.PART = kept
        group = list(range(9))
        for _ in group:
            for r in links:
                x, y = key[r.a], key[r.b]
                group[x] = group[y] = min(group[x], group[y])
        assert group == [0] * 4 + [4] * 4 + [8]


def test_large_buckets_compare_no_square(spark, docs_of, monkeypatch):
    """300 texts of one bucket, each at 0.74 to the first and less to each other, and two pairs of
    them that are similar: few pairs are verified, and those two are found."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words)]
    for k in range(300):
        at = rnd.sample(range(5, 145, 7), 5)
        texts.append(" ".join(f"x{k}_{i}" if i in at else w for i, w in enumerate(words)))
    texts += [f"{texts[7]} end", f"{texts[90]} end"]
    docs = docs_of(list(enumerate(texts)))
    nodes = docs.select(simhash.text_key("text").alias("node"), simhash._sketches(
        F.col("text"), 5).alias("x")).select(
        "node", F.lit(0).cast("bigint").alias("fp"), F.col("x")[1].alias("n"),
        F.array(F.lit(1).cast("bigint")).alias("bands"))
    key = {r.node: r.doc_id for r in docs.select("doc_id", simhash.text_key("text").alias("node")).collect()}
    kept, rows = simhash.stored, []

    def counted(df, name):
        out = kept(df, name)
        if name == "survivors":
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    links = simhash.similar_links(docs, nodes, 5, 0.8, 20, 2, "text").collect()
    assert {frozenset((key[r.a], key[r.b])) for r in links} == {frozenset((7, 301)), frozenset((90, 302))}
    assert sum(rows) < 5 * len(texts)
