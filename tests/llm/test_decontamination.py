import random

from brute import brute_contaminated
from pyspark.sql import functions as F

from ritardo.llm import decontamination as dc

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def test_against_brute_force(spark, docs_of):
    rnd = random.Random(7)
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.choice([3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (53, items[5][1]), (3, items[3][1]), (54, "a " * 40),
              (None, " ".join(WORDS)), (55, "ÉCOLE école " * 7)]
    docs = []
    for i in range(60):
        w = rnd.choices(WORDS, k=rnd.randrange(0, 80))
        for _ in range(rnd.randrange(3)):
            t = rnd.choice(items)[1] or ""
            at = rnd.randrange(len(w) + 1)
            w[at:at] = t.upper().split() if rnd.random() < 0.3 else t.split()
        docs.append((i, rnd.choice([" ", ", ", "\n", "- "]).join(w)))
    docs += [(100, None), (100, None), (None, items[0][1]), (101, ""), (102, "a " * 30000),
             (103, items[9][1]), (103, items[9][1]), (103, "other"), (104, "école ÉCOLE " * 8),
             (105, "." + items[6][1] + "!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("p", F.lit(1))
    df = docs_of(docs, pos=F.lit(1), term=F.lit("x"), key=F.lit(3), n_words=F.lit(0))
    for limit in (dc.SMALL, 1):
        dc_small, dc.SMALL = dc.SMALL, limit
        try:
            spans, rows = dc.phrase_matches(df, bench, small_limit=limit)
            out = dc.contamination(df, bench).collect()
        finally:
            dc.SMALL = dc_small
        assert rows.count() == len(docs) and spans.count() > 0
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in out)
        want = []
        for i, t in docs:
            n, hit, which = brute_contaminated(t, items)
            want.append((str(i), n, hit, ",".join(sorted(str(x) for x in which if x is not None)),
                         hit > 0 and 20 * hit >= n))
        assert got == sorted(want)


def test_proximity_finds_passages_with_words_put_in(spark, docs_of):
    item = "one two three four five six seven eight nine ten unusual twelve end"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    common = item.replace("two ", "").replace("unusual ", "")  # two and unusual stay the rarest
    df = docs_of([(1, item), (2, item.replace("six", "six x y")), (3, "unusual two"),
                  (4, item.replace("six", "six " + "x " * 9)), (5, common), (6, common), (7, common)])
    exact, _ = dc.phrase_matches(df, bench)
    near, _ = dc.phrase_matches(df, bench, gap=3)
    assert {r.doc_id for r in exact.collect()} == {1}
    assert {r.doc_id for r in near.collect()} == {1, 2}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.contamination(docs_of([]), none).count() == 0
    got = dc.contamination(docs_of([(1, "a b")]), none).first()
    assert (got.n_words, got.n_hit, got.contaminated) == (2, 0, False)
