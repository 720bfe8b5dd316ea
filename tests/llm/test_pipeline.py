import public_tokenizers
import sentencepiece
from brute import brute_contaminated, brute_similar_groups, brute_spans

import __spark_entry__ as entry
import corpus_pipeline as cp
from ritardo.llm import lang_id, secrets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    odd = [(900001, None, None, None, None), (900002, "123 456", "en", "s", 7), (None, "the end of it", "en", "s", 13),
           (900003, bench[0][1] + " tail", "en", "s", 1), (900004, "password = hunter2hunter2 é", "en", "s", 1),
           (900004, "password = hunter2hunter2 é", "en", "s", 1), (900005, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = [tuple(r) for r in docs.collect()]
    model = lang_id.fit(docs)
    fits = lang_id._predict_batch(model, model.symbol_map(), __import__("pandas").Series([r[1] for r in rows]))["fits"]
    kept = [r for r, ok in zip(rows, fits, strict=True) if ok]
    assert 900001 not in {r[0] for r in kept} and 900002 not in {r[0] for r in kept}
    group = {}
    for r, c in zip(kept, brute_similar_groups([r[1] for r in kept]), strict=True):
        group.setdefault(c, []).append(r)
    assert len(group) < len({r[1] for r in kept})  # copies of other texts are there
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in group.values()]
    clean = []
    for r in kept:
        n, hit, _ = brute_contaminated(r[1], bench)
        if not (hit and 20 * hit >= n):
            clean.append(r)
    assert 900003 not in {r[0] for r in clean}
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(cp.MODEL))
    want = {}
    for r in clean:
        text, at = [], 0
        for s, _, e in brute_spans(r[1], secrets.SCOPE):
            if s >= at:
                text += [r[1][at:s], "[SECRET]"]
            at = max(at, e)
        text = "".join(text) + r[1][at:]
        want[r[0]] = (text, r[2], r[3], len(text), p.encode(text), True)
    df = docs
    for name, stage in cp.STAGES:
        out = stage(spark, df, SF)
        if name != cp.STAGES[-1][0]:
            assert out.columns == list(cp.COLUMNS), name
            out = cp.stored(out, name)
        df = out
    got = {r.doc_id: (p.decode(r.ids), r.lang, r.source, r.n_chars, r.ids, r.round_trip) for r in df.collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == want[i], i


def test_registered_and_whole(spark):
    assert entry.queries()["pipeline"] is cp.run and 4 <= len(cp.STAGES) <= 5
    out = cp.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0.3 * n < out.count() <= n
