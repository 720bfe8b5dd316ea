import zlib

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ritardo.llm import lang_id


def greedy_phrases(seq, texts):
    """Longest matches from each place, found by substring search."""
    n = at = 0
    while at < len(seq):
        end = at + 1
        while end < len(seq) and any(seq[at:end + 1] in t for t in texts):
            end += 1
        at, n = end, n + 1
    return n


def test_phrases_are_longest_matches():
    texts = ["abracadabra cad", "banana bandana", "zz a"]
    m = lang_id.fit_tables({"x": texts}, 10_000)
    codes, n_symbols = m.symbol_map(), lang_id.STRANGE + 1 + len(m.alphabet)
    for t in ["abra", "banana abrac", "qqq", "a", "nab cad ban zz a drab", "Ærøskøbing zz"]:
        s = lang_id.symbols(t, codes)
        b = np.zeros((lang_id.BLOCK, 1), np.int16)
        b[:len(s), 0] = s
        low = "".join(c if c.isalpha() else " " for c in t.lower())
        assert lang_id.phrases(b, m.tables[0], n_symbols)[0] == greedy_phrases(
            " ".join(low.split()), texts), t


def test_held_out_accuracy_and_odd_rows(docs_of):
    rows = duckdb.sql("SELECT doc_id, text, lang FROM "
                      "'/root/testdata/sf0.01/documents.parquet'").fetchall()
    odd = [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 +", "fr"), (None, "the of and", "de"),
           (10**6 + 3, "日本" * 300, None), (10**6 + 4, "日本", None), (5, "thing and the", "en"), (5, "thing and the", "en"),
           (10**6 + 5, "the " * 100_000, None)]
    df = docs_of(rows + odd, lang_pred=F.lit(1), h=F.lit("x"), n=F.lit(0))
    m = lang_id.fit(df)
    assert set(m.languages) == {"en", "de", "fr", "es"}
    d = df.select("doc_id", "text", F.col("lang").alias("truth"), lang_id.held_out("doc_id").alias("o"))
    got = lang_id.predict(d, m).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.o == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.o and r.doc_id is not None and r.doc_id < 10**6]
    assert np.mean([r.lang_pred == r.truth for r in held]) > 0.97
    assert np.mean([r.fits for r in held]) == 1
    by = {r.doc_id: r for r in got}
    assert [by[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3
    assert not by[10**6 + 3].fits and by[10**6 + 4].fits and by[10**6 + 5].lang_pred == "en"


def test_sample_is_of_distinct_texts_in_order_of_hash(docs_of, monkeypatch):
    """An id or a text that repeats comes to the driver once, and texts are learned in order of hash."""
    rows = [(i, f"text number {'abcdefghij'[i % 10] * (1 + i // 10)}", "en") for i in range(60)]
    df = docs_of(rows + [(1, "one and the same", "en")] * 50 + [(i, "one and the same", "en") for i in range(60)])
    seen = []
    monkeypatch.setattr(lang_id, "fit_tables", lambda samples, *_: seen.append(samples))
    lang_id.fit(df, max_docs=20)
    d = df.where(~lang_id.held_out("doc_id")).withColumn("x", F.xxhash64("text")).withColumn(
        "h", F.xxhash64("doc_id", "x"))
    least = {}
    for r in d.collect():
        least[r.text] = min((r.h, r.x), least.get(r.text, (r.h, r.x)))
    assert seen[0]["en"] == sorted(least, key=least.get)[:20]


def test_labels_are_no_inputs(docs_of):
    """A held-out row's label, source and id do not change its prediction."""
    rows = [(i, "the thing and of", "en") for i in range(40)] + [
        (i, "der und die ein", "de") for i in range(40, 80)]
    m = lang_id.fit(docs_of(rows))
    got = lang_id.predict(docs_of([(1, "die und", "en"), (2, "die und", None)]), m).collect()
    assert {r.lang_pred for r in got} == {"de"} and len({r.score for r in got}) == 1


def test_nothing_learned(docs_of):
    assert lang_id.fit(docs_of([])).languages == []
    got = lang_id.predict(docs_of([(1, "abc")]), lang_id.fit(docs_of([(1, "abc")]))).first()
    assert (got.lang_pred, got.score, got.fits) == ("und", 0.0, False)
    one = lang_id.fit_tables({"en": ["abc"]})
    p = lang_id._predict_batch(one, one.symbol_map(), pd.Series(["abc", "1"]))
    assert list(p.lang_pred) == ["en", "und"] and list(p.score) == [1.0, 0.0]
