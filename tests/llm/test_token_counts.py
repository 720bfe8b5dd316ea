import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ritardo.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a   b", "you're I've we'll don't it's 're", "x!'re", "  ", "\t\t x", "<|endoftext|>",
       "hi <|endoftext|>  there<|endo", "a  <|endoftext|><|endoftext|>b", "é🙂日本語", "\x1c\x1d a\x85\xa0 b",
       "12345 67a8", "'ll've", "foo\r\nbar", "zzzzzzzzzzzz aaaaaaaaaaa", "x" * 3000]
BITS = ["a", "e", "th", " ", "  ", "\n", "'", "re", "s", "!", "é", "1", "<|endoftext|>", "\t", "\xa0",
        "ing", "🙂", "-", "ll", "日", "\x1c", "\x85"]


def test_every_prefix_against_library():
    lib = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        m = tc.PrefixModel(f.read())
    rnd = random.Random(1)
    for x in ODD[:-1] + ["".join(rnd.choices(BITS, k=rnd.randrange(1, 14))) for _ in range(500)]:
        want = [len(lib.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        assert m.at_prefixes(x) == want, x


def test_documents_against_library(docs_of, sf_rows):
    lib = Tokenizer.from_file(PATH)
    rows = [(r[0], r[1]) for r in sf_rows] + [(None, "a b"), (None, None), (7, ""), (7, "")] + [
        (10**6 + i, t) for i, t in enumerate(ODD)] + [(1, "word " * 60000)]
    df = docs_of(rows, n_tokens=F.lit("x"), n_bytes=F.lit(0))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tc.count_tokens(df, PATH).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(lib.encode(
        t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tc.count_tokens(docs_of([]), PATH).count() == 0


def test_budget(docs_of):
    df = tc.prefix_counts(docs_of([(1, "hello there world"), (2, None), (3, "")]), PATH)
    got = {r.doc_id: r.n for r in df.select(
        "doc_id", tc.fitting_prefix(F.col("prefix_tokens"), 2).alias("n")).collect()}
    assert got == {1: len("hello there"), 2: None, 3: 0}
