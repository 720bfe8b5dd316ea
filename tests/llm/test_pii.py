import hashlib
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from ritardo.llm import pii


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = ["a@b.c@d.e x@y @z.w a@b", "x..%@a-b.c.d.", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.4 0000000001.2.3.4", "1..2.3.4",
         "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (017) 555-7713.", "+12345 678 90( ",
         "é@b.co", "+1+2 345 678 901", "4111  1111111111111111", "", "@@@ a@@b.c", "1" * 40, "a" * 5000 + "@x.y",
         "0.0.0.0", "٣.٣.٣.٣", "a@b.c" * 300, "\U0001f600 4012888888881881 +442079460958 1.1.1.1 q@w.e"]


def test_base_spans_against_brute_force(sf_rows):
    for t in CASES + [r[1] for r in sf_rows if r[1]]:
        assert pii.base_spans(t) == brute_base(t), t[:80]


def test_viterbi_against_all_tag_rows():
    rnd = np.random.default_rng(2)
    m = pii.Crf(rnd.normal(size=(pii.N_FEATURES, pii.K)), rnd.normal(size=(pii.K + 1, pii.K)) + pii.allowed())
    text = "a 1. b@c? +1 22"
    t = pii.tokenise(pii._codes(text), pii.char_classes(), np.zeros(1, np.int64))
    f = pii.features(t)
    got = pii.viterbi(m, f, t.seq)
    for q in range(t.seq[-1] + 1):
        ix = np.flatnonzero(t.seq == q)
        assert len(ix) <= 5

        def score(tags, ix=ix):
            return sum(m.emit[f[i]].sum(axis=0)[k] for i, k in zip(ix, tags, strict=True)) + sum(
                m.move[a, b] for a, b in zip((pii.K, *tags), tags, strict=False))

        want = max(itertools.product(range(pii.K), repeat=len(ix)), key=score)
        assert tuple(got[ix]) == want


def test_training_learns_the_examples_and_keeps_plain_numbers():
    m = pii.train(4 * pii.example_rows())
    classes, rows = pii.char_classes(), pii.example_rows()
    got = pii.soft_spans(m, [t for t, _ in rows], classes)
    hit = sum((s, k + 4, e) in g for (_, want), g in zip(rows, got, strict=True) for s, k, e in want)
    total = sum(len(w) for _, w in rows)
    extra = sum(len(g) for (_, w), g in zip(rows, got, strict=True) if not w)
    assert hit >= 0.9 * total and extra <= 1
    new = pii.soft_spans(m, ["ring (020) 555-1234 after two", "in 1987 there were 14 of them"], classes)
    assert [len(x) for x in new] == [1, 0]


def test_every_example_span_is_found():
    m, rows = pii.train(4 * pii.example_rows()), pii.example_rows()
    got = pii.soft_spans(m, [t for t, _ in rows], pii.char_classes())
    for (text, want), g in zip(rows, got, strict=True):
        assert {(s, k + 4, e) for s, k, e in want} <= set(g), text


def test_skipped_sequences_hold_nothing_plausible(sf_rows):
    """With every sequence decoded, the plausible spans are the same."""
    m, classes = pii.train(4 * pii.example_rows()), pii.char_classes()
    texts = [r[1] for r in sf_rows if r[1]] + [t for t, _ in pii.example_rows()] + [
        "Write AT home to anna at example.org. No more of it.", "(\u0663\u0663\u0663) \u0663\u0663\u0663-\u0663\u0663"]
    for text, spans in zip(texts, pii.soft_spans(m, texts, classes), strict=True):
        t = pii.tokenise(pii._codes(text), classes, np.zeros(1, np.int64))
        tags = pii.viterbi(m, pii.features(t), t.seq)
        want, i = [], 0
        while i < len(tags):
            j = i + 1
            while tags[i] and j < len(tags) and t.seq[j] == t.seq[i] and tags[j] == (tags[i] + 1) // 2 * 2:
                j += 1
            if tags[i]:
                want.append((int(t.start[i]), 4 + (int(tags[i]) + 1) // 2 - 1, int(t.end[j - 1])))
            i = j
        assert [x for x in spans if pii.plausible(x[1], text[x[0]:x[2]])] == [
            x for x in want if pii.plausible(x[1], text[x[0]:x[2]])], text[:80]


def test_documents(docs_of, sf_rows):
    rows = [(r[0], r[1]) for r in sf_rows] + [(10**6 + i, t) for i, t in enumerate(CASES)] + [
        (None, CASES[0]), (1, None), (1, None), (3, "w " * 60000 + "ring (020) 555-1234")]
    df = docs_of(rows, n_ip=F.lit("x"), spans=F.lit(1))
    m = pii.train(pii.labelled_table(df))
    got = pii.scan(df, m).collect()
    want = sorted((str(i), *[sum(k == j for _, k, _ in brute_base(t or "")) for j in range(4)],
                   hashlib.sha256(pii.shown(brute_base(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r[0]), *r[1:6]) for r in got) == want
    text = {i: t for i, t in rows}
    for r in got:
        if r.doc_id is not None and r.doc_id >= 10**6:
            all_ = [x.split(":") for x in r.spans.split(",") if x]
            base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(text[r.doc_id])}
            assert base <= set(r.spans.split(",")) | {""}
            assert [int(x[1]) for x in all_] == sorted(int(x[1]) for x in all_)
    assert pii.scan(docs_of([]), pii.train(pii.labelled_table(docs_of([])))).count() == 0
