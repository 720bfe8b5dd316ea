import re

from pyspark.sql import functions as F

from ritardo.llm import licenses

TEXT = {r: t for r, _, t in licenses.NOTICES}


def brute(text, gap=licenses.GAP):
    """(rules, number of known sentences) of a text."""
    rs = licenses.rules()
    ids = {x for _, _, s in rs for x in s}
    got, n = set(), 0
    for view, end in enumerate((licenses.LINE_END, licenses.WRAPPED_END)):
        parts = re.split(end, text or "")
        seq = {p: licenses.normalised(s) for p, s in enumerate(parts) if licenses.normalised(s) in ids}
        n += sum(view == 0 or "\n" in parts[p] for p in seq)

        def chain(need, pos, seq=seq):
            return not need or any(seq.get(p) == need[0] and chain(need[1:], p)
                                   for p in range(pos + 1, pos + gap + 1))

        for rule, _, s in rs:
            if any(x == s[0] and chain(s[1:], p) for p, x in seq.items()):
                got.add(rule)
    return ",".join(sorted(got)), n


def cases():
    out = [None, "", "no licence here.", *TEXT.values()]
    mit = re.sub(r"\s+", " ", TEXT["mit-text"])
    out += [mit, "Foo\n\n" + TEXT["mit-text"] + "\nbar", mit.replace("The above", "Alpha. Beta. The above"),
            mit.replace("The above", "A. B. C. D. The above"), mit * 3,
            " ".join(reversed(mit.split(". "))), "Copyright 2020. Released under the MIT license!",
            TEXT["bsd-3-text"].replace("Neither", "x. " * 9 + "Neither"),
            "word " * 50000 + "\nLicensed under CC BY-NC 4.0.", "Licensed under\nCC BY-NC 4.0."]
    return out


def test_against_brute_force(docs_of):
    rows = list(enumerate(cases())) + [(0, None), (None, TEXT["cc-by-4"]), (5, cases()[5])]
    got = licenses.scan(docs_of(rows, view=F.lit(1), sid=F.lit("x"), licenses=F.lit(2))).collect()
    assert sorted((str(r.doc_id), ",".join(r.rules), r.n_sentences) for r in got) == sorted(
        (str(i), *brute(t)) for i, t in rows)
    found = {r.doc_id: r.rules for r in got}
    assert found[3] == ["mit-text"] and "bsd-2-text" in found[9]


def test_empty_table(docs_of):
    assert licenses.scan(docs_of([])).count() == 0


def test_rules_from_a_table(spark, docs_of):
    notices = spark.createDataFrame(
        [("house", "House", "You may read this. You may not\nsell it."), ("none", "None", None),
         ("two", "Two", "You may read this.")], "rule string, license string, text string")
    docs = docs_of([(1, "# You may read this.\n#\n# You may not sell\n# it.\n"),
                    (2, "You may read this. a. b. c. d. You may not sell it."), (3, TEXT["mit-text"])])
    got = {r.doc_id: r.rules for r in licenses.scan(docs, notices=notices).collect()}
    assert got == {1: ["house", "two"], 2: ["two"], 3: []}
