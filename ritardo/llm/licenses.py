"""Licence recognition: sentences to known identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ritardo.llm.common import row_key, stored

# Licence notices as their licensors publish them. (rule, licence, text)
NOTICES = (
    ("mit-text", "MIT", """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT."""),
    ("mit-released", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-project", "MIT", "This project is licensed under the MIT License."),
    ("isc-text", "ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies."""),
    ("bsd-2-text", "BSD-2-Clause", """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the following conditions are met: Redistributions
of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""),
    ("bsd-3-text", "BSD-3-Clause", """Redistribution and use in source and binary forms, with or
without modification, are permitted provided that the following conditions are met: Redistributions
of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution. Neither the name of the copyright holder nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written
permission."""),
    ("apache-header", "Apache-2.0", """you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("apache-licensed", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3-later", "GPL-3.0-or-later", """This program is free software: you can redistribute it
and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("gpl-2-later", "GPL-2.0-or-later", """This program is free software; you can redistribute it
and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3-work", "GPL-3.0", """This work is licensed under the GNU General Public License,
version 3."""),
    ("gpl-3-licensed", "GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("mpl-2-header", "MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla
Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at https://mozilla.org/MPL/2.0/."""),
    ("cc-by-4-work", "CC-BY-4.0", """This work is licensed under a Creative Commons Attribution 4.0
International License."""),
    ("cc-by-4", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4-work", "CC-BY-NC-4.0", """This work is licensed under a Creative Commons
Attribution-NonCommercial 4.0 International License."""),
    ("unlicense", "Unlicense", """This is free and unencumbered software released into the public
domain."""),
    # the same with its address in a paragraph alone, as it stands in source files
    ("apache-header-lines", "Apache-2.0", """you may not use this file except in compliance with the
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the
License."""),
)
LINE_END = r"\n|[.!?;:]+[ \t\r\n]+"
# paragraphs also end at lines that hold signs of comments alone
WRAPPED_END = r"\n[ \t\r#*/;%-]*\n|[.!?;:]+[ \t\r\n]+"
GAP = 3  # places from one sentence of a rule to its next, at most


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def rules() -> list[tuple[str, str, list[str]]]:
    """Each rule of the notices above as (rule, licence, its known sentences in order)."""
    return [(rule, licence, [x for x in map(normalised, re.split(WRAPPED_END, text)) if x])
            for rule, licence, text in NOTICES]


def rule_steps(notices: DataFrame) -> DataFrame:
    """(rule, license, sentence, step, n) from (rule, license, text): sentences by their order."""
    s = notices.select("rule", "license", F.posexplode(F.split("text", WRAPPED_END)).alias("p", "s"))
    s = s.select("rule", "license", "p", _clean(F.col("s")).alias("sentence")).where("sentence <> ''")
    w = Window.partitionBy("rule", "license")
    return s.select("rule", "license", "sentence", (F.row_number().over(
        w.orderBy("p")) - 1).alias("step"), F.count("*").over(w).cast("int").alias("n"))


def _steps(spark: SparkSession, notices: DataFrame | None) -> DataFrame:
    """Steps of the given rules, or of those above: few and fixed, so they may be broadcast."""
    if notices is not None:
        return rule_steps(notices)
    steps = [(r, lic, x, i, len(s)) for r, lic, s in rules() for i, x in enumerate(s)]
    return F.broadcast(spark.createDataFrame(
        steps, "rule string, license string, sentence string, step int, n int"))


def _clean(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def known_sentences(docs: DataFrame, steps: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(key, view, pos, sentence, counted): known sentences in the texts.

    Texts are cut at sentence ends in two views: 0 also at every line end, 1 only at blank lines
    and lines of comment signs, for sentences that run over lines. Sentences of view 1 that stand
    on one line are in the chains, but not counted again.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    views = F.array(F.split(t, LINE_END), F.split(t, WRAPPED_END))
    d = docs.select(row_key(id_col, text_col).alias("key"), F.posexplode(views).alias("view", "w"))
    s = d.select("key", "view", F.posexplode("w").alias("pos", "s")).withColumn(
        "counted", (F.col("view") == 0) | F.col("s").contains("\n"))
    return s.select("key", "view", "pos", "counted", _clean(F.col("s")).alias("sentence")).join(
        steps.select("sentence").distinct(), "sentence")


def matches(found: DataFrame, steps: DataFrame, gap: int = GAP) -> DataFrame:
    """(key, rule, license): rules whose sentences stand in order, each at most ``gap`` places on.

    The fold keeps, for each sentence of the rule, the last place where a chain up to it ends;
    later ends dominate earlier ones, so this finds a chain whenever there is one.
    """
    at = found.join(steps, "sentence").groupBy("key", "view", "rule", "license", "n").agg(
        F.array_sort(F.collect_set(F.struct("pos", (-F.col("step")).alias("back")))).alias("seq"))
    start = F.array_repeat(F.lit(None).cast("int"), F.col("n"))

    def step(ends: Column, x: Column) -> Column:
        i, before = -x["back"], F.get(ends, -x["back"] - 1)
        reached = (i == 0) | (F.coalesce(before, F.lit(-gap - 1)) + gap >= x["pos"])
        return F.transform(ends, lambda e, j: F.when((j == i) & reached, x["pos"]).otherwise(e))

    return at.where(F.element_at(F.aggregate("seq", start, step), -1).isNotNull()).select(
        "key", "rule", "license").distinct()


def scan(docs: DataFrame, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text",
         notices: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, licenses, rules, n_sentences.

    ``licenses`` and ``rules`` are sorted lists without repeats; ``n_sentences`` counts places
    that hold a known sentence. ``notices``: a table (rule, license, text) of rules to look for
    instead of the built-in ones; rows without text are no rules. Null, empty and unlicensed texts
    have empty lists and 0; repeated rows get equal results; extra columns are ignored; an empty
    table gives no rows. Texts are split once: what is known in them is a stored table.
    """
    steps = _steps(docs.sparkSession, notices)
    found = stored(known_sentences(docs, steps, id_col, text_col), "sentences")
    count = found.where("counted").groupBy("key").agg(F.countDistinct("view", "pos").alias("n"))
    lists = matches(found, steps, gap).groupBy("key").agg(
        F.sort_array(F.collect_set("license")).alias("licenses"),
        F.sort_array(F.collect_set("rule")).alias("rules"))
    none = F.array().cast("array<string>")
    d = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"))
    return d.join(count, "key", "left").join(lists, "key", "left").select(
        "doc_id", F.coalesce("licenses", none).alias("licenses"),
        F.coalesce("rules", none).alias("rules"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_sentences"))


def oracle_sql(gap: int = GAP) -> str:
    """The same as SQL: a recursive chain of the sentences of each rule."""
    steps = ", ".join(f"('{r}', '{lic}', '{x}', {i}, {len(s)})" for r, lic, s in rules()
                      for i, x in enumerate(s))
    split = "regexp_split_to_array(coalesce(text, ''), '{}')"
    views = [f"SELECT r, {v} AS view, unnest({split.format(e)}) AS s, "
             f"unnest(range(len({split.format(e)}))) AS pos FROM d"
             for v, e in enumerate((LINE_END, WRAPPED_END))]
    return f"""
WITH RECURSIVE steps(rule, license, sentence, step, n) AS (VALUES {steps}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
f AS (SELECT r, view, pos, sentence, view = 0 OR contains(s, chr(10)) AS counted
  FROM ({" UNION ALL ".join(views)}) v JOIN (SELECT DISTINCT sentence FROM steps)
  ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
m AS (SELECT r, view, pos, rule, license, step, n FROM f JOIN steps USING (sentence)),
chain AS (SELECT r, view, pos, rule, step FROM m WHERE step = 0
  UNION SELECT m.r, m.view, m.pos, m.rule, m.step FROM chain c JOIN m ON m.r = c.r
    AND m.view = c.view AND m.rule = c.rule AND m.step = c.step + 1
    AND m.pos > c.pos AND m.pos <= c.pos + {gap}),
ok AS (SELECT DISTINCT r, rule, license FROM chain JOIN (SELECT DISTINCT rule, license, n FROM steps)
  USING (rule) WHERE step = n - 1),
l AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
  string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM ok GROUP BY r),
c AS (SELECT r, count(DISTINCT (view, pos)) AS n FROM f WHERE counted GROUP BY r)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules,
  coalesce(n, 0) AS n_sentences FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)"""
