"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ritardo.llm.common import stored

UNKNOWN = "und"
PAD, SPACE, STRANGE = 0, 1, 2  # symbols before the letters: past the end, blank, unlearned letter
BLOCK = 512  # symbols parsed on their own; phrases end at its border, in every language alike
LONG = 64  # symbols from which a text can be rejected as no learned language
MAX_DOCS, MAX_LETTERS, MAX_SYMBOLS = 256, 4000, 32_768  # of a language's sample


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return step


def parsing_table(text: list[int], n_symbols: int) -> np.ndarray:
    """[state, symbol] -> 4 * (first cell of the next state) + phrases that end.

    A phrase is the longest match from its start. Where a state has no way on, its phrase ends and
    the symbol begins the next; a symbol the text lacks is a phrase of its own.
    """
    step = suffix_automaton(text)
    out = np.zeros((len(step), n_symbols), np.int32)
    first = np.full(n_symbols, 1, np.int32)  # ends as a phrase alone, back to the start
    for c, s in step[0].items():
        if c < n_symbols:
            first[c] = 4 * s * n_symbols
    out[0] = first
    out[1:] = first + 1
    for s, moves in enumerate(step):
        for c, t in moves.items():
            if c < n_symbols:
                out[s, c] = 4 * t * n_symbols
    out[:, PAD] = 4 * n_symbols * np.arange(len(step))
    return out.ravel()


@dataclass
class LanguageModel:
    """A parsing table for each language over one alphabet."""

    languages: list[str]
    alphabet: str
    tables: list[np.ndarray]
    weights: list[float]  # bits of a phrase: log2 of the learned length

    def symbol_map(self) -> np.ndarray:
        """Symbol of each code point: all that is no letter is blank."""
        m = np.full(0x110000, SPACE, np.int16)
        m[[i for i in range(0x110000) if chr(i).isalpha()]] = STRANGE
        for i, c in enumerate(self.alphabet):
            m[ord(c)] = STRANGE + 1 + i
        return m


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-cased letters, one blank for whatever stands between them, none at the ends."""
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = s == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    s = s[keep]
    if len(s) and s[0] == SPACE:
        s = s[1:]
    return s[:-1] if len(s) and s[-1] == SPACE else s


def phrases(blocks: np.ndarray, table: np.ndarray, n_symbols: int) -> np.ndarray:
    """Phrases of each column of ``blocks`` (BLOCK x n), all columns in step."""
    at = np.zeros(blocks.shape[1], np.int32)
    n = np.zeros(blocks.shape[1], np.int32)
    for row in blocks:
        v = table[at + row]
        n += v & 3
        at = v >> 2
    return n + (at != 0)


def fit_tables(samples: dict[str, list[str]], max_symbols: int = MAX_SYMBOLS,
               rows: dict[str, int] | None = None) -> LanguageModel:
    """Model of a bounded sample: at most ``max_symbols`` symbols of each language.

    Languages with more labelled ``rows`` come first, which decides ties.
    """
    langs = sorted(samples, key=lambda x: (-(rows or {}).get(x, 0), x))
    letters = sorted({c for ts in samples.values() for t in ts for c in t.lower() if c.isalpha()})
    m = LanguageModel(langs, "".join(letters), [], [])
    codes, n_symbols = m.symbol_map(), STRANGE + 1 + len(letters)
    for lang in langs:
        seq, n = [], 0
        for t in samples[lang]:
            s = symbols(t, codes)[:max_symbols - n].tolist()
            seq += [*s, n_symbols]  # a border no text has
            n += len(s)
        m.tables.append(parsing_table(seq, n_symbols))
        m.weights.append(math.log2(max(n, 2)))
    return m


def held_out(id_col: str, modulus: int = 5) -> Column:
    """crc32 of the id as text divides by the modulus (null: of no text, so held out)."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "utf-8")) % modulus == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = MAX_DOCS, max_letters: int = MAX_LETTERS, max_symbols: int = MAX_SYMBOLS
        ) -> LanguageModel:
    """Learn from labelled rows that are not held out.

    Texts count by their first ``max_letters`` code points, and copies as one. Of each language the
    ``max_docs`` texts with the least hash of id and text are taken, in that order, ``max_symbols``
    symbols in all: the sample that reaches the driver is bounded by these and the number of
    languages, however often an id or a text repeats.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"),
                    F.substring(text_col, 1, max_letters).alias("text"), held_out(id_col).alias("out"))
    d = d.where("not out and lang is not null and text is not null").withColumn(
        "x", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("h", "x")
    few = stored(d.groupBy("lang", "x").agg(F.min(F.xxhash64("id", "x")).alias("h")).withColumn(
        "n", F.row_number().over(order)).where(F.col("n") <= max_docs).select("lang", "x", "h"),
        "sample")
    rows = d.join(F.broadcast(few), ["lang", "x"]).groupBy("lang", "x", "h").agg(
        F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h, r.x)):
        samples.setdefault(r.lang, []).append(r.text)
    samples = {lang: t for lang, t in samples.items() if any(c.isalpha() for x in t for c in x)}
    seen = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return fit_tables(samples, max_symbols, seen)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``fits`` to the rows.

    The language with the fewest bits, phrases times log2 of the learned length, wins, ties to the
    one with most labelled rows; the score is 1 - best / second (1 with one language). Null texts, texts without
    letters, and all texts where nothing was learned are ``und`` with score 0. ``fits`` is false
    for these, and where a text of some length costs more bits a symbol than equally likely
    symbols would: no learned language explains it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, fits boolean")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        codes = m.symbol_map()
        for p in parts:
            yield _predict_batch(m, codes, p)

    out = docs.withColumn("__p", run(text_col))
    return out.select(*docs.columns, "__p.lang_pred", "__p.score", "__p.fits")


def _predict_batch(m: LanguageModel, codes: np.ndarray, texts: pd.Series) -> pd.DataFrame:
    n_symbols, n = STRANGE + 1 + len(m.alphabet), len(texts)
    count = np.zeros((len(m.tables), n), np.int64)
    length, lettered = np.zeros(n, np.int64), np.zeros(n, bool)
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def flush() -> None:
        if held:
            b, o = np.ascontiguousarray(np.vstack(held).T), np.concatenate(owner)
            for k, t in enumerate(m.tables):
                count[k] += np.bincount(o, phrases(b, t, n_symbols), n).astype(np.int64)
            held.clear()
            owner.clear()

    size = 0
    for i, t in enumerate(texts):
        s = symbols(t, codes) if t else codes[:0]
        length[i] = len(s)
        lettered[i] = bool((s >= STRANGE).any())
        for a in range(0, len(s), BLOCK << 12):  # a very long text goes in several rounds
            x = s[a:a + (BLOCK << 12)]
            rows = -(-len(x) // BLOCK)
            b = np.zeros(rows * BLOCK, np.int16)
            b[:len(x)] = x
            held.append(b.reshape(rows, BLOCK))
            owner.append(np.full(rows, i))
            size += rows
            if size >= 1 << 13:
                flush()
                size = 0
    flush()
    if not m.tables:
        return pd.DataFrame({"lang_pred": [UNKNOWN] * n, "score": 0.0, "fits": False})
    bits = count * np.array(m.weights)[:, None]
    best = bits.argmin(axis=0)
    low = np.sort(bits, axis=0)
    second = low[1] if len(low) > 1 else np.full(n, np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.where(second > 0, 1 - low[0] / second, 0.0)
        per = low[0] / length
    strange = (length >= LONG) & (per > math.log2(n_symbols))
    names = np.array(m.languages, object)[best]
    names[~lettered] = UNKNOWN
    return pd.DataFrame({"lang_pred": names, "score": np.where(lettered, score, 0.0),
                         "fits": lettered & ~strange})
