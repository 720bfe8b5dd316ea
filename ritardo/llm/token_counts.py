"""Token counts at every prefix of a text, by dynamic programming over byte-pair tokens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this kind cut a text into words.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
BLANK = regex.compile(r"\p{White_Space}+")
SPLIT_TAIL = ("'re", "'ve", "'ll")  # cut before their end, the quote is a word of its own
CACHE = 400_000  # words remembered by a worker; forgotten together beyond that
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixModel(dict):
    """Maps a word to its number of tokens; ``prefixes`` gives it for every prefix.

    A row of tokens is the encoding of its text exactly if every token is that of its own bytes
    and no merge crosses the border of two neighbours. So each prefix ends in exactly one token
    that fits the encoding of the prefix before it, and its count is one more.
    """

    def __init__(self, source: str):
        super().__init__()
        spec = json.loads(source)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") is not None:
            raise ValueError("a byte-level BPE file without normaliser is needed")
        if spec["model"].get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or (
                spec["pre_tokenizer"]["add_prefix_space"]):
            raise ValueError("a plain byte-level word splitter is needed")
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in spec["model"]["vocab"]
               if all(c in letters for c in t)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (raw[x] for x in (m.split(" ") if isinstance(m, str) else m))
            self.rank[a, b] = r
            self.halves.setdefault(a + b, (a, b))
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.tokens = {bytes([b]) for b in range(256)}
        for t, (a, b) in sorted(self.halves.items(), key=lambda x: self.rank[x[1]]):
            if a in self.tokens and b in self.tokens and self._whole(a, b, self.rank[a, b]):
                self.tokens.add(t)
        self.longest = max(map(len, self.tokens))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if (
            self.specials) else None

    def _spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Parts of a token on one edge, from its last byte up, with the rank that takes each up."""
        out, r = [], NEVER
        while True:
            out.append((token, r))
            if token not in self.halves:
                return out[::-1]
            r = self.rank[self.halves[token]]
            token = self.halves[token][side]

    def _whole(self, a: bytes, b: bytes, limit: int) -> bool:
        """No merge over the border of ``a`` and ``b`` comes before rank ``limit``.

        Merges come in the order of rank; of equal pairs, the left one first.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, rx), (y, ry) = left[i], right[j]
            r = self.rank.get((x, y), NEVER)
            if r < min(rx, limit) and r <= ry:
                return False
            if rx >= NEVER and ry >= NEVER:
                return True
            if rx <= ry:
                i += 1
            else:
                j += 1

    def _fit(self, a: bytes, b: bytes) -> bool:
        ok = self.fits.get((a, b))
        if ok is None:
            if len(self.fits) > 2 * CACHE:
                self.fits.clear()
            ok = self.fits[a, b] = self._whole(a, b, NEVER)
        return ok

    def prefixes(self, word: bytes) -> list[int]:
        """Tokens of each prefix of the bytes of one word, from none to all."""
        counts, last = [0], [b""]
        tokens, longest, fit = self.tokens, self.longest, self._fit
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                t = word[start:end]
                if t in tokens and (not start or fit(last[start], t)):
                    counts.append(counts[start] + 1)
                    last.append(t)
                    break
        return counts

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        data = word.encode()
        n = self[word] = 1 if data in self.tokens else self.prefixes(data)[-1]
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it are one token each."""
        if self.cut is None or not any(s in text for s in self.specials):
            return sum(map(self.__getitem__, WORDS.findall(text)))
        parts = self.cut.split(text)
        return len(parts) // 2 + sum(
            sum(map(self.__getitem__, WORDS.findall(p))) for p in parts[::2])

    def _plain(self, text: str) -> list[int]:
        """Counts of all prefixes of a text without special strings (first: none)."""
        out, total, run, run_base = [0], 0, None, 0
        for m in WORDS.finditer(text):
            start, w = m.start(), m[0]
            blank = BLANK.fullmatch(w) is not None
            row = self._by_letter(w, total)
            if w in SPLIT_TAIL:
                row[1] = total + self[w[0]] + self[w[1]]
            lead = len(w) if blank else int(w[0] == " ")
            if lead:  # a text that ends here has the whole run of blanks as one word
                if run is None:
                    run, run_base = start, total
                row[:lead] = self._by_letter(text[run:start + lead], run_base)[-lead:]
            if not blank:
                run = None
            out += row
            total += self[w]
        return out

    def _by_letter(self, word: str, base: int) -> list[int]:
        by_byte = self.prefixes(word.encode())
        at = np.cumsum([len(c.encode()) for c in word])
        return [base + by_byte[i] for i in at]

    def at_prefixes(self, text: str) -> list[int]:
        """The library's count for text[:i], i from 0 to the length."""
        out, base, at = [0], 0, 0
        parts = self.cut.split(text) if self.cut is not None else [text]
        for k, p in enumerate(parts):
            if k % 2 == 0:
                out += [base + c for c in self._plain(p)[1:]]
                base += self.count(p)
                before = p
            else:  # inside a special string, its start is ordinary text after the part before it
                for i in range(1, len(p)):
                    out.append(out[at - len(before)] + self._plain(before + p[:i])[-1])
                base += 1
                out.append(base)
            at += len(p)
        return out


_MODELS: dict[str, PrefixModel] = {}


def model_of(source: str) -> PrefixModel:
    """One model per worker and vocabulary."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = PrefixModel(source)
    return _MODELS[key]


def _shipped(df: DataFrame, path: str):
    """The vocabulary file, read once; its size does not depend on the data."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
                 ) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_tokens (null and empty: 0). Rows are never joined, so
    repeated rows and null ids are as any other; extra columns are ignored."""
    source = _shipped(docs, vocabulary)

    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model_of(source.value)
        for p in parts:
            yield pd.Series([m.count(t) if t else 0 for t in p], dtype="int64")

    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"),
        run(text_col).alias("n_tokens"))


def prefix_counts(docs: DataFrame, vocabulary: str, text_col: str = "text",
                  name: str = "prefix_tokens") -> DataFrame:
    """Adds an array: element i is the token count of the first i code points (null for null)."""
    source = _shipped(docs, vocabulary)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model_of(source.value)
        for p in parts:
            yield pd.Series([None if t is None else np.asarray(m.at_prefixes(t), np.int32)
                             for t in p], dtype=object)

    return docs.withColumn(name, run(text_col))


def fitting_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored counts."""
    fits = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i).otherwise(-1))
    return F.array_max(fits)
