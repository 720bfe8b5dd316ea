"""Personal data: fixed patterns, and a linear-chain CRF over word shapes for what they miss."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ritardo.llm.common import stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"soft_{k}" for k in BASE))
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number is read from its first digit in any case, so the look-behind changes no match.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
AT = re.compile(r"@|\b[Aa][Tt]\b")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS = np.array([i for i in range(128, 0x110000) if chr(i).isdigit()], np.uint32)

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, in order."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if any(c in text for c in "0123456789"):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)
                    if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


# Shapes: letters by case and length, numbers by length, other characters one by one.
LOWER_, UPPER_, DIGIT, BLANK, LINE, OTHER = range(6)
MARKS = "@.+-():/_%=,\"'"
WORD_SHAPES, NUMBER_SHAPES = 16, 9
N_SHAPES = WORD_SHAPES + NUMBER_SHAPES + 1 + len(MARKS) + 1  # one for beyond the ends
EDGE = N_SHAPES - 1
REACH = 2  # shapes on either side that a token's features take in
TAGS = ["O"] + [f"{p}-{k}" for k in BASE for p in "BI"]
K = len(TAGS)
MAX_RUN = 512  # tokens of a sequence
LEARN_RUN, LEARN_ROWS = 48, 800  # tokens of a learned sequence, and how many are learned at most


def char_classes() -> np.ndarray:
    c = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        ch = chr(i)
        if ch.isalpha():
            c[i] = UPPER_ if ch.isupper() else LOWER_
        elif ch.isspace():
            c[i] = BLANK
    c[ord("0"):ord("9") + 1] = DIGIT
    c[ord("\n")] = LINE
    for j, ch in enumerate(MARKS):
        c[ord(ch)] = OTHER + 1 + j
    return c


@dataclass
class Tokens:
    """Tokens of texts laid end to end: places, shapes, blank before, and sequence numbers."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    gap: np.ndarray
    seq: np.ndarray


def tokenise(codes: np.ndarray, classes: np.ndarray, first: np.ndarray) -> Tokens:
    """Runs of letters, runs of digits, other characters; ``first``: where each text begins.

    A sequence ends with the text, at a line end, after a full stop, question or exclamation mark
    that a blank follows, and after ``MAX_RUN`` tokens.
    """
    c = classes[codes]
    group = np.array([1, 1, 2, 0, 0, 3], np.uint8)[np.minimum(c, OTHER)]
    text_no = np.zeros(len(c), np.int64)
    cut = np.ones(len(c), bool)
    cut[1:] = (group[1:] != group[:-1]) | (group[1:] == 3)
    inside = first[first < len(c)]
    cut[inside] = True
    np.add.at(text_no, inside, 1)
    run = np.flatnonzero(cut)
    stop = np.append(run[1:], len(c))
    kept = group[run] != 0
    gap = np.ones(len(run), bool)
    gap[1:] = ~kept[:-1]
    start, end, g = run[kept], stop[kept], group[run][kept]
    line = np.cumsum((c == LINE) + text_no)  # grows at line ends and at texts
    ups = np.concatenate([[0], np.cumsum(c == UPPER_)])
    n, up = end - start, ups[end] - ups[start]
    case = np.where(up == 0, 0, np.where((up == 1) & (c[start] == UPPER_), 1, np.where(up == n, 2, 3)))
    shape = np.where(g == 1, case * 4 + np.searchsorted([2, 4, 7], n, "right"), 0)
    number = WORD_SHAPES + np.searchsorted([2, 3, 4, 5, 6, 9, 14, 20], n, "right")
    shape = np.where(g == 2, number, shape)
    shape = np.where(g == 3, WORD_SHAPES + NUMBER_SHAPES + c[start].astype(np.int64) - OTHER, shape)
    space = gap[kept]
    stops = np.isin(codes[start], [ord("."), ord("!"), ord("?")])
    new = np.ones(len(start), bool)
    new[1:] = (line[start[1:]] != line[start[:-1]]) | (stops[:-1] & space[1:])
    head = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    new |= (np.arange(len(start)) - head) % MAX_RUN == 0
    return Tokens(start, end, shape.astype(np.int16), space, np.cumsum(new) - 1)


def features(t: Tokens) -> np.ndarray:
    """(tokens, 2 * REACH + 3) feature numbers: shapes around, blank before it and before the next."""
    n, out = len(t.shape), []
    for d in range(-REACH, REACH + 1):
        at = np.arange(n) + d
        ok = (at >= 0) & (at < n)
        ok[ok] &= t.seq[at[ok]] == t.seq[ok]
        s = np.full(n, EDGE)
        s[ok] = t.shape[at[ok]]
        out.append(s + (d + REACH) * N_SHAPES)
    wide = (2 * REACH + 1) * N_SHAPES
    out.append(wide + t.gap)
    after = np.ones(n, bool)
    after[:-1] = t.gap[1:]
    out.append(wide + 2 + after)
    return np.stack(out, axis=1)


N_FEATURES = (2 * REACH + 1) * N_SHAPES + 4


def allowed() -> np.ndarray:
    """Moves that tags permit, from row to column: inside a kind only after the kind itself."""
    ok = np.zeros((K + 1, K))  # the last row is the start
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            ok[:, j] = -1e4
            ok[[j - 1, j], j] = 0
    return ok


@dataclass
class Crf:
    emit: np.ndarray  # features x tags
    move: np.ndarray  # (tags + start) x tags


def _padded(seqs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(len(y) for _, y in seqs)
    x = np.zeros((len(seqs), width, seqs[0][0].shape[1]), np.int64)
    y, on = np.zeros((len(seqs), width), np.int64), np.zeros((len(seqs), width), bool)
    for i, (f, tags) in enumerate(seqs):
        x[i, :len(tags)], y[i, :len(tags)], on[i, :len(tags)] = f, tags, True
    return x, y, on


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_crf(seqs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.15,
              ridge: float = 0.02) -> Crf:
    """Maximum likelihood by forward-backward and Adam steps over all sequences at once."""
    rule = allowed()
    if not seqs:
        return Crf(np.zeros((N_FEATURES, K)), rule)
    x, y, on = _padded(seqs)
    n, width = y.shape
    theta = [np.zeros((N_FEATURES, K)), np.zeros((K + 1, K))]
    m1, m2 = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    gold = [np.zeros_like(p) for p in theta]
    for f in range(x.shape[2]):
        np.add.at(gold[0], (x[..., f][on], y[on]), 1)
    np.add.at(gold[1], (np.full(n, K), y[:, 0]), 1)
    pair = on[:, 1:]
    np.add.at(gold[1], (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for step in range(1, rounds + 1):
        e, t = theta[0][x].sum(axis=2), theta[1] + rule
        fwd = np.empty((n, width, K))
        fwd[:, 0] = e[:, 0] + t[K]
        for i in range(1, width):
            nxt = _lse(fwd[:, i - 1, :, None] + t[None, :K], 1) + e[:, i]
            fwd[:, i] = np.where(on[:, i, None], nxt, fwd[:, i - 1])
        total = _lse(fwd[:, -1], 1)
        back = np.zeros((n, width, K))
        pairs = np.zeros((K, K))
        for i in range(width - 1, 0, -1):
            way = t[None, :K] + (e[:, i] + back[:, i])[:, None, :]
            p = np.exp(np.minimum(fwd[:, i - 1, :, None] + way - total[:, None, None], 0))
            pairs += p[on[:, i]].sum(axis=0)
            back[:, i - 1] = np.where(on[:, i, None], _lse(way, 2), back[:, i])
        prob = np.exp(np.minimum(fwd + back - total[:, None, None], 0)) * on[..., None]
        seen = [np.zeros_like(p) for p in theta]
        for f in range(x.shape[2]):
            np.add.at(seen[0], x[..., f][on], prob[on])
        seen[1][:K], seen[1][K] = pairs, prob[:, 0].sum(axis=0)
        for j in range(2):
            g = (gold[j] - seen[j]) / n - ridge * theta[j] / n
            m1[j] = 0.9 * m1[j] + 0.1 * g
            m2[j] = 0.999 * m2[j] + 0.001 * g * g
            theta[j] += rate * (m1[j] / (1 - 0.9 ** step)) / (
                np.sqrt(m2[j] / (1 - 0.999 ** step)) + 1e-8)
    return Crf(theta[0], theta[1] + rule)


def viterbi(model: Crf, feats: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Best tags of all sequences, which advance in step, longest first."""
    out = np.zeros(len(seq), np.int64)
    if not len(seq):
        return out
    emit = model.emit[feats[:, 0]]
    for f in range(1, feats.shape[1]):
        emit = emit + model.emit[feats[:, f]]
    first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
    n = np.diff(np.append(first, len(seq)))
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    score = emit[first] + model.move[K]
    came = np.zeros((len(seq), K), np.int8)
    move = model.move[:K]
    for i in range(1, int(n[0])):
        live = int(np.searchsorted(-n, -i, "left"))  # sequences longer than i
        way = score[:live, :, None] + move[None]
        came[first[:live] + i] = way.argmax(axis=1)
        score[:live] = way.max(axis=1) + emit[first[:live] + i]
    tag = score.argmax(axis=1)
    out[first + n - 1] = tag
    for i in range(int(n[0]) - 1, 0, -1):
        live = int(np.searchsorted(-n, -i, "left"))
        at = first[:live] + i
        tag[:live] = came[at, out[at]]
        out[at - 1] = tag[:live]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def soft_spans(model: Crf, texts: list[str], classes: np.ndarray) -> list[list[Span]]:
    """Stretches of one kind that the CRF marks, for each text.

    Sequences without a digit, an @, the word at, or a bracket before two letters, hold nothing that
    is ``plausible``, and are not decoded.
    """
    out: list[list[Span]] = [[] for _ in texts]
    codes = [_codes(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    joint = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    t = tokenise(joint, classes, first[:-1])
    if not len(t.start):
        return out
    mark = ((t.shape >= WORD_SHAPES) & (t.shape < WORD_SHAPES + NUMBER_SHAPES)) | (
        t.shape == WORD_SHAPES + NUMBER_SHAPES + 1)
    open_ = np.isin(joint[t.start[:-1]], [ord("("), ord("[")])
    mark[:-1] |= open_ & (t.end[1:] - t.start[1:] == 2) & (t.shape[1:] < WORD_SHAPES)
    two = np.flatnonzero((t.end - t.start == 2) & (t.shape < WORD_SHAPES))
    mark[two] |= np.isin(joint[t.start[two]], [ord("A"), ord("a")]) & np.isin(
        joint[t.start[two] + 1], [ord("T"), ord("t")])
    strange = np.flatnonzero(t.shape == WORD_SHAPES + NUMBER_SHAPES)  # digits of other scripts are there
    mark[strange] |= np.isin(joint[t.start[strange]], DIGITS)
    live = np.zeros(int(t.seq[-1]) + 1, bool)
    live[t.seq[mark]] = True
    use = np.flatnonzero(live[t.seq])
    if not len(use):
        return out
    t = Tokens(t.start[use], t.end[use], t.shape[use], t.gap[use], t.seq[use])
    tags = viterbi(model, features(t), t.seq)
    kind = (tags + 1) // 2  # 0: none
    begin = (kind > 0) & ((tags % 2 == 1) | (np.concatenate([[0], kind[:-1]]) != kind) |
                          np.concatenate([[True], t.seq[1:] != t.seq[:-1]]))
    at = np.flatnonzero(begin)
    last = np.zeros(len(at), np.int64)
    for j, a in enumerate(at):
        b = a
        while b + 1 < len(kind) and kind[b + 1] == kind[a] and not begin[b + 1]:
            b += 1
        last[j] = b
    doc = np.searchsorted(first, t.start[at], "right") - 1
    for a, b, d in zip(at, last, doc, strict=True):
        out[d].append((int(t.start[a] - first[d]), len(BASE) + int(kind[a]) - 1,
                       int(t.end[b] - first[d])))
    return out


# The labelled table of the query starts with these; a span stands in braces with its kind.
EXAMPLES = """
write to {email:anna.lee at example.org} before noon
mail {email:j_smith (at) mail.example.com} for the list
or {email:info [at] example.net} if that fails
ring {phone:(017) 555-7713} after six
call {phone:020 7946 0958} or {phone:555-0199-4321} today
tel {phone:+44 20 7946 0958} fax {phone:+1-202-555-0143}
her number is {phone:0171 5550123} and his {phone:(030) 555 2211}
paid with {card:4111 1111 1111 1111} on monday
card {card:5500-0000-0000-0004} was refused
the number {card:4012888888881881} belongs to nobody
from {ip:10.0.0.1} to {ip:192.168.0.254} in a second
host {ip:172.16.254.1} and {ip:fe80} are two things
in 1999 there were 12 of 340 and 7.5 percent
version 2.0.1 of 3 May 2021 costs 1,200.50
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 20 more
page 12 line 3 at 10:45 on 2020-01-31
chapter 4 verse 16 of 1611 and room 101 at 9.30
order 66 of 10000 and 100 000 in 5 years
"""
EXAMPLE = re.compile(r"\{(\w+):([^}]*)\}")


def example_rows() -> list[tuple[str, list[Span]]]:
    out = []
    for row in EXAMPLES.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in EXAMPLE.finditer(row):
            text += row[at:m.start()]
            if m[2] != "fe80":
                spans.append((len(text), BASE.index(m[1]), len(text) + len(m[2])))
            text += m[2]
            at = m.end()
        out.append((text + row[at:], spans))
    return out


def train(labelled: list[tuple[str, list[Span]]]) -> Crf:
    """CRF from texts with labelled spans (start, kind, end).

    Sequences with a digit, in pieces of ``LEARN_RUN`` tokens, are learned, those with a span first.
    """
    classes, seqs = char_classes(), []
    for text, spans in labelled:
        t = tokenise(_codes(text), classes, np.zeros(1, np.int64))
        if not len(t.start):
            continue
        tags = np.zeros(len(t.start), np.int64)
        for s, k, e in spans:
            inside = np.flatnonzero((t.end > s) & (t.start < e))
            if len(inside):
                tags[inside] = 2 * k + 2
                tags[inside[0]] = 2 * k + 1
        f = features(t)
        for q in range(int(t.seq[-1]) + 1):
            ix = np.flatnonzero(t.seq == q)
            if not ((tags[ix] > 0).any() or ((t.shape[ix] >= WORD_SHAPES) & (
                    t.shape[ix] < WORD_SHAPES + NUMBER_SHAPES)).any()):
                continue
            for at in range(0, len(ix), LEARN_RUN):
                tag = tags[ix[at:at + LEARN_RUN]].copy()
                if tag[0] and tag[0] % 2 == 0:
                    tag[0] -= 1
                seqs.append((f[ix[at:at + LEARN_RUN]], tag))
    seqs.sort(key=lambda x: not x[1].any())
    return train_crf(seqs[:LEARN_ROWS])


def labelled_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_docs: int = 400, max_letters: int = 8000) -> list[tuple[str, list[Span]]]:
    """A small labelled table: the examples, at weight 4, and a bounded sample with the spans of
    the fixed patterns.

    The sample is the ``max_docs`` texts of least hash among those with a digit or an @, of each
    the first ``max_letters`` code points.
    """
    d = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("t")).where(
        F.col("t").rlike("[0-9@]"))
    few = stored(d.select("h").distinct().orderBy("h").limit(max_docs), "sample")
    rows = d.join(F.broadcast(few), "h").groupBy("h").agg(
        F.min(F.substring("t", 1, max_letters)).alias("t")).orderBy("h").collect()
    return 4 * example_rows() + [(r["t"], base_spans(r["t"])) for r in rows]


def plausible(kind: int, text: str) -> bool:
    """What a marked stretch must hold at least: an at sign or the word, or four digits."""
    if kind == len(BASE):
        return AT.search(text) is not None
    return sum(c.isdigit() for c in text) >= 4


def spans_of(model: Crf, texts: list[str | None], classes: np.ndarray
             ) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text; a marked stretch that meets a base span is left out."""
    held: list[str] = []
    size = 0

    def flush() -> Iterator[tuple[list[Span], list[Span]]]:
        for text, soft in zip(held, soft_spans(model, held, classes), strict=True):
            base = base_spans(text)
            more = [x for x in soft if plausible(x[1], text[x[0]:x[2]]) and not any(
                b[0] < x[2] and x[0] < b[2] for b in base)]
            yield base, sorted(base + more)
        held.clear()

    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > 1 << 20:
            yield from flush()
            size = 0
    yield from flush()


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns),
    base_sha256, spans.

    Null and empty texts have no spans. Rows are never joined, so repeated rows and null ids are as
    any other; extra columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string"

    @F.pandas_udf(fields)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classes = char_classes()
        for p in parts:
            rows = []
            for base, every in spans_of(shared.value, list(p), classes):
                kinds = [k for _, k, _ in base]
                rows.append((*(kinds.count(k) for k in range(len(BASE))),
                             hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    out = docs.select(F.col(id_col).alias("doc_id"), run(text_col).alias("x"))
    return out.select("doc_id", "x.*")
