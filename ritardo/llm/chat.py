"""Chat formatting: a small sandboxed template language, compiled to closures, over Spark tables.

A template is text with ``{{ expression }}`` and the blocks ``{% for m in messages %}``,
``{% if %}`` / ``{% elif %}`` / ``{% else %}``, ``{% set name = expression %}`` and
``{% generation %}``, which marks what a model is trained on. Expressions are strings, whole
numbers, ``true``, ``false``, ``none``, names, ``m.field`` or ``m['field']``, ``not and or``,
``== != < <= > >= in``, ``+ -`` and ``~`` (joins texts), and filters ``| name``. A template reaches
only the message's fields, its own names and ``loop``: no attributes, calls or imports of Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1024  # turns of a conversation that are rendered as one piece of work
PART = 1 << 20  # code points after which a row of output ends, at the end of a turn


class TemplateError(ValueError):
    """The template is not of the language, or asks for what is not there."""


# ---- control strings ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Controls:
    """The control strings of a format, and the way texts that contain them are written.

    Each begins with a character that stands nowhere else in any of them and none begins another,
    so that occurrences never overlap nor run across the border of a text. A text's occurrence gets
    a backslash after its first character; those that have some already get one more. Taking one
    away gives the text back, and no written text contains a control string.
    """

    strings: tuple[str, ...]

    def __post_init__(self):
        first = {s[:1] for s in self.strings}
        for s in self.strings:
            if len(s) < 2 or any(c in first for c in s[1:]) or s[1] == "\\":
                raise TemplateError(f"control string {s!r} cannot be told apart")
            if any(o != s and o.startswith(s) for o in self.strings):
                raise TemplateError(f"control string {s!r} begins another one")

    def pattern(self, least: str = "*") -> str:
        return "|".join(rf"{re.escape(s[0])}\\{least}{re.escape(s[1:])}" for s in self.strings)

    def escape(self, text: str) -> str:
        return _ESCAPE(self)(text)

    def unescape(self, text: str) -> str:
        return _UNESCAPE(self)(text)


def _writer(controls: Controls, least: str, change: Callable[[str], str]) -> Callable[[str], str]:
    first = sorted({s[0] for s in controls.strings})
    sub = re.compile(controls.pattern(least)).sub

    def write(text: str) -> str:
        if not any(c in text for c in first):
            return text
        return sub(lambda m: change(m[0]), text)

    return write


_MADE: dict[tuple, Callable[[str], str]] = {}


def _ESCAPE(c: Controls) -> Callable[[str], str]:
    return _MADE.setdefault((c, 1), _writer(c, "*", lambda s: s[0] + "\\" + s[1:]))


def _UNESCAPE(c: Controls) -> Callable[[str], str]:
    return _MADE.setdefault((c, 0), _writer(c, "+", lambda s: s[0] + s[2:]))


# ---- syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Put:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)"""
                   r"""|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.()\[\]=]))""")
PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
WORDS = {"true": True, "false": False, "none": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"))


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if m is None:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or want is not None and self.peek() != want:
            raise TemplateError(f"{want or 'more'} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Any:
        out = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} left over")
        return out

    def level(self, k: int) -> Any:
        if k == len(LEVELS):
            return self.filtered()
        if k == 2 and self.peek() == "not":
            self.take()
            return Op("not", (self.level(2),))
        left = self.level(k + 1)
        while self.peek() in LEVELS[k]:
            sign = self.take()[1]
            left = Op(sign, (left, self.level(k + 1)))
        return left

    def filtered(self) -> Any:
        out = self.item()
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in FILTERS and name != "escape":
                raise TemplateError(f"no filter {name!r}")
            out = Filter(name, out)
        return out

    def item(self) -> Any:
        kind, text = self.take()
        if kind == "str":
            out = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        elif kind == "int":
            out = Const(int(text))
        elif text == "(":
            out = self.level(0)
            self.take(")")
        elif kind == "name":
            out = Const(WORDS[text]) if text in WORDS else Name(text)
        else:
            raise TemplateError(f"{text!r} out of place")
        while self.peek() in (".", "["):
            if self.take()[1] == ".":
                kind, text = self.take()
                if kind != "name":
                    raise TemplateError("a field's name expected")
                out = Item(out, Const(text))
            else:
                out = Item(out, self.level(0))
                self.take("]")
        return out


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(), "length": lambda x: len(_text(x)),
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def parse(source: str) -> tuple:
    """Syntax tree of a template, not folded."""
    stack: list[tuple[str, Any, list]] = [("", None, [])]

    def close(*kinds: str) -> tuple[str, Any, tuple]:
        kind, head, body = stack.pop() if len(stack) > 1 else ("", None, [])
        if kind not in kinds:
            raise TemplateError(f"a block of {' or '.join(kinds)} is not open")
        return kind, head, tuple(body)

    at = 0
    for m in PIECE.finditer(source):
        if m.start() > at:
            stack[-1][2].append(Put(Const(source[at:m.start()])))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Put(_Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if f is None or any(k == "for" for k, _, _ in stack):
                raise TemplateError("a loop runs over messages, and not inside another one")
            stack.append(("for", f[1], []))
        elif word == "endfor":
            _, name, body = close("for")
            stack[-1][2].append(For(name, body))
        elif word == "if":
            stack.append(("if", [(_Expression(rest).whole(), None)], []))
        elif word in ("elif", "else"):
            _, arms, body = close("if")
            if arms[-1][0] is None:
                raise TemplateError("nothing follows else")
            arms[-1] = (arms[-1][0], body)
            arms.append((_Expression(rest).whole() if word == "elif" else None, None))
            stack.append(("if", arms, []))
        elif word == "endif":
            _, arms, body = close("if")
            arms[-1] = (arms[-1][0], body)
            other: tuple = ()
            for test, then in reversed(arms):
                other = then if test is None else (If(test, then, other),)
            stack[-1][2].extend(other)
        elif word == "set":
            s = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(.*)", rest, re.S)
            if s is None:
                raise TemplateError("set name = expression")
            stack[-1][2].append(Set(s[1], _Expression(s[2]).whole()))
        elif word == "generation":
            if any(k == "generation" for k, _, _ in stack):
                raise TemplateError("generation inside generation")
            stack.append(("generation", None, []))
        elif word == "endgeneration":
            _, _, body = close("generation")
            stack[-1][2].append(Generation(body))
        else:
            raise TemplateError(f"no block {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        stack[0][2].append(Put(Const(source[at:])))
    return tuple(stack[0][2])


SIGNS: dict[str, Callable[..., Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: b is not None and a in b, "not": lambda a: not a,
}


def fold(node: Any, controls: Controls) -> Any:
    """The same tree with everything worked out that does not depend on messages."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x, controls)
            if isinstance(x, If) and isinstance(x.test, Const):
                out.extend(x.then if x.test.value else x.other)
            else:
                out.append(x)
        flat: list = []
        for x in out:
            if isinstance(x, Put) and isinstance(x.value, Const):
                x = Put(Const(_text(x.value.value)))
                if flat and isinstance(flat[-1], Put) and isinstance(flat[-1].value, Const):
                    x = Put(Const(flat.pop().value.value + x.value.value))
                elif not x.value.value:
                    continue
            flat.append(x)
        return tuple(flat)
    if isinstance(node, Op):
        args = tuple(fold(a, controls) for a in node.args)
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        if node.sign in SIGNS and all(isinstance(a, Const) for a in args):
            return Const(_known(SIGNS[node.sign], *[a.value for a in args]))
        return Op(node.sign, args)
    if isinstance(node, Filter):
        arg = fold(node.arg, controls)
        return Const(_filter(node.name, controls)(arg.value)) if isinstance(
            arg, Const) else Filter(node.name, arg)
    if isinstance(node, Item):
        return Item(fold(node.of, controls), fold(node.key, controls))
    if isinstance(node, Put):
        return Put(fold(node.value, controls))
    if isinstance(node, If):
        return If(fold(node.test, controls), fold(node.then, controls), fold(node.other, controls))
    if isinstance(node, For):
        return For(node.name, fold(node.body, controls))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, controls))
    if isinstance(node, Generation):
        return Generation(fold(node.body, controls))
    return node


def _filter(name: str, controls: Controls) -> Callable[[Any], Any]:
    return (lambda x: controls.escape(_text(x))) if name == "escape" else FILTERS[name]


def _known(f: Callable[..., Any], *args: Any) -> Any:
    try:
        return f(*args)
    except TypeError as ex:
        raise TemplateError(str(ex)) from ex


# ---- closures ----------------------------------------------------------------------------------

#: A piece of output: its text, and whether a model is trained on it.
Piece = tuple[str, bool]
LOOP = ("index", "index0", "first", "last", "length")


@dataclass(frozen=True)
class Compiled:
    """``run(messages, first, total)`` writes pieces for the messages from place ``first`` (from 0)
    of a conversation of ``total``, the text before the loop with the first of them and the text
    after it with the last. Messages are taken one by one, so that none but the current is held.
    Each yield is the pieces of one message, or of what stands outside the loop."""

    run: Callable[[Iterable[dict], int, int], Iterator[list[Piece]]]
    tree: tuple
    controls: Controls


def compile_template(source: str, controls: Controls, **given: Any) -> Compiled:
    """Parse, fold and turn into closures; ``given`` are names with constant values."""
    tree = fold(_with_given(parse(source), given), controls)

    def expr(node: Any, known: frozenset) -> Callable[[dict], Any]:
        if isinstance(node, Const):
            v = node.value
            return lambda env: v
        if isinstance(node, Name):
            name = node.name
            if name not in known:
                raise TemplateError(f"no name {name!r}")
            return lambda env: env[name]
        if isinstance(node, Item):
            if node.of == Name("loop") and (not isinstance(node.key, Const)
                                            or node.key.value not in LOOP):
                raise TemplateError("loop has " + ", ".join(LOOP))
            of, key = expr(node.of, known), expr(node.key, known)

            def item(env):
                box = of(env)
                if not isinstance(box, dict):
                    raise TemplateError("only messages and loop have fields")
                return box.get(key(env))

            return item
        if isinstance(node, Filter):
            f, arg = _filter(node.name, controls), expr(node.arg, known)
            return lambda env: f(arg(env))
        a = expr(node.args[0], known)
        if node.sign == "not":
            return lambda env: not a(env)
        b = expr(node.args[1], known)
        if node.sign == "and":
            return lambda env: a(env) and b(env)
        if node.sign == "or":
            return lambda env: a(env) or b(env)
        f = SIGNS[node.sign]
        return lambda env: _known(f, a(env), b(env))

    def body(nodes: tuple, known: frozenset, learn: bool) -> Callable[[dict, list], None]:
        steps: list[Callable[[dict, list], None]] = []
        for node in nodes:
            if isinstance(node, Put):
                steps.append(put(expr(node.value, known), learn))
            elif isinstance(node, Set):
                steps.append(bind(node.name, expr(node.value, known)))
                known = known | {node.name}
            elif isinstance(node, If):
                steps.append(choose(expr(node.test, known), body(node.then, known, learn),
                                    body(node.other, known, learn)))
            elif isinstance(node, Generation):
                steps.append(body(node.body, known, True))
            else:
                raise TemplateError("the loop stands at the top of a template")

        def run(env, out):
            for s in steps:
                s(env, out)

        return run

    def put(value, learn):
        return lambda env, out: out.append((_text(value(env)), learn))

    def bind(name, value):
        def step(env, out):
            env[name] = value(env)

        return step

    def choose(test, then, other):
        return lambda env, out: then(env, out) if test(env) else other(env, out)

    loops = [i for i, x in enumerate(tree) if isinstance(x, For)]
    if len(loops) > 1:
        raise TemplateError("one loop over messages")
    at = loops[0] if loops else len(tree)
    names = frozenset()
    before = body(tree[:at], names, False)
    names = names | {x.name for x in tree[:at] if isinstance(x, Set)}
    one = body(tree[at].body, names | {tree[at].name, "loop"}, False) if loops else None
    after = body(tree[at + 1:], names, False)

    def run(messages, first, total):
        env: dict[str, Any] = {}
        out: list[Piece] = []
        before(env, out)
        if first == 0:
            yield out
        k = first
        for m in messages:
            out = []
            if one is not None:
                env[tree[at].name] = m
                env["loop"] = {"index": k + 1, "index0": k, "first": k == 0,
                               "last": k == total - 1, "length": total}
                own = dict(env)  # what a turn sets ends with it, so that chunks are alike
                one(own, out)
            k += 1
            yield out
        if k == total:
            out = []
            after(env, out)
            yield out

    return Compiled(run, tree, controls)


def _with_given(node: Any, given: dict[str, Any]) -> Any:
    if isinstance(node, tuple):
        return tuple(_with_given(x, given) for x in node)
    if isinstance(node, Name):
        return Const(given[node.name]) if node.name in given else node
    if isinstance(node, Op):
        return Op(node.sign, _with_given(node.args, given))
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, Const):
        return type(node)(*[_with_given(getattr(node, f), given) if not isinstance(
            getattr(node, f), str) else getattr(node, f) for f in node.__dataclass_fields__])
    return node


# ---- over Spark --------------------------------------------------------------------------------

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of the format below, and of others that a tokenizer may know.
CONTROLS = Controls((TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>",
                     "<|im_end|>", "<|endoftext|>"))
TEMPLATE = (
    "{{ '<s>' }}{% for m in messages %}{{ turn ~ (m.role | escape) ~ text }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ end }}{% endfor %}{{ '</s>' }}")


PARTS = ("conv_id {id}, chunk bigint, part int, formatted string, "
         "spans array<struct<start:bigint,end:bigint>>")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: Controls = CONTROLS,
                         given: dict | None = None, id_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text",
                         chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """Conversations as text, with the spans a model is trained on.

    Returns (conv_id, chunk, part, formatted, spans): the parts of a conversation in order of
    (chunk, part) are its text; ``spans`` are code points [start, end) of that part. A conversation
    of few turns and moderate length is one row. Parts end at the ends of turns, so that each can
    be read by itself.

    A conversation is cut where its turn number passes a multiple of ``chunk``; chunks are dealt
    out, sorted and rendered apart, each told how many turns stand before it, so that neither a
    task nor memory depends on the longest conversation. Rows of one turn number go by role, then
    text; a null turn comes first. Null roles and texts are empty; a null conv_id is one
    conversation. Repeated rows are turns of their own. Empty tables give no rows. Extra columns
    are ignored.
    """
    names = {"turn": TURN, "text": TEXT, "end": END} if given is None else given
    compile_template(template, controls, **names)  # faults show here, not in a task
    per = Window.partitionBy("conv_id")
    r = turns.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    r = r.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk).cast("bigint"),
                                         F.lit(-(1 << 62))))
    n = r.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(per.orderBy("chunk"))
    marks = n.select("conv_id", "chunk", (upto - F.col("n")).alias("first"),
                     F.sum("n").over(per).alias("total"))
    none = F.lit(None)
    dealt = marks.select(
        "conv_id", "chunk", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"),
        none.cast("string").alias("role"), none.cast("string").alias("text"), "first", "total",
    ).unionByName(r.select("conv_id", "chunk", F.lit(1).alias("kind"), "turn", "role", "text",
                           none.cast("bigint").alias("first"), none.cast("bigint").alias("total")))
    dealt = dealt.repartition("conv_id", "chunk").sortWithinPartitions(
        "conv_id", "chunk", "kind", "turn", "role", "text")

    id_type = dict(r.dtypes)["conv_id"]

    def render(batches):
        run = compile_template(template, controls, **names).run
        out = _Rows(("chunk", "part", "formatted", "spans"),
                    (pa.int64(), pa.int32(), pa.string(), SPANS))
        read = _read(batches, out, ("chunk", "kind", "role", "text", "first", "total"))
        for (conv, at), rows in groupby(read, key=lambda x: (x[0], x[1])):
            mark = next(rows)
            said = ({"role": x[3], "text": x[4]} for x in rows)
            written, spans, size, k = [], [], 0, 0
            for pieces in run(said, mark[5], mark[6]):
                for text, learn in pieces:
                    if learn and text:
                        if spans and spans[-1]["end"] == size:
                            spans[-1]["end"] += len(text)
                        else:
                            spans.append({"start": size, "end": size + len(text)})
                    written.append(text)
                    size += len(text)
                if size >= part:
                    yield from out.add(conv, size, at, k, "".join(written), spans)
                    written, spans, size, k = [], [], 0, k + 1
            if written or k == 0:
                yield from out.add(conv, size, at, k, "".join(written), spans)
        yield from out.rest()

    return dealt.mapInArrow(render, PARTS.format(id=id_type))


def _read(batches: Iterator[pa.RecordBatch], out: _Rows, names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of (conv_id, *names) one after the other; tells ``out`` the type of the id."""
    for batch in batches:
        out.id_type = batch.schema.field("conv_id").type
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", *names)], strict=True)


class _Rows:
    """Output rows, handed on once they hold a moderate amount of text."""

    def __init__(self, names: tuple[str, ...], types: tuple[pa.DataType, ...]):
        self.names, self.types = names, types
        self.id_type = pa.int64()
        self.held: list[tuple] = []
        self.size = 0

    def add(self, conv: Any, size: int, *row: Any) -> Iterator[pa.RecordBatch]:
        self.held.append((conv, *row))
        self.size += size + 64
        if self.size >= PART:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            cols = [pa.array(c, t) for c, t in zip(
                zip(*self.held, strict=True), (self.id_type, *self.types), strict=True)]
            self.held, self.size = [], 0
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", *self.names])


def read_turns(formatted: str, controls: Controls = CONTROLS) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that a part of the default format holds."""
    at = formatted.find(TURN)
    while at >= 0:
        mid = formatted.index(TEXT, at)
        end = formatted.index(END, mid)
        yield (controls.unescape(formatted[at + len(TURN):mid]),
               controls.unescape(formatted[mid + len(TEXT):end]))
        at = formatted.find(TURN, end)


def digest(parts: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from their text and spans, one row for each.

    A checksum of a conversation takes its text in order: parts go through the task of their
    conversation one after the other, and only the checksums so far are kept.
    """

    def read(batches):
        out = _Rows(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"),
                    (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))
        rows = _read(batches, out, ("formatted", "spans"))
        for conv, own in groupby(rows, key=lambda x: x[0]):
            n, lost, size, turns, loss = 0, 0, 0, sha256(), sha256()
            for _, text, spans in own:
                size += len(text)
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    learnt = CONTROLS.unescape(text[s["start"]:s["end"]])
                    lost += len(learnt)
                    loss.update(learnt.encode())
            yield from out.add(conv, 0, n, turns.hexdigest(), lost, loss.hexdigest(), size)
        yield from out.rest()

    id_type = dict(parts.dtypes)["conv_id"]
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part").mapInArrow(
        read, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")


def oracle_sql() -> str:
    """What the conversations hold, and how long they are in the default format."""
    pattern = CONTROLS.pattern().replace("'", "''")
    one = len(TURN) + len(TEXT) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'),
    (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, length(role) + length(text) + {one}
  + len(regexp_extract_all(role, '{pattern}')) + len(regexp_extract_all(text, '{pattern}')) AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + {len("<s></s>")})::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
