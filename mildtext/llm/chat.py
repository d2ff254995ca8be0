"""Conversations formatted by a compiled template, and read back.

A template is parsed into a syntax tree, constants are folded, and every node becomes a
Python closure that yields text with a mark whether a model is to learn it.  The language
is a sandbox: names and fields of the given data, literals, ``~ == != and or not``, four
filters, ``for``, ``if`` and ``generation``; no calls, no attributes of Python objects.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that steer a reader or a model; texts cannot hold them unescaped.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
TEMPLATE = (
    "{% for m in messages %}" + TURN + "{{ m.role | escape }}" + TEXT
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    + "{% else %}{{ m.text | escape }}{% endif %}" + END + "{{ '\\n' }}{% endfor %}"
)

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    r"""Double every ``\`` and put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}

# Yielded at the end of each pass of a loop: the output may be cut here.
CUT = ("", None)
Render = Callable[[dict], Iterator[tuple[str, bool | None]]]


class TemplateError(ValueError):
    """The template is not in the language."""


# --- expressions: ("const", value) ("field", (names)) ("filter", name, e) ("op", op, a, b) ("not", e)

_TOKEN = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)"
    r"|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>==|!=|~|\||\(|\)))"
)
_LETTERS = {"n": "\n", "t": "\t"}


class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def _next(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def _accept(self, *values: str) -> str | None:
        kind, value = self._next()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def parse(self) -> tuple:
        found = self._binary(("or",), lambda: self._binary(("and",), self._negated))
        if self._next()[0] != "end":
            raise TemplateError(f"unexpected {self._next()[1]!r}")
        return found

    def _binary(self, ops: tuple[str, ...], part: Callable[[], tuple]) -> tuple:
        left = part()
        while op := self._accept(*ops):
            left = fold(("op", op, left, part()))
        return left

    def _negated(self) -> tuple:
        if self._accept("not"):
            return fold(("not", self._negated()))
        return self._binary(("==", "!="), lambda: self._binary(("~",), self._filtered))

    def _filtered(self) -> tuple:
        found = self._atom()
        while self._accept("|"):
            kind, name = self._next()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            found = fold(("filter", name, found))
        return found

    def _atom(self) -> tuple:
        kind, value = self._next()
        self.at += 1
        if kind == "string":
            return ("const", re.sub(r"\\(.)", lambda m: _LETTERS.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value not in ("and", "or", "not"):
            names = tuple(value.split("."))
            if any(n.startswith("_") for n in names):
                raise TemplateError(f"no name {value!r}")
            return ("field", names)
        if (kind, value) == ("op", "("):
            found = self._binary(("or",), lambda: self._binary(("and",), self._negated))
            if not self._accept(")"):
                raise TemplateError("a ) is missing")
            return found
        raise TemplateError(f"unexpected {value!r}")


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def evaluator(e: tuple) -> Callable[[dict], Any]:
    """A closure for an expression."""
    if e[0] == "const":
        return lambda data, value=e[1]: value
    if e[0] == "field":

        def field(data: dict, names: tuple = e[1]) -> Any:
            for name in names:
                data = data.get(name) if isinstance(data, dict) else None
            return data

        return field
    if e[0] == "filter":
        inner, change = evaluator(e[2]), FILTERS[e[1]]
        return lambda data: change(_text(inner(data)))
    if e[0] == "not":
        inner = evaluator(e[1])
        return lambda data: not inner(data)
    left, right = evaluator(e[2]), evaluator(e[3])
    return {
        "~": lambda data: _text(left(data)) + _text(right(data)),
        "==": lambda data: left(data) == right(data),
        "!=": lambda data: left(data) != right(data),
        "and": lambda data: left(data) and right(data),
        "or": lambda data: left(data) or right(data),
    }[e[1]]


def fold(e: tuple) -> tuple:
    """A constant, if all parts of the expression are."""
    parts = [p for p in e[1:] if isinstance(p, tuple)]
    return ("const", evaluator(e)({})) if parts and all(p[0] == "const" for p in parts) else e


# --- nodes: ("text", s) ("show", e) ("for", name, e, body) ("if", [(e, body)...]) ("generation", body)

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def parse(template: str) -> list[tuple]:
    """Syntax tree of a template, constants folded."""
    tokens: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        tokens += [("text", template[at : m.start()]), ("show", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    tokens.append(("text", template[at:]))
    body, rest, end = _body(tokens, ())
    if end or rest:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _body(tokens: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[list[tuple], list, str]:
    nodes: list[tuple] = []
    while tokens:
        (kind, value), tokens = tokens[0], tokens[1:]
        if kind == "text":
            nodes.append(("text", value))
            continue
        if kind == "show":
            e = _Expression(value).parse()
            nodes.append(("text", _text(e[1])) if e[0] == "const" else ("show", e))
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return _joined(nodes), tokens, value
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read {value!r}")
            body, tokens, _ = _body(tokens, ("endfor",))
            nodes.append(("for", m[1], _Expression(m[2]).parse(), body))
        elif word == "generation":
            body, tokens, _ = _body(tokens, ("endgeneration",))
            nodes.append(("generation", body))
        elif word == "if":
            branches, test = [], _Expression(rest).parse()
            while True:
                body, tokens, end = _body(tokens, ("elif", "else", "endif"))
                branches.append((test, body))
                if end == "endif":
                    break
                word, _, rest = end.partition(" ")
                test = _Expression(rest).parse() if word == "elif" else ("const", True)
            live = []  # branches behind a constant truth never run, nor those with a constant untruth
            for test, body in branches:
                if test[0] != "const" or test[1]:
                    live.append((test, body))
                if test[0] == "const" and test[1]:
                    break
            if live and live[0][0][0] == "const":
                nodes += live[0][1]
            elif live:
                nodes.append(("if", live))
        else:
            raise TemplateError(f"no tag {value!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return _joined(nodes), [], ""


def _joined(nodes: list[tuple]) -> list[tuple]:
    """Neighbouring texts as one."""
    out: list[tuple] = []
    for is_text, run in groupby(nodes, lambda n: n[0] == "text"):
        run = list(run)
        out += [("text", text)] if is_text and (text := "".join(n[1] for n in run)) else [] if is_text else run
    return out


def compiled(template: str) -> Render:
    """Closure that renders data: yields (text, learned) and :data:`CUT` after each pass of a loop."""
    return _closure(parse(template), False)


def _closure(nodes: list[tuple], learned: bool) -> Render:
    steps = [_step(n, learned) for n in nodes]

    def run(data: dict) -> Iterator[tuple[str, bool | None]]:
        for step in steps:
            yield from step(data)

    return run


def _step(node: tuple, learned: bool) -> Render:
    if node[0] == "text":
        piece = (node[1], learned)
        return lambda data: (piece,)
    if node[0] == "show":
        value = evaluator(node[1])
        return lambda data: ((_text(value(data)), learned),)
    if node[0] == "generation":
        return _closure(node[1], True)
    if node[0] == "if":
        branches = [(evaluator(test), _closure(body, learned)) for test, body in node[1]]

        def choose(data: dict) -> Iterable:
            return next((body(data) for test, body in branches if test(data)), ())

        return choose
    name, items, body = node[1], evaluator(node[2]), _closure(node[3], learned)

    def loop(data: dict) -> Iterator[tuple[str, bool | None]]:
        for item in items(data) or ():
            yield from body({**data, name: item})
            yield CUT

    return loop


# --- on Spark

PARTS = "conv_id bigint, part bigint, formatted string, learned array<struct<start:bigint,end:bigint>>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (str, list)))
        if size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted conversations, a row per pass of the template's loop over ``messages``.

    ``conv_id``; ``part`` from 0; ``formatted``, to be joined in order of ``part``;
    ``learned``, the spans of that text (code points, end exclusive) that a model is to learn.  Turns go
    by ``turn``, then role and text, so ties and repeated rows have an order; nulls come
    first.  A null role or text is empty; rows of a null ``conv_id`` are one conversation.
    Conversations are streamed out of a sort: none is held whole, however long.
    """
    parsed = parse(template)  # a faulty template fails here, not in a task
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("learned", pa.list_(span))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        run = _closure(parsed, False)
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            messages = ({"role": role or "", "text": text or ""} for _, _, role, text in rows)
            part, texts, spans, at = 0, [], [], 0
            for text, learned in run({"messages": messages}):
                if learned is None:
                    yield conv, part, "".join(texts), spans
                    part, texts, spans, at = part + 1, [], [], 0
                    continue
                if learned and text:
                    if spans and spans[-1]["end"] == at:
                        spans[-1]["end"] += len(text)
                    else:
                        spans.append({"start": at, "end": at + len(text)})
                texts.append(text)
                at += len(text)
            if any(texts):
                yield conv, part, "".join(texts), spans

    ordered = (
        turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(lambda batches: _batches(render(batches), schema), PARTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its spans alone: ``conv_id``, ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    Reads the turn marks of :data:`TEMPLATE`; raises ``ValueError`` where a text does not
    have that form.
    """
    turn = re.compile(
        re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.S
    )
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, rows in groupby(_rows(batches), lambda r: r[0]):
            n, chars, loss_chars, rest = 0, 0, 0, ""
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, _, text, spans in rows:
                chars += len(text)
                for span in spans or ():
                    learned = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(learned)
                    loss.update(learned.encode())
                rest, at = rest + text, 0
                while found := turn.match(rest, at):
                    n, at = n + 1, found.end()
                    turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode())
                rest = rest[at:]
            if rest:
                raise ValueError(f"no turn: {rest[:80]!r}")
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(lambda batches: _batches(digest(batches), schema), ddl)
