"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures
that yield text chunk by chunk, each with the mark whether it lies in a generation block. The
language has ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}``/``elif``/``else``,
``{% set x = expression %}`` and ``{% generation %}``; expressions have literals, names, member
access by key, ``==``, ``!=``, ``in``, ``+``, ``and``, ``or``, ``not`` and the filters of
``FILTERS``. Values are looked up in mappings only: no Python attribute, call or import can be
reached, and the nesting of a template is bounded.

Control strings inside texts are escaped reversibly: every ``<`` with any backslashes and ``|``
gets one more backslash, so the output holds control strings only where the template puts them.

Conversations are read as a sorted stream. A worker holds one message at a time, so a conversation
of any length formats in bounded memory.

Edge cases: null roles and texts are empty; rows of a conversation are ordered by turn (null
first), then role and text; a null conv_id is a conversation of its own; ids may be of any type and other columns of
any name; a very long text is one message, held by one task; an empty table gives an empty result.
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
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepare

START, END = "<|im_start|>", "<|im_end|>"
CHATML = (
    "{% for m in messages %}" + START + "{{ m.role | role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | text }}{% endgeneration %}"
    "{% else %}{{ m.text | text }}{% endif %}" + END + "\n{% endfor %}"
)
MOST_NESTED = 50


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(text: str) -> str:
    """Also free of line feeds, which end a role."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"text": escape, "role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[.|\[\]()+]))""", re.S)
_WORDS = {"and", "or", "not", "in"}
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """A template that does not parse."""


class _Expression:
    """Recursive descent over one expression; nodes are ("const", v), ("name", n) or (operator, parts...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            self.tokens.append(next((k, t) for k, t in zip(("str", "int", "name", "op"), m.groups(), strict=True) if t is not None))
            at = m.end()
        self.at = self.depth = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        node = self.both()
        while self.take("or"):
            node = _fold("or", node, self.both())
        self.depth -= 1
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = _fold("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        turns = 0
        while self.take("not"):
            turns += 1
        node = self.compared()
        for _ in range(turns):
            node = _fold("not", node)
        return node

    def compared(self) -> tuple:
        node = self.added()
        while sign := self.take("==", "!=", "in"):
            node = _fold(sign, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = _fold("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = _fold("|" + name, node)
        return node

    def member(self) -> tuple:
        node = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                node = ("item", node, ("const", self.word()))
            else:
                node = ("item", node, self.either())
                self.need("]")
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(text))
        if kind == "name" and text not in _WORDS:
            return ("const", _CONSTANTS[text.lower()]) if text.lower() in _CONSTANTS else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _add(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _within(a: Any, b: Any) -> bool:
    return a in b if isinstance(b, (str, dict, list, tuple)) and (not isinstance(b, str) or isinstance(a, str)) else False


_BINARY: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": _add, "in": _within}


def _fold(kind: str, *parts: tuple) -> tuple:
    """The node, or its value where all parts are constants."""
    node = (kind, *parts)
    return ("const", _value(node)({})) if all(p[0] == "const" for p in parts) else node


def _value(node: tuple) -> Callable[[dict], Any]:
    """The closure of an expression node."""
    kind, *parts = node
    if kind == "const":
        return lambda scope: parts[0]
    if kind == "name":
        return lambda scope: scope.get(parts[0])
    run = [_value(p) for p in parts]
    if kind == "item":
        def item(scope: dict) -> Any:
            owner = run[0](scope)
            return owner.get(run[1](scope)) if isinstance(owner, dict) else None
        return item
    if kind == "and":
        return lambda scope: run[0](scope) and run[1](scope)
    if kind == "or":
        return lambda scope: run[0](scope) or run[1](scope)
    if kind == "not":
        return lambda scope: not run[0](scope)
    if kind[0] == "|":
        change = FILTERS[kind[1:]]
        return lambda scope: change(_text(run[0](scope)))
    combine = _BINARY[kind]
    return lambda scope: combine(run[0](scope), run[1](scope))


Chunks = Iterator[tuple[str, bool]]


class Template:
    """A compiled template; ``render`` yields (text, in a generation block)."""

    def __init__(self, source: str):
        self.parts = self._lex(source)
        self.at = 0
        tree, end = self._body(0)
        if end:
            raise TemplateError(f"unexpected {end!r}")
        self.tree = tree
        self._run = self._compile(tree)

    @staticmethod
    def _lex(source: str) -> list[tuple[str, str]]:
        parts, at = [], 0
        for m in _TAG.finditer(source):
            parts.append(("text", source[at : m.start()]))
            if m[0][:2] != "{#":
                parts.append(("out", m[1].strip()) if m[1] is not None else ("tag", m[2].strip()))
            if m[0][2] == "-":
                k = max(k for k, p in enumerate(parts) if p[0] == "text")
                parts[k] = ("text", parts[k][1].rstrip())
            at = m.end()
            if m[0][-3] == "-":
                at += len(source[at:]) - len(source[at:].lstrip())
        return [*parts, ("text", source[at:])]

    def _body(self, depth: int) -> tuple[list[tuple], str]:
        """Nodes up to a tag that ends or divides a block, and this tag."""
        if depth > MOST_NESTED:
            raise TemplateError("nested too deeply")
        nodes: list[tuple] = []

        def text(value: str) -> None:
            if nodes and nodes[-1][0] == "text":
                value = nodes.pop()[1] + value
            if value:
                nodes.append(("text", value))

        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                text(value)
            elif kind == "out":
                node = _Expression(value).whole()
                text(_text(node[1])) if node[0] == "const" else nodes.append(("out", node))
            else:
                word, _, rest = value.partition(" ")
                if word in ("endfor", "endif", "endgeneration", "else", "elif"):
                    return nodes, value
                if word == "if":
                    for node in self._branches(rest, depth):
                        text(node[1]) if node[0] == "text" else nodes.append(node)
                elif word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"not a loop: {value!r}")
                    body, end = self._body(depth + 1)
                    self._ended(end, "endfor")
                    nodes.append(("for", m[1], _Expression(m[2]).whole(), body))
                elif word == "set":
                    name, _, expression = rest.partition("=")
                    nodes.append(("set", name.strip(), _Expression(expression).whole()))
                elif word == "generation":
                    body, end = self._body(depth + 1)
                    self._ended(end, "endgeneration")
                    nodes.append(("generation", body))
                else:
                    raise TemplateError(f"no tag {word!r}")
        return nodes, ""

    @staticmethod
    def _ended(found: str, wanted: str) -> None:
        if found != wanted:
            raise TemplateError(f"expected {wanted!r}, found {found!r}")

    def _branches(self, condition: str, depth: int) -> list[tuple]:
        """An if node, or the body that a constant condition leaves."""
        test = _Expression(condition).whole()
        body, end = self._body(depth + 1)
        other: list[tuple] = []
        if end.startswith("elif"):
            other = self._branches(end[4:], depth + 1)
        else:
            if end == "else":
                other, end = self._body(depth + 1)
            self._ended(end, "endif")
        if test[0] == "const":
            return body if test[1] else other
        return [("if", test, body, other)]

    def _compile(self, nodes: list[tuple]) -> Callable[[dict, bool], Chunks]:
        """The closure of a list of nodes."""
        steps = [self._step(n) for n in nodes]

        def run(scope: dict, inside: bool) -> Chunks:
            for step in steps:
                yield from step(scope, inside)

        return run

    def _step(self, node: tuple) -> Callable[[dict, bool], Chunks]:
        kind = node[0]
        if kind == "text":
            return lambda scope, inside: iter(((node[1], inside),))
        if kind == "out":
            value = _value(node[1])
            return lambda scope, inside: iter(((_text(value(scope)), inside),))
        if kind == "generation":
            body = self._compile(node[1])
            return lambda scope, inside: body(scope, True)
        if kind == "if":
            test, yes, no = _value(node[1]), self._compile(node[2]), self._compile(node[3])
            return lambda scope, inside: (yes if test(scope) else no)(scope, inside)
        if kind == "set":
            value = _value(node[2])

            def assign(scope: dict, inside: bool) -> Chunks:
                scope[node[1]] = value(scope)
                return iter(())

            return assign
        value, body = _value(node[2]), self._compile(node[3])

        def loop(scope: dict, inside: bool) -> Chunks:
            items = iter(value(scope) or ())
            ahead, index = next(items, loop), 0
            while ahead is not loop:  # the function itself marks the end
                item, ahead = ahead, next(items, loop)
                inner = scope | {node[1]: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": ahead is loop}}
                yield from body(inner, inside)
                index += 1

        return loop

    def render(self, **scope: Any) -> Chunks:
        return self._run(scope, False)


class Reader:
    """Reads turns and generation blocks back from the formatted chunks."""

    def __init__(self) -> None:
        self.pending, self.span, self.inside = "", [], False
        self.turns = self.chars = self.loss_chars = 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, inside: bool) -> None:
        if inside != self.inside:
            self._close()
            self.inside = inside
        if inside:
            self.span.append(text)
        self.chars += len(text)
        self.pending += text
        if END in text:
            *turns, self.pending = self.pending.split(END + "\n") if self.pending.endswith("\n") else [self.pending]
            for turn in turns:
                role, _, body = turn.removeprefix(START).partition("\n")
                self.turns += 1
                self.turn_hash.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))

    def _close(self) -> None:
        text = unescape("".join(self.span))
        self.loss_chars += len(text)
        self.loss_hash.update(text.encode("utf-8", "surrogatepass"))
        self.span = []

    def result(self) -> tuple[int, str, int, str, int]:
        self._close()
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def format_messages(messages: Iterable[dict], template: str = CHATML) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of it under the loss mask."""
    out, spans, at, was = [], [], 0, False
    for text, inside in Template(template).render(messages=messages):
        if inside and was:
            spans[-1] = (spans[-1][0], at + len(text))
        elif inside:
            spans.append((at, at + len(text)))
        out.append(text)
        at, was = at + len(text), inside
    return "".join(out), spans


def format_conversations(rows: DataFrame, template: str = CHATML, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """conv_id with n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back."""
    prepare(rows.sparkSession)
    rows = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        stream = (
            (c, {"role": r, "text": t})
            for b in batches for c, r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
        done: list[tuple] = []
        for conv, group in groupby(stream, key=lambda x: x[0]):
            reader = Reader()
            for chunk, inside in compiled.render(messages=(m for _, m in group)):
                reader.feed(chunk, inside)
            done.append((conv, *reader.result()))
            if len(done) == 1000:
                yield pack(done)
                done = []
        yield pack(done)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [to_arrow_type(rows.schema["conv_id"].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def pack(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
