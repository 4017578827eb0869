"""A small sandboxed template language, compiled to Python closures.

Source -> tokens -> syntax tree -> folded tree -> closures.  A template sees the
names it is given and nothing else: a dot or an index reads a mapping's key,
there are no calls, and filters come from a fixed table.

    {{ expr }}    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for name in expr %} {% endfor %}    {% set name = expr %}
    {% generation %} {% endgeneration %}   the text between is marked

Expressions: strings, integers, true/false/none, names, ``a.b``, ``a[b]``,
``| filter``, ``~`` (concatenation), ``+ -``, ``== != < > <= >=``, ``in``,
``not``, ``and``, ``or``.  In a loop ``loop.first``, ``loop.last`` and
``loop.index0`` are set.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """The template is malformed or asks for something that isn't there."""


# Syntax tree ---------------------------------------------------------------


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
class Filtered:
    of: Any
    name: str


@dataclass(frozen=True)
class Unary:
    of: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Choice:
    cases: tuple[tuple[Any, tuple], ...]
    otherwise: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Marked:
    body: tuple


# Parsing -------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_WORD = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>.\[\]()|~+\-=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in", *_LITERALS}
_COMPARE = {"==", "!=", "<", ">", "<=", ">=", "in"}


class _Expression:
    def __init__(self, text: str):
        self.words, at, text = [], 0, text.strip()
        while at < len(text):
            m = _WORD.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, word = self.words[self.at] if self.at < len(self.words) else (None, None)
        return word if kind in ("op", "name") else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, *wanted: str) -> None:
        if not self.take(*wanted):
            raise TemplateError(f"expected {' or '.join(wanted)}")

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name" or self.words[self.at][1] in _KEYWORDS:
            raise TemplateError("expected a name")
        self.at += 1
        return self.words[self.at - 1][1]

    def done(self):
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Binary("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Binary("and", left, self.negated())
        return left

    def negated(self):
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take(*_COMPARE):
            left = Binary(op, left, self.joined())
        return left

    def joined(self):
        left = self.filtered()
        while op := self.take("~", "+", "-"):
            left = Binary(op, left, self.filtered())
        return left

    def filtered(self):
        left = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                left = Item(left, Const(self.name()))
            elif op == "[":
                left = Item(left, self.either())
                self.need("]")
            else:
                left = Filtered(left, self.name())
        return left

    def atom(self):
        if self.take("("):
            inner = self.either()
            self.need(")")
            return inner
        if self.at >= len(self.words):
            raise TemplateError("expression ends early")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Const(int(word))
        if word in _LITERALS:
            return Const(_LITERALS[word])
        if kind == "name" and word not in _KEYWORDS:
            return Name(word)
        raise TemplateError(f"unexpected {word!r}")


def _expression(text: str):
    parser = _Expression(text)
    tree = parser.either()
    parser.done()
    return tree


def parse(source: str) -> tuple:
    """The template's statements."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("value", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def body(*ends: str) -> tuple[tuple, str]:
        out: list = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                out.append(Output(Const(text)))
                continue
            if kind == "value":
                out.append(Output(_expression(text)))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), text
            if word == "if":
                cases, otherwise, test = [], (), rest
                while True:
                    inner, end = body("elif", "else", "endif")
                    cases.append((_expression(test), inner))
                    if end.startswith("elif"):
                        test = end[4:]
                        continue
                    if end == "else":
                        otherwise, _ = body("endif")
                    break
                out.append(Choice(tuple(cases), otherwise))
            elif word == "for":
                parser = _Expression(rest)
                name = parser.name()
                parser.need("in")
                over = parser.either()
                parser.done()
                out.append(Loop(name, over, body("endfor")[0]))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq:
                    raise TemplateError("set needs =")
                parser = _Expression(name)
                out.append(Assign(parser.name(), _expression(value)))
            elif word == "generation":
                out.append(Marked(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(out), ""

    return body()[0]


# Folding -------------------------------------------------------------------

_OPS: dict[str, Callable] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    ">": operator.gt,
    "<=": operator.le,
    ">=": operator.ge,
    "+": operator.add,
    "-": operator.sub,
    "~": lambda a, b: _text(a) + _text(b),
    "in": lambda a, b: a in b,
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node, filters: Mapping[str, Callable]):
    """The same tree with constant parts computed and adjacent constant texts joined."""
    if isinstance(node, tuple):
        out: list = []
        flat: list = []
        for n in node:
            folded = fold(n, filters)
            flat.extend(folded if isinstance(folded, tuple) else (folded,))
        for part in flat:
            if isinstance(part, Output) and isinstance(part.value, Const):
                text = _text(part.value.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                    text = out.pop().value.value + text
                if text:
                    out.append(Output(Const(text)))
            else:
                out.append(part)
        return tuple(out)
    if isinstance(node, Output):
        return Output(fold(node.value, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    if isinstance(node, Marked):
        return Marked(fold(node.body, filters))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Choice):
        cases = []
        for test, inner in node.cases:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            if isinstance(test, Const):
                return Choice(tuple(cases), fold(inner, filters)) if cases else fold(inner, filters)
            cases.append((test, fold(inner, filters)))
        return Choice(tuple(cases), fold(node.otherwise, filters)) if cases else fold(node.otherwise, filters)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Filtered):
        of = fold(node.of, filters)
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filtered(of, node.name)
    if isinstance(node, Unary):
        of = fold(node.of, filters)
        return Const(not of.value) if isinstance(of, Const) else Unary(of)
    if isinstance(node, Binary):
        left, right = fold(node.left, filters), fold(node.right, filters)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        if node.op not in ("and", "or") and isinstance(left, Const) and isinstance(right, Const):
            return Const(_OPS[node.op](left.value, right.value))
        return Binary(node.op, left, right)
    return node


# Closures ------------------------------------------------------------------


def _value(node, filters) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def read(env):
            try:
                return env[name]
            except KeyError:
                raise TemplateError(f"no name {name!r}") from None

        return read
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(env):
            held, k = of(env), key(env)
            if isinstance(held, Mapping):
                return held.get(k)
            if isinstance(held, (list, tuple, str)) and isinstance(k, int):
                return held[k] if -len(held) <= k < len(held) else None
            raise TemplateError(f"no item {k!r}")

        return item
    if isinstance(node, Filtered):
        of, f = _value(node.of, filters), filters[node.name]
        return lambda env: f(of(env))
    if isinstance(node, Unary):
        of = _value(node.of, filters)
        return lambda env: not of(env)
    left, right = _value(node.left, filters), _value(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    op = _OPS[node.op]
    return lambda env: op(left(env), right(env))


class _Sink:
    __slots__ = ("at", "parts", "spans")

    def __init__(self):
        self.parts, self.spans, self.at = [], [], 0

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def _body(nodes: tuple, filters) -> Callable[[dict, _Sink], None]:
    steps = tuple(_statement(n, filters) for n in nodes)

    def run(env, sink):
        for step in steps:
            step(env, sink)

    return run


def _statement(node, filters) -> Callable[[dict, _Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda env, sink: sink.put(text)
        value = _value(node.value, filters)
        return lambda env, sink: sink.put(_text(value(env)))
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value, filters)

        def assign(env, sink):
            env[name] = value(env)

        return assign
    if isinstance(node, Marked):
        inner = _body(node.body, filters)

        def mark(env, sink):
            begin = sink.at
            inner(env, sink)
            sink.spans.append((begin, sink.at))

        return mark
    if isinstance(node, Choice):
        cases = tuple((_value(t, filters), _body(b, filters)) for t, b in node.cases)
        otherwise = _body(node.otherwise, filters)

        def choose(env, sink):
            for test, inner in cases:
                if test(env):
                    return inner(env, sink)
            return otherwise(env, sink)

        return choose
    name, over, inner = node.name, _value(node.over, filters), _body(node.body, filters)

    def loop(env, sink):
        held = over(env)
        if not isinstance(held, Sequence):
            raise TemplateError("can loop over lists only")
        own = dict(env)
        for k, x in enumerate(held):
            own[name] = x
            own["loop"] = {"first": k == 0, "last": k == len(held) - 1, "index0": k}
            inner(own, sink)

    return loop


Render = Callable[[dict], tuple[str, list[tuple[int, int]]]]


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]]) -> Render:
    """A function from names to the rendered text and its marked spans (code points, end exclusive)."""
    run = _body(fold(parse(source), filters), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        run(dict(names), sink)
        return "".join(sink.parts), sink.spans

    return render
