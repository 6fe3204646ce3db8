"""A small sandboxed template language, compiled to Python closures.

Statements: ``{% if e %} {% elif e %} {% else %} {% endif %}``,
``{% for x in e %} ... {% endfor %}`` (with ``loop.first``, ``loop.last``,
``loop.index``), ``{% set x = e %}`` and ``{% generation %} ... {% endgeneration %}``,
which marks the text that a model should learn to produce.  Expressions: string,
integer and boolean literals, names, ``a.b`` and ``a['b']`` on mappings and lists,
``==  !=  <  >  <=  >=  in  and  or  not  +  ~``, parentheses, and ``e | filter``
from a fixed set.

There are no calls and no Python attributes: a template reaches the values that
it is given and nothing else, and it can only loop over lists.  Source text is
parsed into a syntax tree, constant parts of which are folded before closures are
made; adjacent literal text is joined.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

Scope = dict[str, Any]


class TemplateError(ValueError):
    """The template can't be parsed, or asks for something that the sandbox lacks."""


# -- syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Op:
    op: str
    args: list[Any]


@dataclass
class Filter:
    name: str
    arg: Any


@dataclass
class Output:
    value: Any


@dataclass
class If:
    cases: list[tuple[Any, list[Any]]]


@dataclass
class For:
    name: str
    over: Any
    body: list[Any]


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list[Any]


# -- parser

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].|+~=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected text in an expression: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> bool:
        if self.peek()[1] in values and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self) -> Any:
        e = self.either()
        self.end()
        return e

    def either(self) -> Any:
        e = self.both()
        while self.take("or"):
            e = Op("or", [e, self.both()])
        return e

    def both(self) -> Any:
        e = self.negation()
        while self.take("and"):
            e = Op("and", [e, self.negation()])
        return e

    def negation(self) -> Any:
        return Op("not", [self.negation()]) if self.take("not") else self.comparison()

    def comparison(self) -> Any:
        e = self.total()
        kind, value = self.peek()
        if value in ("==", "!=", "<", ">", "<=", ">=") and kind == "op" or value == "in" and kind == "name":
            self.at += 1
            e = Op(value, [e, self.total()])
        return e

    def total(self) -> Any:
        e = self.filtered()
        while self.peek()[0] == "op" and self.peek()[1] in ("+", "~"):
            self.at += 1
            e = Op(self.tokens[self.at - 1][1], [e, self.filtered()])
        return e

    def filtered(self) -> Any:
        e = self.postfix()
        while self.take("|"):
            e = Filter(self.name(), e)
        return e

    def postfix(self) -> Any:
        e = self.atom()
        while True:
            if self.take("."):
                e = Item(e, Const(self.name()))
            elif self.take("["):
                e = Item(e, self.either())
                self.need("]")
            else:
                return e

    def atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(value))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value.lower()]) if value.lower() in ("true", "false", "none") else Name(value)
        if value == "(":
            e = self.either()
            self.need(")")
            return e
        raise TemplateError(f"unexpected {value or 'end of tag'!r}")


@dataclass
class _Open:
    kind: str
    node: Any
    body: list[Any] = field(default_factory=list)


def parse(source: str) -> list[Any]:
    """The syntax tree of a template: a list of statements."""
    stack = [_Open("template", None)]
    at = 0
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        if m[0].startswith(("{{-", "{%-")):
            text = text.rstrip()
        if text:
            stack[-1].body.append(Output(Const(text)))
        at = m.end()
        if m[0].endswith(("-}}", "-%}")):
            at += len(source[at:]) - len(source[at:].lstrip())
        if m[1] is not None:
            stack[-1].body.append(Output(_Expression(_tokens(m[1])).whole()))
        elif m[2] is not None:
            _statement(_Expression(_tokens(m[2])), stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1].kind} is not closed")
    if source[at:]:
        stack[0].body.append(Output(Const(source[at:])))
    return stack[0].body


def _statement(e: _Expression, stack: list[_Open]) -> None:
    word = e.name()
    if word == "if":
        stack.append(_Open("if", If([(e.either(), [])])))
        stack[-1].body = stack[-1].node.cases[0][1]
    elif word in ("elif", "else"):
        if stack[-1].kind != "if":
            raise TemplateError(f"{word} outside if")
        stack[-1].node.cases.append((e.either() if word == "elif" else Const(True), []))
        stack[-1].body = stack[-1].node.cases[-1][1]
    elif word == "for":
        name = e.name()
        e.need("in")
        node = For(name, e.either(), [])
        stack.append(_Open("for", node, node.body))
    elif word == "generation":
        node = Generation([])
        stack.append(_Open("generation", node, node.body))
    elif word == "set":
        name = e.name()
        e.need("=")
        stack[-1].body.append(Set(name, e.either()))
    elif word in ("endif", "endfor", "endgeneration"):
        if stack[-1].kind != word[3:]:
            raise TemplateError(f"{word} without {word[3:]}")
        done = stack.pop()
        stack[-1].body.append(done.node)
    else:
        raise TemplateError(f"unknown statement {word!r}")
    e.end()


# -- constant folding


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int, float)):
        return str(value)
    raise TemplateError("only text, numbers and truth values can be written")


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}
_FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple)) else 0,
    "string": _text,
}


def fold(node: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Any:
    """A tree with its constant parts evaluated; filters given by the caller count as constant functions."""
    if isinstance(node, list):
        out: list[Any] = []
        for n in (fold(x, filters) for x in node):
            if isinstance(n, If) and len(n.cases) == 1 and isinstance(n.cases[0][0], Const):
                out.extend(n.cases[0][1] if n.cases[0][0].value else [])
                continue
            out.append(n)
        joined: list[Any] = []
        for n in out:
            literal = isinstance(n, Output) and isinstance(n.value, Const)
            if literal and joined and isinstance(joined[-1], Output) and isinstance(joined[-1].value, Const):
                joined[-1] = Output(Const(_text(joined[-1].value.value) + _text(n.value.value)))
            elif not literal or _text(n.value.value):
                joined.append(n)
        return joined
    if isinstance(node, Op):
        args = [fold(a, filters) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            v = [a.value for a in args]
            return Const(not v[0] if node.op == "not" else (v[0] and v[1]) if node.op == "and" else (v[0] or v[1]) if node.op == "or" else _BINARY[node.op](*v))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        arg = fold(node.arg, filters)
        return Const(filters[node.name](arg.value)) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Output):
        return Output(fold(node.value, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        cases = []
        for test, body in node.cases:
            t = fold(test, filters)
            if isinstance(t, Const) and not t.value:
                continue
            cases.append((t, fold(body, filters)))
            if isinstance(t, Const):
                break
        return If(cases) if cases else If([(Const(False), [])])
    return node


# -- closures


class _Sink:
    __slots__ = ("parts", "size", "spans")

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        v = node.value
        return lambda scope: v
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: Scope) -> Any:
            box, k = of(scope), key(scope)
            if isinstance(box, dict):
                return box.get(k)
            if isinstance(box, (list, tuple)) and isinstance(k, int) and -len(box) <= k < len(box):
                return box[k]
            return None

        return item
    if isinstance(node, Filter):
        f, arg = filters[node.name], _value(node.arg, filters)
        return lambda scope: f(arg(scope))
    a, *rest = [_value(x, filters) for x in node.args]
    if node.op == "not":
        return lambda scope: not a(scope)
    b = rest[0]
    if node.op == "and":
        return lambda scope: a(scope) and b(scope)
    if node.op == "or":
        return lambda scope: a(scope) or b(scope)
    f2 = _BINARY[node.op]
    return lambda scope: f2(a(scope), b(scope))


def _body(nodes: list[Any], filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[Scope, _Sink], None]:
    steps = [_step(n, filters) for n in nodes]

    def run(scope: Scope, sink: _Sink) -> None:
        for s in steps:
            s(scope, sink)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any, filters: Mapping[str, Callable[[Any], Any]]) -> Callable[[Scope, _Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda scope, sink: sink.write(text)
        value = _value(node.value, filters)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, _value(node.value, filters)

        def put(scope: Scope, sink: _Sink) -> None:
            scope[name] = value(scope)

        return put
    if isinstance(node, If):
        cases = [(_value(t, filters), _body(b, filters)) for t, b in node.cases]

        def choose(scope: Scope, sink: _Sink) -> None:
            for test, body in cases:
                if test(scope):
                    body(scope, sink)
                    return

        return choose
    if isinstance(node, Generation):
        inner = _body(node.body, filters)

        def mark(scope: Scope, sink: _Sink) -> None:
            start = sink.size
            inner(scope, sink)
            sink.spans.append((start, sink.size))

        return mark
    over, inner, name = _value(node.over, filters), _body(node.body, filters), node.name

    def loop(scope: Scope, sink: _Sink) -> None:
        rows = over(scope)
        if not isinstance(rows, (list, tuple)):
            return
        own = dict(scope)
        last = len(rows) - 1
        for k, row in enumerate(rows):
            own[name] = row
            own["loop"] = {"first": k == 0, "last": k == last, "index": k + 1, "index0": k}
            inner(own, sink)

    return loop


class Template:
    """A compiled template; ``render`` gives the text and its generation spans in code points."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None):
        known = {**_FILTERS, **(filters or {})}
        self.tree = fold(parse(source), known)
        self._run = _body(self.tree, known)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        self._run(dict(values), sink)
        return "".join(sink.parts), sink.spans
