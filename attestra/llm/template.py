"""Compiler for a sandboxed chat template language.

    text                      as it stands
    {{ expr }}                the value of an expression
    {% for x in expr %} ... {% endfor %}       with loop.index, loop.first, loop.last
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% set name = expr %}
    {% generation %} ... {% endgeneration %}   marks what a model is trained to write
    {# comment #}

Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']`` on
mappings, ``==  !=  ~  +  and  or  not  in``, parentheses, and filters ``expr | name``.
A template sees only the mappings it is given and the filters it is compiled with; there
are no calls and no access to Python attributes.

A template is parsed into tuples (kind, ...), constant parts are folded, and the tree
becomes nested Python closures that append to a list of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

Node = tuple
Filters = Mapping[str, Callable[[Any], Any]]

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~+|.()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    """The template does not follow the grammar, or uses what it was not given."""


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def accept(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is expected")

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.accept("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.accept("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> Node:
        return ("not", self.negation()) if self.accept("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while op := self.accept("==", "!=", "in"):
            node = (op, node, self.sum())
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while op := self.accept("~", "+"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> Node:
        node = self.path()
        while self.accept("|"):
            node = ("filter", self.name(), node)
        return node

    def path(self) -> Node:
        node = self.atom()
        while op := self.accept(".", "["):
            if op == ".":
                node = ("item", node, ("value", self.name()))
            else:
                node = ("item", node, self.either())
                self.expect("]")
        return node

    def atom(self) -> Node:
        if self.accept("("):
            node = self.either()
            self.expect(")")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("an expression is expected")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return ("value", int(text))
        if kind == "name":
            return ("value", _WORDS[text]) if text in _WORDS else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> Node:
    """Syntax tree of a template."""
    parts = [p for p in _TAGS.split(source) if p]
    at = 0

    def block(*ends: str) -> tuple[Node, str]:
        """Nodes up to one of the closing tags, and that tag's text."""
        nonlocal at
        nodes: list[Node] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                nodes.append(("print", _Expression(part[2:-2]).whole()))
                continue
            if not part.startswith("{%"):
                nodes.append(("text", part))
                continue
            tag = part[2:-2].strip()
            word = tag.split(None, 1)[0] if tag else ""
            if word in ends:
                return ("block", tuple(nodes)), tag
            nodes.append(statement(word, tag[len(word) :]))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return ("block", tuple(nodes)), ""

    def statement(word: str, rest: str) -> Node:
        if word == "for":
            e = _Expression(rest)
            name = e.name()
            e.expect("in")
            return ("for", name, e.whole(), block("endfor")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            if end == "endif":
                other: Node = ("block", ())
            elif end == "else":
                other = block("endif")[0]
            else:
                other = statement("if", end[len("elif") :])
            return ("if", _Expression(rest).whole(), body, other)
        if word == "set":
            e = _Expression(rest)
            name = e.name()
            e.expect("=")
            return ("set", name, e.whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word!r}")

    return block()[0]


_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "~": lambda a, b: _shown(a) + _shown(b),
    "+": lambda a, b: a + b,
}


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def fold(node: Node, filters: Filters) -> Node:
    """The tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in _OPERATORS:
        a, b = fold(node[1], filters), fold(node[2], filters)
        return ("value", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "value" else (kind, a, b)
    if kind in ("and", "or"):
        a, b = fold(node[1], filters), fold(node[2], filters)
        if a[0] == "value":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1], filters)
        return ("value", not a[1]) if a[0] == "value" else ("not", a)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        a = fold(node[2], filters)
        return ("value", filters[node[1]](a[1])) if a[0] == "value" else ("filter", node[1], a)
    if kind == "item":
        return ("item", fold(node[1], filters), fold(node[2], filters))
    if kind == "print":
        a = fold(node[1], filters)
        return ("text", _shown(a[1])) if a[0] == "value" else ("print", a)
    if kind == "if":
        test, body, other = (fold(n, filters) for n in node[1:])
        if test[0] == "value":
            return body if test[1] else other
        return ("if", test, body, other)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind == "block":
        out: list[Node] = []
        for child in (fold(n, filters) for n in node[1]):
            for n in child[1] if child[0] == "block" else (child,):
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                elif n != ("text", ""):
                    out.append(n)
        return ("block", tuple(out))
    return node


class _Output:
    """Pieces of text, their total length, and the spans under generation markers."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node: Node, filters: Filters) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        of, key = _value(node[1], filters), _value(node[2], filters)

        def item(scope: dict) -> Any:
            holder = of(scope)
            return holder.get(key(scope)) if isinstance(holder, Mapping) else None

        return item
    if kind == "filter":
        change, of = filters[node[1]], _value(node[2], filters)
        return lambda scope: change(of(scope))
    if kind == "not":
        of = _value(node[1], filters)
        return lambda scope: not of(scope)
    a, b = _value(node[1], filters), _value(node[2], filters)
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    apply = _OPERATORS[kind]
    return lambda scope: apply(a(scope), b(scope))


def _render(node: Node, filters: Filters) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.add(text)
    if kind == "print":
        value = _value(node[1], filters)
        return lambda scope, out: out.add(_shown(value(scope)))
    if kind == "set":
        name, value = node[1], _value(node[2], filters)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "block":
        parts = [_render(n, filters) for n in node[1]]

        def block(scope: dict, out: _Output) -> None:
            for part in parts:
                part(scope, out)

        return block
    if kind == "if":
        test, body, other = _value(node[1], filters), _render(node[2], filters), _render(node[3], filters)
        return lambda scope, out: body(scope, out) if test(scope) else other(scope, out)
    if kind == "generation":
        inner = _render(node[1], filters)

        def generation(scope: dict, out: _Output) -> None:
            start = out.length
            inner(scope, out)
            out.spans.append((start, out.length))

        return generation
    name, values, body = node[1], _value(node[2], filters), _render(node[3], filters)

    def loop(scope: dict, out: _Output) -> None:
        items = values(scope) or ()
        inner = dict(scope)
        for i, item in enumerate(items):
            inner[name] = item
            inner["loop"] = {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
            body(inner, out)

    return loop


def compile_template(source: str, filters: Filters) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a scope to (text, generation spans)."""
    run = _render(fold(parse(source), filters), filters)

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        run(dict(scope), out)
        return "".join(out.pieces), out.spans

    return render
