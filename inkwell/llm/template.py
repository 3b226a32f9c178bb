"""A small sandboxed template language for conversations, compiled to Python closures.

    text {{ expression }} {% if c %} {% elif d %} {% else %} {% endif %} {% for m in messages %} {% endfor %}
    {% generation %} {% endgeneration %} {# comment #}; a - inside a tag removes the white space on that side

Source is parsed into a syntax tree, constants are folded (given constants, operators and filters on constants, branches
that can't be taken, neighbouring texts), and each node that is left becomes a closure. There is one loop, over messages, and
no assignment: what a message renders to depends on itself, its index and the number of messages only, so that a long
conversation can be rendered in pieces. An expression sees the fields of its message, ``loop`` and the constants; there are no
Python attributes, calls or imports in the language, and strings can't be multiplied.

What lies within ``generation`` is marked: rendering returns the text and the spans that are trained on.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable

LOOP = ("index", "index0", "first", "last", "length")
TAG = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}", re.S)
TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~<>()\[\].,|]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class TemplateError(ValueError):
    """A template that is not of the language."""


def escape(text: str, *control: str) -> str:
    """text with a backslash before each backslash and control string; unescape() with the same strings turns it back."""
    return re.sub("|".join(map(re.escape, ("\\", *control))), lambda m: "\\" + m.group(), str(text))


def unescape(text: str, *control: str) -> str:
    return re.sub(r"\\(" + "|".join(map(re.escape, ("\\", *control))) + ")", lambda m: m.group(1), text)


FILTERS: dict[str, Callable] = {
    "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "trim": lambda x: str(x).strip(), "length": len, "string": str, "escape": escape,
    "replace": lambda x, old, new: str(x).replace(old, new), "default": lambda x, other: other if x is None else x,
}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        found = TOKEN.match(source, at)
        if not found:
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    return out


class Expression:
    """Recursive descent over the tokens of one tag; nodes are tuples (kind, ...)."""

    def __init__(self, source: str, constants: dict, fields: tuple[str, ...], message: str | None):
        self.tokens, self.at = _tokens(source), 0
        self.constants, self.fields, self.message = constants, fields, message

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"expected {wanted!r}")

    def parse(self) -> tuple:
        node = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def ternary(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            node = ("if", test, node, self.ternary())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        if sign := self.take(*COMPARE):
            return ("apply", COMPARE[sign], node, self.joined())
        inverse = self.take("not")
        if inverse or self.peek() == "in":
            self.need("in")
            node = ("apply", lambda a, b: a in b, node, self.joined())
        return ("not", node) if inverse else node

    def joined(self) -> tuple:
        node = self.summed()
        while self.take("~"):
            node = ("apply", lambda a, b: _shown(a) + _shown(b), node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.product()
        while sign := self.take("+", "-"):
            node = ("apply", operator.add if sign == "+" else _number(operator.sub), node, self.product())
        return node

    def product(self) -> tuple:
        node = self.filtered()
        while sign := self.take("*", "%"):
            node = ("apply", _number(operator.mul if sign == "*" else operator.mod), node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.primary()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            given = self.listed("(", ")") if self.peek() == "(" else []
            node = ("apply", FILTERS[name], node, *given)
        return node

    def listed(self, begin: str, end: str) -> list[tuple]:
        self.need(begin)
        out = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.ternary())
        return out

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def primary(self) -> tuple:
        if self.at == len(self.tokens):
            raise TemplateError("unexpected end")
        kind, value = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return ("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), value[1:-1], flags=re.S))
        if kind == "number":
            self.at += 1
            return ("constant", int(value))
        if self.take("("):
            node = self.ternary()
            self.need(")")
            return node
        if value == "[":
            return ("apply", lambda *x: list(x), *self.listed("[", "]"))
        if self.take("-"):
            return ("apply", _number(lambda a, b: a - b), ("constant", 0), self.primary())
        name = self.name()
        if name in ("true", "false", "none"):
            return ("constant", {"true": True, "false": False, "none": None}[name])
        if self.message is not None and name in (self.message, "loop"):
            if self.take("["):
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                self.at += 1
                if kind != "string":
                    raise TemplateError("a field is named by a string")
                field = value[1:-1]
                self.need("]")
            else:
                self.need(".")
                field = self.name()
            if field not in (LOOP if name == "loop" else self.fields):
                raise TemplateError(f"{name} has no {field!r}")
            return ("loop" if name == "loop" else "field", field)
        if name in self.constants:
            return ("constant", self.constants[name])
        raise TemplateError(f"unknown name {name!r}")


def _number(function: Callable) -> Callable:
    def checked(a, b):
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("this operator takes numbers")
        return function(a, b)

    return checked


def _shown(value) -> str:
    return "" if value is None else str(value)


def folded(node: tuple) -> tuple:
    """The same expression, with whatever depends on constants only worked out."""
    kind, *rest = node
    if kind in ("constant", "field", "loop"):
        return node
    if kind == "apply":
        parts = [folded(n) for n in rest[1:]]
        if all(p[0] == "constant" for p in parts):
            return ("constant", rest[0](*[p[1] for p in parts]))
        return ("apply", rest[0], *parts)
    parts = [folded(n) for n in rest]
    if parts[0][0] == "constant":
        value = parts[0][1]
        if kind == "not":
            return ("constant", not value)
        if kind == "if":
            return parts[1] if value else parts[2]
        return parts[1] if bool(value) == (kind == "and") else parts[0]
    return (kind, *parts)


def closure(node: tuple) -> Callable:
    """A function of (message, index from 0, number of messages)."""
    kind, *rest = node
    if kind == "constant":
        return lambda m, i, n, v=rest[0]: v
    if kind == "field":
        return lambda m, i, n, f=rest[0]: m[f]
    if kind == "loop":
        return {
            "index": lambda m, i, n: i + 1, "index0": lambda m, i, n: i, "first": lambda m, i, n: i == 0, "last": lambda m, i, n: i + 1 == n, "length": lambda m, i, n: n,
        }[rest[0]]
    if kind == "apply":
        function, parts = rest[0], [closure(p) for p in rest[1:]]
        if len(parts) == 1:
            return lambda m, i, n, p=parts[0]: function(p(m, i, n))
        return lambda m, i, n: function(*[p(m, i, n) for p in parts])
    parts = [closure(p) for p in rest]
    if kind == "not":
        return lambda m, i, n: not parts[0](m, i, n)
    if kind == "and":
        return lambda m, i, n: parts[0](m, i, n) and parts[1](m, i, n)
    if kind == "or":
        return lambda m, i, n: parts[0](m, i, n) or parts[1](m, i, n)
    return lambda m, i, n: parts[1](m, i, n) if parts[0](m, i, n) else parts[2](m, i, n)


class Template:
    """A compiled template: ``head``, ``body`` (for each message) and ``tail`` are lists of closures that write to a list."""

    def __init__(self, source: str, constants: dict | None = None, fields: tuple[str, ...] = ("role", "text")):
        self.constants, self.fields = constants or {}, fields
        self.tags = self._split(source)
        self.at = 0
        tree = simplified(self._block((), None, False))
        loops = [k for k, n in enumerate(tree) if n[0] == "for"]
        if len(loops) > 1:
            raise TemplateError("messages can be looped over once")
        at = loops[0] if loops else len(tree)
        self.head, self.body, self.tail = (writers(x) for x in (tree[:at], tree[at][1] if loops else [], tree[at + 1 :]))

    @staticmethod
    def _split(source: str) -> list[tuple[str, str]]:
        out, at, strip_next = [], 0, False
        for found in TAG.finditer(source):
            text, tag = source[at : found.start()], found.group()
            text = text.lstrip() if strip_next else text
            out.append(("text", text.rstrip() if tag[2:3] == "-" and tag[1] != "#" else text))
            strip_next, at = tag[-3:-2] == "-" and tag[1] != "#", found.end()
            if tag[1] != "#":
                out.append(("out", found.group(1)) if tag[1] == "{" else ("do", found.group(2).strip()))
        text = source[at:]
        out.append(("text", text.lstrip() if strip_next else text))
        if re.search(r"\{[{%#]|[%}#]\}", "".join(t for k, t in out if k == "text")):
            raise TemplateError("a tag is not closed")
        return [t for t in out if t[1] or t[0] != "text"]

    def _expression(self, source: str, message: str | None) -> tuple:
        return folded(Expression(source, self.constants, self.fields, message).parse())

    def _block(self, ends: tuple[str, ...], message: str | None, generation: bool) -> list[tuple]:
        """Nodes up to one of the tags ``ends``, which stays the next one."""
        out: list[tuple] = []
        while self.at < len(self.tags):
            kind, value = self.tags[self.at]
            word, _, rest = value.partition(" ") if kind == "do" else ("", "", "")
            if kind == "do" and word in ends:
                return out
            self.at += 1
            if kind == "text":
                out.append(("text", value))
            elif kind == "out":
                out.append(("out", self._expression(value, message)))
            elif word == "if":
                branches = [(self._expression(rest, message), self._block(("elif", "else", "endif"), message, generation))]
                while (tag := self._tag()).startswith("elif "):
                    branches.append((self._expression(tag[5:], message), self._block(("elif", "else", "endif"), message, generation)))
                last = self._block(("endif",), message, generation) if tag == "else" else []
                if tag == "else":
                    tag = self._tag()
                if tag != "endif":
                    raise TemplateError("if is not closed")
                out.append(("if", branches, last))
            elif word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not found or message is not None or ends:
                    raise TemplateError("the only loop is one over messages, at the top")
                if found.group(1) in ("loop", *self.constants):
                    raise TemplateError(f"{found.group(1)!r} has another meaning")
                out.append(("for", self._block(("endfor",), found.group(1), False)))
                if self._tag() != "endfor":
                    raise TemplateError("for is not closed")
            elif word == "generation":
                if generation:
                    raise TemplateError("generation within generation")
                out.append(("generation", self._block(("endgeneration",), message, True)))
                if self._tag() != "endgeneration":
                    raise TemplateError("generation is not closed")
            else:
                raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return out

    def _tag(self) -> str:
        self.at += 1
        return self.tags[self.at - 1][1] if self.at <= len(self.tags) else ""

    def render(self, messages: list[dict], first: int = 0, total: int | None = None) -> tuple[str, list[tuple[int, int]]]:
        """(text, generation spans in code points) of messages ``first``, ... of ``total``, all of them if not given."""
        total = len(messages) if total is None else total
        out: list[str] = []
        spans: list[tuple[int, int]] = []
        if first == 0:
            for write in self.head:
                write(None, 0, total, out, spans)
        for k, message in enumerate(messages, first):
            for write in self.body:
                write(message, k, total, out, spans)
        if first + len(messages) == total:
            for write in self.tail:
                write(None, total, total, out, spans)
        places = [0]
        for text in out:
            places.append(places[-1] + len(text))
        return "".join(out), [(places[a], places[b]) for a, b in spans]


def simplified(nodes: list[tuple]) -> list[tuple]:
    """Constant outputs as text, branches that can't be taken removed, neighbouring texts joined."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out" and node[1][0] == "constant":
            found = [("text", _shown(node[1][1]))]
        elif kind == "if":
            branches, last = [], simplified(node[2])
            for test, body in node[1]:
                if test[0] != "constant":
                    branches.append((test, simplified(body)))
                elif test[1]:
                    last = simplified(body)
                    break
            found = [("if", branches, last)] if branches else last
        elif kind in ("for", "generation"):
            found = [(kind, simplified(node[1]))]
        else:
            found = [node]
        for one in found:
            if one[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + one[1])
            elif one != ("text", ""):
                out.append(one)
    return out


def writers(nodes: list[tuple]) -> list[Callable]:
    """For each node a closure that appends to (texts, spans); a span is a pair of places in the list of texts."""
    out: list[Callable] = []
    for kind, *rest in nodes:
        if kind == "text":
            out.append(lambda m, i, n, texts, spans, v=rest[0]: texts.append(v))
        elif kind == "out":
            out.append(lambda m, i, n, texts, spans, f=closure(rest[0]): texts.append(_shown(f(m, i, n))))
        elif kind == "if":
            out.append(_branching([(closure(t), writers(b)) for t, b in rest[0]], writers(rest[1])))
        elif kind == "generation":
            out.append(_marking(writers(rest[0])))
        else:
            raise TemplateError("the only loop is one over messages, at the top")
    return out


def _branching(branches: list[tuple[Callable, list[Callable]]], last: list[Callable]) -> Callable:
    def write(m, i, n, texts, spans):
        for write in next((body for test, body in branches if test(m, i, n)), last):
            write(m, i, n, texts, spans)

    return write


def _marking(body: list[Callable]) -> Callable:
    def write(m, i, n, texts, spans):
        begin = len(texts)
        for write in body:
            write(m, i, n, texts, spans)
        spans.append((begin, len(texts)))

    return write
