"""Text of measure and column expressions to syntax trees.

Trees are plain hashable dataclasses, so contexts and plans can use them as keys. Loosest to tightest: `||`, `&&`,
`= <>`, `< <= > >=`, `+ -`, `* /`, unary `-`, then literals, calls, references and parentheses. `VAR ... RETURN ...`
stands wherever an expression does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

from ..diagnostics import fail


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Ref:
    """T[C], [C] (no table) or a bare name (no column)."""

    table: str | None
    column: str | None


@dataclass(frozen=True)
class Call:
    name: str  # upper case
    args: tuple


@dataclass(frozen=True)
class Binary:
    sign: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Negate:
    value: Any


@dataclass(frozen=True)
class Let:
    names: tuple[tuple[str, Any], ...]
    body: Any


TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>"(?:""|[^"])*"|'(?:''|[^'])*')|\[(?P<bracket>[^\[\]]*)\]|(?P<name>[A-Za-z_]\w*)|(?P<mark>\|\||&&|<>|<=|>=|[-+*/=<>(),]))""",
    re.X,
)
LEVELS = [("||",), ("&&",), ("=", "<>"), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/")]


class _Parser:
    def __init__(self, text: str):
        self.text, self.at, self.tokens = text, 0, []
        place = 0
        while text[place:].strip():
            m = TOKEN.match(text, place)
            if not m:
                bad = place + len(text[place:]) - len(text[place:].lstrip())
                fail("SYNTAX_ERROR", f"unexpected {text[bad]!r}", (bad, bad + 1))
            kind = m.lastgroup
            self.tokens.append((kind, m[kind], m.start(kind), m.end(kind)))
            place = m.end()
        self.tokens.append(("end", "", len(text), len(text)))

    def peek(self, ahead: int = 0):
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, value: str | None = None):
        t = self.peek()
        if value is not None and t[1] != value:
            fail("SYNTAX_ERROR", f"expected {value!r}, found {t[1] or 'the end'!r}", t[2:])
        self.at += 1
        return t

    def word(self, value: str) -> bool:
        return self.peek()[0] == "name" and self.peek()[1].upper() == value

    def whole(self):
        tree = self.expression()
        t = self.peek()
        if t[0] != "end":
            fail("SYNTAX_ERROR", f"unexpected {t[1]!r}", t[2:])
        return tree

    def expression(self):
        if self.word("VAR"):
            return self.let()
        return self.level(0)

    def let(self) -> Let:
        names = []
        while self.word("VAR"):
            self.take()
            kind, name, *span = self.take()
            if kind != "name":
                fail("INVALID_VARIABLE_NAME", f"{name!r} is no variable name", tuple(span))
            self.take("=")
            names.append((name.lower(), self.expression()))
        if not self.word("RETURN"):
            fail("SYNTAX_ERROR", "VAR needs RETURN", self.peek()[2:])
        self.take()
        return Let(tuple(names), self.expression())

    def level(self, n: int):
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek()[0] == "mark" and self.peek()[1] in LEVELS[n]:
            sign = self.take()[1]
            left = Binary(sign, left, self.level(n + 1))
        return left

    def unary(self):
        if self.peek()[:2] == ("mark", "-"):
            self.take()
            return Negate(self.unary())
        return self.primary()

    def primary(self):
        kind, got, *span = self.take()
        if kind == "number":
            return Literal(float(got) if "." in got else int(got))
        if kind == "text":
            if self.peek()[0] == "bracket" and got[0] == "'" and self.peek()[2] == span[1] + 1:
                return Ref(got[1:-1].replace("''", "'"), self.take()[1].strip())
            return Literal(got[1:-1].replace(got[0] * 2, got[0]))
        if kind == "bracket":
            return Ref(None, got.strip())
        if (kind, got) == ("mark", "("):
            tree = self.expression()
            self.take(")")
            return tree
        if kind == "name":
            if self.peek()[0] == "bracket":
                return Ref(got, self.take()[1].strip())
            if self.peek()[1] == "(" and self.peek()[0] == "mark":
                self.take()
                args = []
                while self.peek()[1] != ")" or self.peek()[0] != "mark":
                    args.append(self.expression())
                    if self.peek()[1] != ")":
                        self.take(",")
                self.take(")")
                name = got.upper()
                return Literal(name == "TRUE") if name in ("TRUE", "FALSE") and not args else Call(name, tuple(args))
            if got.upper() in ("TRUE", "FALSE"):
                return Literal(got.upper() == "TRUE")
            return Ref(got, None)
        return fail("SYNTAX_ERROR", f"unexpected {got or 'the end'!r}", tuple(span))


def parse(text: str):
    """The tree of an expression; EngineError with SYNTAX_ERROR and its place if there is none."""
    return _Parser(text).whole()


def walk(tree) -> Iterator:
    """All nodes of a tree, variables' values too."""
    yield tree
    parts = tree.names if isinstance(tree, Let) else ()
    children = [v for _, v in parts] + [getattr(tree, f.name) for f in fields(tree) if f.name in ("left", "right", "value", "body")]
    children += list(tree.args) if isinstance(tree, Call) else []
    for c in children:
        if isinstance(c, (Literal, Ref, Call, Binary, Negate, Let)):
            yield from walk(c)


def calls(tree) -> set[str]:
    return {n.name for n in walk(tree) if isinstance(n, Call)}


def references(tree) -> set[tuple[str | None, str]]:
    return {(n.table, n.column) for n in walk(tree) if isinstance(n, Ref) and n.column is not None}
