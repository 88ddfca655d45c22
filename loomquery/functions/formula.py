"""The custom-column language: column arithmetic, text joining, comparison, `if`, and a few functions.

A formula compiles to one Spark column and one error column, which holds the code of the row's first error or null.
So a formula stays inside code generation, and errors are data until the step decides what to do with them.

Grammar, from the loosest: comparison, `&`, `+ -`, `* /`, unary `-`, then literals, [Column], calls, parentheses and
`if c then a else b`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import fail
from ..operators.conditions import text_of
from ..operators.frame import Frame

PARSE, MISSING, TYPE, ZERO = "QUERY_CUSTOM_PARSE_ERROR", "QUERY_CUSTOM_COLUMN_NOT_FOUND", "QUERY_CUSTOM_TYPE_ERROR", "QUERY_CUSTOM_DIVIDE_BY_ZERO"
TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>"(?:\\.|[^"\\])*")|\[(?P<column>[^\]]*)\]|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(?P<mark><>|<=|>=|[-+*/&=<>(),]))""",
    re.X,
)
LEVELS = [("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/")]
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Value:
    column: Column
    dtype: str
    error: Column | None = None


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            fail(PARSE, f"unexpected character at {at}: {text[at:].lstrip()[:1]!r}", span=(at, at + 1))
        kind = m.lastgroup
        out.append((kind, m[kind], m.start(kind)))
        at = m.end()
    return [*out, ("end", "", len(text))]


class _Parser:
    """Builds tuples: ("number", v), ("text", v), ("column", name), ("call", name, args), ("op", sign, a, b), ("minus", a), ("if", c, a, b), ("literal", v)."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.at]

    def take(self, value: str | None = None) -> tuple[str, str, int]:
        kind, got, place = self.tokens[self.at]
        if value is not None and got.lower() != value:
            fail(PARSE, f"expected {value!r} at {place}, found {got or 'the end'!r}", span=(place, place + len(got)))
        self.at += 1
        return kind, got, place

    def whole(self) -> tuple:
        tree = self.level(0)
        kind, got, place = self.peek()
        if kind != "end":
            fail(PARSE, f"unexpected {got!r} at {place}", span=(place, place + len(got)))
        return tree

    def level(self, n: int) -> tuple:
        if n == len(LEVELS):
            return self.unary()
        left = self.level(n + 1)
        while self.peek()[0] == "mark" and self.peek()[1] in LEVELS[n]:
            sign = self.take()[1]
            left = ("op", sign, left, self.level(n + 1))
        return left

    def unary(self) -> tuple:
        if self.peek()[:2] == ("mark", "-"):
            self.take()
            return ("minus", self.unary())
        return self.primary()

    def primary(self) -> tuple:
        kind, got, place = self.take()
        if kind == "number":
            return ("literal", float(got) if "." in got else int(got))
        if kind == "text":
            return ("literal", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), got[1:-1], flags=re.S))
        if kind == "column":
            return ("column", got)
        if (kind, got) == ("mark", "("):
            tree = self.level(0)
            self.take(")")
            return tree
        if kind == "name":
            word = got.lower()
            if word == "if":
                test = self.level(0)
                self.take("then")
                yes = self.level(0)
                self.take("else")
                return ("if", test, yes, self.level(0))
            if word in ("true", "false", "null"):
                return ("literal", {"true": True, "false": False, "null": None}[word])
            if self.peek()[1] == "(":
                self.take()
                args = []
                while self.peek()[1] != ")":
                    args.append(self.level(0))
                    if self.peek()[1] != ")":
                        self.take(",")
                self.take(")")
                return ("call", got, args)
        return fail(PARSE, f"unexpected {got or 'the end'!r} at {place}", span=(place, place + len(got)))


def _first(*errors: Column | None) -> Column | None:
    given = [e for e in errors if e is not None]
    return F.coalesce(*given) if len(given) > 1 else given[0] if given else None


def _when(test: Column, code: str) -> Column:
    return F.when(test, F.lit(code))


def _number(v: Value) -> Column | None:
    """The error of an operand that must be a number; blanks are errors too."""
    if v.dtype not in ty.NUMERIC:
        return F.lit(TYPE)
    return _when(v.column.isNull(), TYPE)


def _shown(v: Value) -> Column:
    return F.coalesce(text_of(v.column, v.dtype), F.lit(""))


def _arithmetic(sign: str, a: Value, b: Value) -> Value:
    error = _first(a.error, b.error, _number(a), _number(b))
    if a.dtype not in ty.NUMERIC or b.dtype not in ty.NUMERIC:
        return Value(F.lit(None).cast("double"), ty.DECIMAL, error)
    if sign == "/":
        return Value(F.try_divide(a.column.cast("double"), b.column.cast("double")), ty.DECIMAL, _first(error, _when(b.column == 0, ZERO)))
    dtype = ty.INTEGER if a.dtype == b.dtype == ty.INTEGER else ty.DECIMAL
    run = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign]
    kind = "bigint" if dtype == ty.INTEGER else "double"
    return Value(run(a.column.cast(kind), b.column.cast(kind)), dtype, error)


def _compare(sign: str, a: Value, b: Value) -> Value:
    error = _first(a.error, b.error)
    left, right = a.column, b.column
    if ty.family(a.dtype) != ty.family(b.dtype) and ty.NULL not in (a.dtype, b.dtype):
        left, right = _shown(a), _shown(b)
    elif ty.NULL in (a.dtype, b.dtype):
        dtype = a.dtype if b.dtype == ty.NULL else b.dtype
        left, right = left.cast(ty.SPARK_TYPE[dtype]), right.cast(ty.SPARK_TYPE[dtype])
    if sign in ("=", "<>"):
        same = left.eqNullSafe(right)
        return Value(same if sign == "=" else ~same, ty.BOOLEAN, error)
    test = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[sign]
    return Value(test, ty.BOOLEAN, _first(error, _when(a.column.isNull() | b.column.isNull(), TYPE)))


def _call(name: str, args: list[Value]) -> Value:
    word = name.lower()
    arity = {"number.round": (1, 2)}.get(word, (1, 1))
    if word not in FUNCTIONS:
        fail(PARSE, f"there is no function {name}")
    if not arity[0] <= len(args) <= arity[1]:
        fail(PARSE, f"{name} takes {arity[0]} to {arity[1]} arguments, not {len(args)}")
    error, a = _first(*[x.error for x in args]), args[0]
    kind, run, dtype = FUNCTIONS[word]
    if kind == "text":
        own = F.lit(TYPE) if a.dtype not in (ty.STRING, ty.NULL) else None
        return Value(run(F.coalesce(a.column.cast("string"), F.lit(""))), dtype, _first(error, own))
    if kind == "date":
        own = F.lit(TYPE) if a.dtype not in (ty.DATE, ty.DATETIME, ty.STRING) else _when(_as_date(a).isNull(), TYPE)
        return Value(run(_as_date(a)).cast("bigint"), dtype, _first(error, own))
    error = _first(error, *[_number(x) for x in args])
    if any(x.dtype not in ty.NUMERIC for x in args):
        return Value(F.lit(None).cast("double"), ty.DECIMAL, error)
    if word == "number.abs":
        return Value(F.abs(a.column), a.dtype, error)
    # Half goes towards plus infinity, unlike Spark's round.
    scale = F.pow(F.lit(10.0), args[1].column) if len(args) == 2 else F.lit(1.0)
    rounded = F.floor(a.column.cast("double") * scale + 0.5) / scale
    whole = len(args) == 1
    return Value(rounded.cast("bigint") if whole else rounded.cast("double"), ty.INTEGER if whole else ty.DECIMAL, error)


def _as_date(v: Value) -> Column:
    return F.to_date(F.substring(v.column, 1, 10).try_cast("date")) if v.dtype == ty.STRING else F.to_date(v.column)


FUNCTIONS: dict[str, tuple[str, Any, str]] = {
    "text.trim": ("text", F.trim, ty.STRING), "text.upper": ("text", F.upper, ty.STRING), "text.lower": ("text", F.lower, ty.STRING), "text.length": ("text", lambda c: F.length(c).cast("bigint"), ty.INTEGER),
    "number.abs": ("number", None, ty.DECIMAL), "number.round": ("number", None, ty.DECIMAL),
    "date.year": ("date", F.year, ty.INTEGER), "date.month": ("date", F.month, ty.INTEGER), "date.day": ("date", F.dayofmonth, ty.INTEGER),
}


def _compile(tree: tuple, frame: Frame) -> Value:
    kind = tree[0]
    if kind == "literal":
        dtype = ty.literal_type(tree[1])
        return Value(F.lit(tree[1]).cast(ty.SPARK_TYPE[dtype]), dtype)
    if kind == "column":
        for c in frame.cols:
            if c.name.lower() == tree[1].strip().lower():
                return Value(frame.col(c.id), c.dtype)
        return fail(MISSING, f"there is no column [{tree[1]}]", column=tree[1])
    if kind == "minus":
        a = _compile(tree[1], frame)
        return Value(-a.column if a.dtype in ty.NUMERIC else F.lit(None).cast("double"), a.dtype if a.dtype in ty.NUMERIC else ty.DECIMAL, _first(a.error, _number(a)))
    if kind == "call":
        return _call(tree[1], [_compile(x, frame) for x in tree[2]])
    if kind == "if":
        test, yes, no = (_compile(x, frame) for x in tree[1:])
        wrong = F.lit(TYPE) if test.dtype != ty.BOOLEAN else _when(test.column.isNull(), TYPE)
        dtype = ty.common_type([yes.dtype, no.dtype])
        if dtype is None:
            fail(TYPE, f"the branches of `if` have types {yes.dtype} and {no.dtype}")
        to = ty.SPARK_TYPE[dtype]
        holds = test.column if test.dtype == ty.BOOLEAN else F.lit(False)
        branch = None
        if yes.error is not None or no.error is not None:
            nothing = F.lit(None).cast("string")
            branch = F.when(holds, nothing if yes.error is None else yes.error).otherwise(nothing if no.error is None else no.error)
        return Value(F.when(holds, yes.column.cast(to)).otherwise(no.column.cast(to)), dtype, _first(test.error, wrong, branch))
    _, sign, left, right = tree
    a, b = _compile(left, frame), _compile(right, frame)
    if sign == "&":
        return Value(F.concat(_shown(a), _shown(b)), ty.STRING, _first(a.error, b.error))
    return _arithmetic(sign, a, b) if sign in "+-*/" else _compare(sign, a, b)


def compiled(text: str, frame: Frame) -> Value:
    """A formula as a column over a frame, its type, and the column of its row errors (None: it can't fail)."""
    return _compile(_Parser(text).whole(), frame)
