"""Scalar operators of the expression language over Spark columns, with types known when they are bound.

Blank is null. Arithmetic passes blanks on; `=` holds between blanks; order comparisons with a blank are false; `&&`
and `||` are two-valued. A row error (a division by zero, say) makes the value null and its code the error column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import fail


@dataclass(frozen=True)
class Typed:
    column: Column
    dtype: str
    error: Column | None = None


def first_error(*errors: Column | None) -> Column | None:
    given = [e for e in errors if e is not None]
    return F.coalesce(*given) if len(given) > 1 else given[0] if given else None


def literal(value) -> Typed:
    dtype = ty.literal_type(value)
    return Typed(F.lit(value).cast(ty.SPARK_TYPE[dtype]), dtype)


def blank_value() -> Typed:
    return literal(None)


def cast(t: Typed, dtype: str) -> Column:
    return t.column if t.dtype == dtype else t.column.cast(ty.SPARK_TYPE[dtype])


def need_numbers(what: str, *args: Typed) -> None:
    for a in args:
        if a.dtype not in ty.NUMERIC and a.dtype != ty.NULL:
            fail("TYPE_MISMATCH", f"{what} takes numbers, not {a.dtype}")


def negate(a: Typed) -> Typed:
    need_numbers("-", a)
    return Typed(-cast(a, a.dtype if a.dtype != ty.NULL else ty.INTEGER), a.dtype if a.dtype != ty.NULL else ty.INTEGER, a.error)


def arithmetic(sign: str, a: Typed, b: Typed) -> Typed:
    need_numbers(sign, a, b)
    error = first_error(a.error, b.error)
    if sign == "/":
        zero = F.when(a.column.isNotNull() & (cast(b, ty.DECIMAL) == 0), F.lit("DIVISION_ERROR"))
        return Typed(F.try_divide(cast(a, ty.DECIMAL), cast(b, ty.DECIMAL)), ty.DECIMAL, first_error(error, zero))
    dtype = ty.DECIMAL if ty.DECIMAL in (a.dtype, b.dtype) else ty.INTEGER
    run = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[sign]
    if dtype == ty.DECIMAL:  # doubles don't overflow
        run = {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[sign]
    return Typed(run(cast(a, dtype), cast(b, dtype)), dtype, error)


def _comparable(a: Typed, b: Typed) -> tuple[Column, Column] | None:
    """Both sides in one type, or None for values that are never equal."""
    if ty.NULL in (a.dtype, b.dtype):
        dtype = a.dtype if b.dtype == ty.NULL else b.dtype
        return cast(a, dtype), cast(b, dtype)
    kinds = {a.dtype, b.dtype}
    if kinds <= ty.TEMPORAL and len(kinds) == 2:
        return F.to_date(a.column) if a.dtype == ty.DATE else a.column.cast("timestamp"), F.to_date(b.column) if b.dtype == ty.DATE else b.column.cast("timestamp")
    if ty.STRING in kinds and kinds & ty.TEMPORAL:  # dates are written as text
        dtype = (kinds & ty.TEMPORAL).pop()
        as_time = lambda t: t.column.try_cast(ty.SPARK_TYPE[dtype]) if t.dtype == ty.STRING else t.column.cast(ty.SPARK_TYPE[dtype])
        return as_time(a), as_time(b)
    return (a.column, b.column) if ty.family(a.dtype) == ty.family(b.dtype) else None


def same(a: Typed, b: Typed) -> Column:
    both = _comparable(a, b)
    return F.lit(False) if both is None else both[0].eqNullSafe(both[1])


def compare(sign: str, a: Typed, b: Typed) -> Typed:
    error = first_error(a.error, b.error)
    if sign in ("=", "<>"):
        eq = same(a, b)
        return Typed(eq if sign == "=" else ~eq, ty.BOOLEAN, error)
    both = _comparable(a, b)
    if both is None:
        return Typed(F.lit(False), ty.BOOLEAN, error)
    x, y = both
    test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[sign]
    return Typed(F.coalesce(test, F.lit(False)), ty.BOOLEAN, error)


def truth(a: Typed) -> Column:
    if a.dtype in ty.NUMERIC:
        return F.coalesce(a.column != 0, F.lit(False))
    if a.dtype == ty.BOOLEAN:
        return F.coalesce(a.column, F.lit(False))
    return F.coalesce(a.column.cast("string") != "", F.lit(False))


def logical(sign: str, a: Typed, b: Typed) -> Typed:
    x, y = truth(a), truth(b)
    error = a.error
    if b.error is not None:  # only where the right side is looked at
        error = first_error(a.error, F.when(x if sign == "&&" else ~x, b.error))
    return Typed(x & y if sign == "&&" else x | y, ty.BOOLEAN, error)


def choose(clauses: list[tuple[Column, Typed]], otherwise: Typed, error: Column | None) -> Typed:
    """The first clause whose test holds; only its error counts."""
    dtype = ty.common_type([v.dtype for _, v in clauses] + [otherwise.dtype])
    if dtype is None:
        fail("TYPE_MISMATCH", "the branches' types don't go together: " + ", ".join(sorted({v.dtype for _, v in clauses} | {otherwise.dtype})))
    value, wrong = None, None
    for test, v in clauses:
        value = (F if value is None else value).when(test, cast(v, dtype))
    if any(v.error is not None for v in [*(v for _, v in clauses), otherwise]):
        none = F.lit(None).cast("string")
        for test, v in clauses:
            wrong = (F if wrong is None else wrong).when(test, none if v.error is None else v.error)
        wrong = wrong.otherwise(none if otherwise.error is None else otherwise.error)
    return Typed(value.otherwise(cast(otherwise, dtype)), dtype, first_error(error, wrong))


def if_(args: list[Typed]) -> Typed:
    if len(args) not in (2, 3):
        fail("IF_INVALID_ARITY", f"IF takes 2 or 3 arguments, not {len(args)}")
    test = args[0]
    if test.dtype != ty.BOOLEAN:
        fail("IF_CONDITION_NOT_BOOLEAN", f"IF's condition is {test.dtype}")
    blank = F.when(test.column.isNull(), F.lit("IF_CONDITION_NOT_BOOLEAN"))
    return choose([(F.coalesce(test.column, F.lit(False)), args[1])], args[2] if len(args) == 3 else blank_value(), first_error(test.error, blank))


def switch(args: list[Typed]) -> Typed:
    if len(args) < 3:
        fail("INVALID_SWITCH_ARGUMENT", "SWITCH takes an expression and pairs of a value and a result")
    subject, rest = args[0], args[1:]
    otherwise = rest[-1] if len(rest) % 2 else blank_value()
    pairs = list(zip(rest[::2], rest[1::2], strict=False))
    return choose([(same(subject, v), r) for v, r in pairs], otherwise, first_error(subject.error, *[v.error for v, _ in pairs]))


def is_blank(args: list[Typed]) -> Typed:
    if len(args) != 1:
        fail("INVALID_FUNCTION_ARGUMENT", "ISBLANK takes one argument")
    return Typed(args[0].column.isNull(), ty.BOOLEAN, args[0].error)


def divide(args: list[Typed]) -> Typed:
    """Blank or the alternative where the divisor is blank or 0; a blank dividend gives blank."""
    if len(args) not in (2, 3):
        fail("INVALID_FUNCTION_ARGUMENT", "DIVIDE takes 2 or 3 arguments")
    need_numbers("DIVIDE", *args)
    n, d = cast(args[0], ty.DECIMAL), cast(args[1], ty.DECIMAL)
    other = cast(args[2], ty.DECIMAL) if len(args) == 3 else F.lit(None).cast("double")
    return Typed(F.when(d.isNull() | (d == 0), other).otherwise(F.try_divide(n, d)), ty.DECIMAL, first_error(*[a.error for a in args]))


def blank(args: list[Typed]) -> Typed:
    if args:
        fail("INVALID_FUNCTION_ARGUMENT", "BLANK takes no argument")
    return blank_value()


#: Functions that take scalars alone.
SCALAR = {"IF": if_, "SWITCH": switch, "BLANK": blank, "ISBLANK": is_blank, "DIVIDE": divide}


def operate(sign: str, a: Typed, b: Typed) -> Typed:
    if sign in ("&&", "||"):
        return logical(sign, a, b)
    return arithmetic(sign, a, b) if sign in "+-*/" else compare(sign, a, b)
