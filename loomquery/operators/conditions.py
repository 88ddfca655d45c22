"""The eleven comparison operators of filter and conditional steps, as Spark columns that are never null."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import fail

ORDERED = {"greater-than": ">", "greater-than-or-equal": ">=", "less-than": "<", "less-than-or-equal": "<="}
TEXT = {"contains", "starts-with", "ends-with"}
OPERATORS = {"equals", "not-equals", "is-blank", "is-not-blank", *ORDERED, *TEXT}


def as_column_type(value: Any, dtype: str) -> Column | None:
    """A literal in a column's type, or None if it has no such form."""
    kind = ty.literal_type(value)
    if kind == dtype or kind in ty.NUMERIC and dtype in ty.NUMERIC:
        return F.lit(value)
    if dtype in ty.TEMPORAL:
        try:
            when = dt.datetime.fromisoformat(value.isoformat() if isinstance(value, dt.date) else str(value))
        except ValueError:
            return None
        return F.lit(when.date()) if dtype == ty.DATE else F.lit(when.replace(tzinfo=None)).cast("timestamp_ntz").cast("timestamp")
    if kind == ty.STRING and dtype in ty.NUMERIC:
        try:
            return F.lit(float(value))
        except ValueError:
            return None
    return None


def text_of(c: Column, dtype: str) -> Column:
    """A value's text: whole decimals without a fraction, booleans in lower case."""
    if dtype == ty.DECIMAL:
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def matches(c: Column, dtype: str, operator: str, value: Any = None) -> Column:
    """Whether a cell meets a condition; blank cells meet `is-blank` alone."""
    if operator not in OPERATORS:
        fail("QUERY_INVALID_FILTER", f"there is no operator {operator!r}")
    empty = c == F.lit("") if dtype in (ty.STRING, ty.NULL, ty.UNKNOWN) else F.lit(False)
    blank = c.isNull() | F.coalesce(empty, F.lit(False))
    if operator == "is-blank":
        return blank
    if operator == "is-not-blank":
        return ~blank
    if value is None:
        return F.lit(False) if operator != "not-equals" else ~blank
    if operator in TEXT:
        own, sought = F.lower(text_of(c, dtype)), str(value).lower()
        test = {"contains": own.contains, "starts-with": own.startswith, "ends-with": own.endswith}[operator](sought)
    else:
        other = as_column_type(value, dtype)
        left = c
        if other is None:  # compared as text
            left, other = text_of(c, dtype), F.lit(str(value).lower() if isinstance(value, bool) else str(value))
        test = {"equals": left == other, "not-equals": left != other, "greater-than": left > other, "greater-than-or-equal": left >= other, "less-than": left < other, "less-than-or-equal": left <= other}[operator]
    return ~blank & F.coalesce(test, F.lit(False))
