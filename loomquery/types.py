"""The logical column types and their Spark counterparts."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import types as T

STRING, INTEGER, DECIMAL, BOOLEAN, DATE, DATETIME, NULL, UNKNOWN = "string", "integer", "decimal", "boolean", "date", "datetime", "null", "unknown"
NUMERIC, TEMPORAL = {INTEGER, DECIMAL}, {DATE, DATETIME}

SPARK_TYPE = {
    STRING: T.StringType(), INTEGER: T.LongType(), DECIMAL: T.DoubleType(), BOOLEAN: T.BooleanType(),
    DATE: T.DateType(), DATETIME: T.TimestampType(), NULL: T.StringType(), UNKNOWN: T.StringType(),
}


def logical_type(spark_type: T.DataType) -> str:
    """The logical type of a Spark type; nested and binary types are unknown."""
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(spark_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return DECIMAL
    if isinstance(spark_type, T.BooleanType):
        return BOOLEAN
    if isinstance(spark_type, T.DateType):
        return DATE
    if isinstance(spark_type, (T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(spark_type, T.NullType):
        return NULL
    return STRING if isinstance(spark_type, (T.StringType, T.VarcharType, T.CharType)) else UNKNOWN


def literal_type(value: Any) -> str:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return INTEGER
    if isinstance(value, (float, decimal.Decimal)):
        return DECIMAL
    if isinstance(value, dt.datetime):
        return DATETIME
    if isinstance(value, dt.date):
        return DATE
    return STRING


def family(kind: str) -> str:
    """Types of one family can be compared."""
    return "number" if kind in NUMERIC else "time" if kind in TEMPORAL else kind


def common_type(kinds: list[str]) -> str | None:
    """The one type that values of all `kinds` fit, or None. Blank literals fit any."""
    known = [k for k in kinds if k != NULL]
    if not known:
        return NULL
    if all(k == known[0] for k in known):
        return known[0]
    return DECIMAL if all(k in NUMERIC for k in known) else None


def result_type(value: Any) -> str:
    """The type that a computed value shows: an integral number is an integer."""
    if isinstance(value, float) and value.is_integer():
        return INTEGER
    return literal_type(value)
