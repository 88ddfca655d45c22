"""Sources and sinks: Parquet, delimited text with inferred types, spreadsheets, rows in memory; and column profiles.

Type inference looks at all values of a column: their kinds and what can't be cast are counted in one pass. A column of which some value
doesn't fit the type that the others have stays text, and a warning says how many.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import Diagnostic, fail
from .workbooks import workbook

#: How values of each type look. Fixed values.
PATTERNS = [
    (ty.BOOLEAN, r"(?i)^(true|false)$"), (ty.INTEGER, r"^[+-]?\d+$"), (ty.DECIMAL, r"^[+-]?\d+\.\d+$"),
    (ty.DATETIME, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), (ty.DATE, r"^\d{4}-\d{2}-\d{2}$"),
]
BLANK = r"(?i)^(|null)$"


@dataclass
class Imported:
    df: DataFrame
    types: dict[str, str]
    diagnostics: list[Diagnostic] = field(default_factory=list)


def header(names: list[str | None]) -> list[str]:
    """Trimmed names; blank ones are Column1, Column2, ..., repeated ones get _2, _3, ..."""
    out: list[str] = []
    for i, n in enumerate(names):
        base = (n or "").strip() or f"Column{i + 1}"
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def _merged(kinds: set[str]) -> str:
    if not kinds:
        return ty.NULL
    if len(kinds) == 1:
        return next(iter(kinds))
    return ty.DECIMAL if kinds <= ty.NUMERIC else ty.DATETIME if kinds <= ty.TEMPORAL else ty.STRING


def inferred_types(df: DataFrame) -> tuple[dict[str, str], list[Diagnostic], int]:
    """(types, warnings, rows) of all-text columns: one pass over the table for all columns."""
    found = [F.count("*").alias("rows")]
    for i, name in enumerate(df.columns):
        c = F.trim(F.col(f"`{name}`"))
        kind = F.lit(ty.STRING)
        for k, pattern in reversed(PATTERNS):
            kind = F.when(c.rlike(pattern), k).otherwise(kind)
        kind = F.when(c.isNotNull() & ~c.rlike(BLANK), kind)
        found += [F.count(F.when(kind == k, 1)).alias(f"{k}{i}") for k in (ty.STRING, *dict(PATTERNS))]
        misfit = {ty.INTEGER: [ty.INTEGER], ty.DATE: [ty.DATE], ty.DATETIME: [ty.DATE, ty.DATETIME]}
        found += [F.count(F.when(kind.isin(of) & c.try_cast(ty.SPARK_TYPE[k]).isNull(), 1)).alias(f"bad_{k}{i}") for k, of in misfit.items()]
    row = df.agg(*found).first().asDict()
    types, notes = {}, []
    for i, name in enumerate(df.columns):
        counts = {k: row[f"{k}{i}"] for k in (ty.STRING, *dict(PATTERNS)) if row[f"{k}{i}"]}
        text = counts.pop(ty.STRING, 0)
        kind = _merged(set(counts)) if counts else ty.STRING if text else ty.NULL
        # A few values that look like text among others: the column looks like what the others are.
        bad = 0 if kind in (ty.STRING, ty.NULL) else text if text else row.get(f"bad_{kind}{i}", 0)
        if bad and 2 * bad < text + sum(counts.values()):
            notes.append(Diagnostic("QUERY_TYPE_CONVERSION_FAILED", f"{name} looks like {kind}, but {bad} values don't fit: it stays text", "warning", {"column": name, "type": kind, "count": bad}))
        types[name] = ty.STRING if bad else kind
    return types, notes, row["rows"]


def coerced(c: Column, dtype: str) -> Column:
    """Text in a type; null for blanks and for what doesn't fit."""
    c = F.when(~F.trim(c).rlike(BLANK), F.trim(c))
    if dtype in (ty.STRING, ty.NULL):
        return c
    if dtype == ty.BOOLEAN:
        return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    return c.try_cast(ty.SPARK_TYPE[dtype])


def typed(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> Imported:
    """All-text rows as a typed table: blank rows dropped, names made unique, types inferred and checked."""
    df = df.toDF(*header(df.columns))
    if max_columns and len(df.columns) > max_columns:
        fail("QUERY_COLUMN_LIMIT_EXCEEDED", f"{len(df.columns)} columns; {max_columns} are allowed")
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False))
    df = df.filter(filled)
    kinds, notes, rows = inferred_types(df)
    if max_rows and rows > max_rows:
        fail("QUERY_ROW_LIMIT_EXCEEDED", f"{rows} rows; {max_rows} are allowed")
    out = df.select(*[coerced(F.col(f"`{c}`"), k).alias(c) for c, k in kinds.items()])
    return Imported(out, kinds, notes)


def has_quoted_line_feeds(spark: SparkSession, path: str) -> bool:
    """Whether some line of a delimited file ends inside quotes: it has an odd number of them."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).filter(quotes % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool | None = None, **limits: Any) -> Imported:
    """A delimited file with a header, quotes doubled inside quotes, and line feeds inside quotes.

    Only files with such line feeds are read by one task each; a pass over the lines looks for them unless `multiline` says.
    """
    if multiline is None:
        multiline = has_quoted_line_feeds(spark, path)
    reader = lambda: spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=multiline)
    names = list(reader().csv(path).first() or [])
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    return typed(reader().schema(schema).options(header=True, enforceSchema=True).csv(path).toDF(*header(names)), **limits)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def from_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> Imported:
    """Rows in memory, all values as text."""
    text = [tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r) for r in rows]
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    return typed(spark.createDataFrame(text, schema).toDF(*header(names)))


def sheets(spark: SparkSession, path: str) -> list[str]:
    """The names of a workbook's sheets."""
    return list(workbook(spark, path).sheets)


def read_sheet(spark: SparkSession, path: str, sheet: str) -> Imported:
    """A workbook's sheet, first row as header."""
    rows = list(workbook(spark, path).rows(sheet))
    width = max(map(len, rows), default=0)
    names, *body = [tuple(r + [None] * (width - len(r))) for r in rows] or [()]
    if not width:
        fail("QUERY_NO_COLUMNS", f"the sheet {sheet!r} is empty")
    return from_rows(spark, list(names), body)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).format(kind).save(path)


def rounded(c: Column) -> Column:
    """Two digits; halves go away from zero."""
    return F.round(c, 2)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, row_count, null_count, null_percent, distinct_count, distinct_percent, min, max, mean, min_length,
    max_length, is_potential_key): a row for each column.

    Each column is grouped by its values, combined before the shuffle, and summed up from its groups: a columnar source
    reads each column once, and no row is repeated for each of them.
    """
    return functools.reduce(DataFrame.unionAll, [_column_profile(df, f.name, ty.logical_type(f.dataType)) for f in df.schema.fields])


def _column_profile(df: DataFrame, name: str, kind: str) -> DataFrame:
    groups = df.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n"))
    v, n = F.col("v"), F.col("n")
    filled = F.when(v.isNotNull(), n)
    ordered, text = kind in ty.NUMERIC | ty.TEMPORAL, kind == ty.STRING
    mean = F.sum(v.cast("double") * n) / F.sum(filled) if kind in ty.NUMERIC else F.lit(None)
    bound = lambda f, on: (f if on else F.lit(None))
    one = groups.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("filled"), F.count(v).alias("distinct"), bound(F.min(v), ordered).cast("string").alias("min"), bound(F.max(v), ordered).cast("string").alias("max"),
        mean.cast("double").alias("mean"), bound(F.min(F.length(v.cast("string"))), text).cast("long").alias("min_length"), bound(F.max(F.length(v.cast("string"))), text).cast("long").alias("max_length"),
    )
    rows, share = F.col("rows"), lambda x: F.when(F.col("rows") > 0, rounded(100.0 * x / F.col("rows"))).otherwise(0.0)
    return one.select(
        F.lit(name).alias("column"), F.lit(kind).alias("type"), rows.alias("row_count"), (rows - F.col("filled")).alias("null_count"), share(rows - F.col("filled")).alias("null_percent"),
        F.col("distinct").alias("distinct_count"), share(F.col("distinct")).alias("distinct_percent"), "min", "max", rounded(F.col("mean")).alias("mean"), "min_length", "max_length",
        ((rows > 0) & (F.col("filled") == rows) & (F.col("distinct") == rows)).alias("is_potential_key"),
    )
