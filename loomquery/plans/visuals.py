"""Visual queries: KPI, bar, line, table and slicer, each one lazy plan over all members and measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import Diagnostic, EngineError, fail
from .context import EMPTY, Context
from .measures import Plan, cell, checked, col, evaluate, grouped
from .model import Model

#: How many members a visual shows. Fixed values.
LIMITS = {"bar": 30, "line": 100, "table": 100, "slicer": 200}


@dataclass(frozen=True)
class Visual:
    """`kind`: kpi, bar, line, table or slicer. `sort`: for a bar value-desc, value-asc, category-asc or category-desc;
    for a line axis-asc or axis-desc."""

    kind: str
    measures: tuple[str, ...] = ()
    dimension: tuple[str, str] | None = None
    sort: str | None = None
    limit: int | None = None


def require_measures(model: Model, names) -> dict[str, str]:
    found = {}
    for n in names:
        m = model.measure(n)
        if not m:
            fail("UNKNOWN_MEASURE", f"there is no measure [{n}]")
        found[m[0]] = f"[{m[0]}]"
    return found


def preflight(model: Model, v: Visual, ctx: Context = EMPTY) -> list[Diagnostic]:
    """What keeps a visual from being drawn, found without running it."""
    try:
        model.require_valid_graph()
        names = require_measures(model, v.measures)
        plan = Plan(model)
        for n in names:
            value = plan.named(n, ctx)
            if v.kind in ("bar", "line") and value.dtype not in ty.NUMERIC | {ty.NULL}:
                return [Diagnostic("TYPE_MISMATCH", f"[{n}] is {value.dtype}; a chart needs a number")]
        if v.kind in ("bar", "line", "slicer") and v.dimension is None:
            fail("UNKNOWN_COLUMN", f"a {v.kind} needs a column")
        if v.dimension:
            t, c = model.column(*v.dimension)
            if v.kind == "line" and model.columns(t).get(c) not in ty.NUMERIC | ty.TEMPORAL:
                return [Diagnostic("TYPE_MISMATCH", f"{t}[{c}] isn't continuous", "warning")]
    except EngineError as e:
        return e.diagnostics
    return []


def run(model: Model, v: Visual, filters: Context | dict | None = None) -> DataFrame:
    """The visual's rows: its member column (if it has one), then a column for each measure."""
    ctx = filters if isinstance(filters, Context) else Context.of(checked(model, filters))
    errors = [d for d in preflight(model, v, ctx) if d.severity == "error"]
    if errors:
        raise EngineError(*errors)
    if v.kind == "slicer":
        return members(model, v.dimension).orderBy(F.col("member").asc_nulls_last()).limit(v.limit or LIMITS["slicer"])
    names = require_measures(model, v.measures)
    if v.kind == "kpi" or v.kind == "table" and v.dimension is None:
        one = evaluate(model, names, ctx)
        if v.kind == "kpi":
            return one
        # A row for each measure: their values as text and, where they are numbers, as numbers.
        number = lambda n: F.col(f"`{n}`").try_cast("double") if ty.logical_type(one.schema[n].dataType) in ty.NUMERIC else F.lit(None).cast("double")
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), number(n).alias("number"), F.col(f"`{n}`").cast("string").alias("text")) for n in names])))
    out = grouped(model, v.dimension, names, ctx)
    limit = v.limit or LIMITS[v.kind]
    if v.kind == "table":
        first = first_seen(model, v.dimension).withColumnRenamed("member", "__member")
        seen = out.join(first, out["member"].eqNullSafe(first["__member"]), "left")
        return seen.orderBy(F.col("member").isNull(), "__first").limit(limit).select(*out.columns)
    order = v.sort or ("value-desc" if v.kind == "bar" else "axis-asc")
    by = F.col(f"`{next(iter(names))}`") if order.startswith("value") else F.col("member")
    key = by.desc_nulls_last() if order.endswith("desc") else by.asc_nulls_last()
    return out.orderBy(key, F.col("member").asc_nulls_last()).limit(limit)


def members(model: Model, dimension: tuple[str, str]) -> DataFrame:
    """The distinct values of a physical column of its unfiltered table."""
    t, c = model.column(*dimension)
    return Plan(model).rows.base(t).df.select(col(cell(t, c)).alias("member")).distinct()


def first_seen(model: Model, dimension: tuple[str, str]) -> DataFrame:
    """(member, __first): each member with the place of its first row."""
    t, c = model.column(*dimension)
    rows = model.tables[t].select(F.col(f"`{c}`").alias("member"), F.monotonically_increasing_id().alias("__n"))
    return rows.groupBy("member").agg(F.min("__n").alias("__first"))


def truncated(model: Model, v: Visual) -> Diagnostic | None:
    """An action: whether the visual has more members than it shows."""
    limit = v.limit or LIMITS[v.kind]
    n = members(model, v.dimension).count()
    return Diagnostic("VISUAL_HIGH_CARDINALITY", f"{n} members, {limit} shown", "info", {"members": n, "shown": limit}) if n > limit else None


def slicer_filter(dimension: tuple[str, str], chosen: list) -> dict:
    """The filter that a slicer's selection makes; none chosen, none made."""
    return {dimension: list(chosen)} if chosen else {}
