"""The context explainer: what a filter context lets through, table by table, and what it does to a measure."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dax
from .context import EMPTY, Context
from .measures import Plan, Rows, checked
from .model import Model


@dataclass(frozen=True)
class TableState:
    table: str
    total: int
    visible: int
    state: str  # unfiltered, direct, propagated

    @property
    def percent(self) -> float:
        return 100.0 * self.visible / self.total if self.total else 100.0


@dataclass(frozen=True)
class Comparison:
    baseline: object
    value: object

    @property
    def absolute(self):
        numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (self.baseline, self.value))
        return self.value - self.baseline if numbers else None

    @property
    def relative(self):
        return self.absolute / self.baseline if self.absolute is not None and self.baseline else None


def counts(model: Model, filters: Context | dict | None) -> DataFrame:
    """(table, total, visible) for all tables: every row is a one of its table, summed up by one aggregation.

    A table that nothing filters is read once; of the others the total reads no column, and the visible rows share the key
    sets of the tables before them.
    """
    ctx = filters if isinstance(filters, Context) else Context.of(checked(model, filters))
    model.require_valid_graph()
    rows, parts, names = Rows(model), [], list(model.tables)
    ones = lambda rel, t, total, visible: rel.df.select(F.lit(names.index(t)).alias("at"), F.lit(total).cast("long").alias("total"), F.lit(visible).cast("long").alias("visible"))
    for t in names:
        if state_of(model, t, ctx) == "unfiltered":
            parts.append(ones(rows.base(t), t, 1, 1))
        else:
            parts += [ones(rows.base(t), t, 1, 0), ones(rows.visible(t, ctx), t, 0, 1)]
    each = parts[0].sparkSession.range(len(names)).select(F.col("id").cast("int").alias("at"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("visible"))  # tables without rows
    found = functools.reduce(DataFrame.unionAll, [each, *parts]).groupBy("at").agg(F.sum("total").alias("total"), F.sum("visible").alias("visible"))
    return found.select(F.get(F.lit(names), F.col("at")).alias("table"), "total", "visible")


def state_of(model: Model, table: str, ctx: Context) -> str:
    if any(c[0] == table for c, _ in ctx.filters) or any(t == table for t, _ in ctx.selections):
        return "direct"
    return "propagated" if Rows(model)._constrained(table, ctx, ()) else "unfiltered"


def relationship_states(model: Model, ctx: Context = EMPTY) -> dict[str, str]:
    """Each relationship's part: carries (a filter), idle, inactive, switched-on, switched-off."""
    out, rows = {}, Rows(model)
    edges = rows.edges(ctx)
    for r in model.relationships:
        if r.id in ctx.off:
            out[r.id] = "switched-off"
        elif not r.active and r.id not in ctx.active:
            out[r.id] = "inactive"
        else:
            own = [(a, b) for a, b, _ in edges if {a, b} == {r.left, r.right}]
            carries = any(state_of(model, a[0], ctx) != "unfiltered" for a, _ in own)
            out[r.id] = "switched-on" if not r.active else "carries" if carries else "idle"
    return out


@dataclass(frozen=True)
class Analysis:
    comparison: Comparison
    tables: list[TableState]
    relationships: dict[str, str]

    def narrative(self) -> list[str]:
        """The analysis in sentences."""
        said = []
        for t in self.tables:
            if t.state == "direct":
                said.append(f"{t.table} is filtered directly: {t.visible} of {t.total} rows ({t.percent:.1f} %) are visible.")
            elif t.state == "propagated":
                said.append(f"{t.table} is filtered through its relationships: {t.visible} of {t.total} rows ({t.percent:.1f} %) are visible.")
        for r, state in self.relationships.items():
            if state in ("inactive", "switched-off", "switched-on"):
                said.append(f"The relationship {r} is {state.replace('-', ' ')}.")
        c = self.comparison
        if c.absolute is None:
            said.append(f"The measure is {c.baseline!r} without the filters and {c.value!r} with them.")
        else:
            share = "" if c.relative is None else f" ({100 * c.relative:+.1f} %)"
            said.append(f"The measure goes from {c.baseline:g} to {c.value:g}: {c.absolute:+g}{share}.")
        return said


def analyse(model: Model, expression: str, filters: Context | dict | None) -> Analysis:
    """Two jobs: the measure without and with the filters, as two columns of one plan, and all tables' rows."""
    ctx = filters if isinstance(filters, Context) else Context.of(checked(model, filters))
    model.require_valid_graph()
    plan = Plan(model)
    base, now = plan.result(None, {n: plan.value(dax.parse(expression), c) for n, c in (("base", EMPTY), ("now", ctx))}).df.select("base", "now").first()
    seen = {r["table"]: r for r in counts(model, ctx).collect()}
    tables = [TableState(t, seen[t]["total"], seen[t]["visible"], state_of(model, t, ctx)) for t in model.tables]
    return Analysis(Comparison(base, now), tables, relationship_states(model, ctx))


def tree(expression: str) -> dict:
    """An expression's logical structure, for display."""

    def shown(node):
        if isinstance(node, dax.Literal):
            return {"literal": node.value}
        if isinstance(node, dax.Ref):
            return {"reference": f"{node.table or ''}[{node.column}]" if node.column else node.table}
        if isinstance(node, dax.Call):
            return {"call": node.name, "arguments": [shown(a) for a in node.args]}
        if isinstance(node, dax.Let):
            return {"variables": {n: shown(v) for n, v in node.names}, "return": shown(node.body)}
        if isinstance(node, dax.Negate):
            return {"operator": "-", "operands": [shown(node.value)]}
        return {"operator": node.sign, "operands": [shown(node.left), shown(node.right)]}

    return shown(dax.parse(expression))
