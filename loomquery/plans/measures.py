"""Measures to plans.

A measure is a scalar expression over leaves: aggregations of a table's visible rows. Each leaf has the filter context
of its place, which is known when it is compiled. `Rows` compiles a table's rows under a context; rows that a member of
a grouping reaches carry the member as tag columns, so a leaf is one grouped aggregation for all members, and leaves
over the same rows are one aggregation. Leaves then meet the members in left joins, and the scalar expression is
evaluated over their columns. A leaf whose context has lost the member's filter (a share of total's denominator) has no
tag and is one row for all.

Filters travel along relationships as key sets: an untagged key set is a left semi join, a tagged one an inner join on
the key that multiplies rows by members. A table that nothing filters sends no keys.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import fail
from ..operators.conditions import as_column_type
from . import dax, scalars
from .context import EMPTY, Context, Filter, Selection, Tag
from .model import MANY_MANY, ONE_MANY, ONE_ONE, Model
from .scalars import Typed

AGGREGATES = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "DISTINCTCOUNT": F.count_distinct}
ITERATORS = {"SUMX": "SUM", "AVERAGEX": "AVERAGE", "MINX": "MIN", "MAXX": "MAX", "COUNTX": "COUNT"}
TIME = {"SAMEPERIODLASTYEAR", "DATEADD", "PREVIOUSMONTH", "PREVIOUSYEAR", "DATESYTD"}
TABLES = {"FILTER", "VALUES", "DISTINCT"} | TIME
MODIFIERS = {"REMOVEFILTERS", "ALL", "FILTER", "KEEPFILTERS", "USERELATIONSHIP", "CROSSFILTER"}
DIRECTIONS = {"ONEWAY": None, "BOTH": "both", "ONEWAY_LEFTFILTERSRIGHT": "left-to-right", "ONEWAY_RIGHTFILTERSLEFT": "right-to-left"}


def cell(table: str, column: str) -> str:
    """The name of a table's column inside plans."""
    return f"{table}[{column}]"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Rel:
    """Rows with the tag columns that they carry."""

    df: DataFrame
    tags: tuple[str, ...] = ()

    def filter(self, test: Column) -> Rel:
        return Rel(self.df.filter(test), self.tags)


def null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    test = F.lit(True)
    for n, (a, b) in enumerate(pairs):
        own = left["`" + a.replace("`", "``") + "`"].eqNullSafe(right["`" + b.replace("`", "``") + "`"])
        test = own if not n else test & own
    return test


class Rows:
    """Compiles tables' visible rows."""

    def __init__(self, model: Model):
        self.model = model
        self._base: dict[str, Rel] = {}
        self._restricted: dict = {}
        self._upstream: dict = {}

    def base(self, table: str) -> Rel:
        if table not in self._base:
            df = self.model.tables[table]
            self._base[table] = Rel(df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(cell(table, c)) for c in df.columns]))
        return self._base[table]

    def upstream(self, table: str, ctx: Context) -> frozenset[str]:
        """The tables from which filters can reach a table."""
        if (table, ctx) not in self._upstream:
            edges, found, rest = self.edges(ctx), set(), [table]
            while rest:
                at = rest.pop()
                new = {a[0] for a, b, _ in edges if b[0] == at} - found
                found |= new
                rest += new
            self._upstream[table, ctx] = frozenset(found)
        return self._upstream[table, ctx]

    def source(self, table: str, ctx: Context, path: tuple[str, ...]) -> Rel:
        """A table's rows under a context, as one plan for all who ask: a path of tables that are not upstream says nothing."""
        key = (table, ctx, self.upstream(table, ctx).intersection(path))
        if key not in self._restricted:
            self._restricted[key] = self.restricted(table, self.base(table), ctx, path)
        return self._restricted[key]

    def edges(self, ctx: Context) -> list[tuple[tuple[str, str], tuple[str, str], bool]]:
        """(from column, to column, whether the source's key is unique) of the relationships in force."""
        out = []
        for r in self.model.relationships:
            if (r.active or r.id in ctx.active) and r.id not in ctx.off:
                for a, b in r.edges(dict(ctx.ways).get(r.id)):
                    out.append((a, b, r.cardinality == ONE_ONE or r.cardinality == ONE_MANY and a == r.left))
        return out

    def visible(self, table: str, ctx: Context) -> Rel:
        return self.source(table, ctx, ())

    def _constrained(self, table: str, ctx: Context, path: tuple[str, ...]) -> bool:
        if any(c[0] == table for c, _ in ctx.filters) or any(t == table for t, _ in ctx.selections):
            return True
        return any(b[0] == table and a[0] not in path and self._constrained(a[0], ctx, (*path, table)) for a, b, _ in self.edges(ctx))

    def restricted(self, table: str, rel: Rel, ctx: Context, path: tuple[str, ...]) -> Rel:
        """`rel`, rows of `table`, under a context; filters from the tables of `path` are not followed back."""
        for s in dict(ctx.selections).get(table, ()):
            if s.dates:
                rel = self._on_dates(table, rel, s)
            else:
                rel = self.restricted(table, rel, s.ambient, ()) if not path else self.restricted(table, rel, s.ambient, path)
                rel = rel.filter(predicate(self.model, table, s.predicate))
        for (t, c), f in ctx.filters:
            if t != table:
                continue
            own = col(cell(t, c))
            if f.values is not None:
                rel = rel.filter(among(own, self.model.columns(t)[c], f.values))
            if f.tag is not None:
                name = f.tag.name(c)
                rel = rel.filter(col(name).eqNullSafe(own)) if name in rel.tags else Rel(rel.df.withColumn(name, own), (*rel.tags, name))
        for a, b, unique in self.edges(ctx):
            if b[0] == table and a[0] not in path and self._constrained(a[0], ctx, (*path, table)):
                source = self.source(a[0], ctx, (*path, table))
                rel = self._meet(rel, cell(*b), source, cell(*a), unique)
        return rel

    def _meet(self, rel: Rel, key: str, source: Rel, source_key: str, unique: bool) -> Rel:
        """The rows whose key some source row of the same members has."""
        keys = source.df.select(col(source_key).alias("__key"), *[col(t).alias(f"__{t}") for t in source.tags]).filter("__key is not null")
        new = [t for t in source.tags if t not in rel.tags]
        shared = [(t, f"__{t}") for t in source.tags if t in rel.tags]
        on = rel.df["`" + key.replace("`", "``") + "`"] == keys["__key"]
        if shared:
            on = on & null_safe(rel.df, keys, shared)
        if not new:
            return Rel(rel.df.join(keys, on, "left_semi"), rel.tags)
        joined = rel.df.join(keys if unique else keys.distinct(), on, "inner")
        return Rel(joined.select(*[col(c) for c in rel.df.columns], *[col(f"__{t}").alias(t) for t in new]), (*rel.tags, *new))

    def _on_dates(self, table: str, rel: Rel, s: Selection) -> Rel:
        dates = self.dates(table, s.ambient, *s.dates)
        key = cell(table, self.model.date_tables[table])
        day = Rel(rel.df.withColumn("__day", F.to_date(col(key))), rel.tags)
        met = self._meet(day, "__day", dates, "d", True)
        return Rel(met.df.drop("__day"), met.tags)

    def dates(self, table: str, ctx: Context, function: str, args: tuple) -> Rel:
        """The distinct dates (d) that a time-intelligence function makes of the visible ones, with their tags."""
        name = cell(table, self.model.date_tables[table])
        seen = self.visible(table, ctx)
        tags = [col(t) for t in seen.tags]
        days = seen.df.select(*tags, F.to_date(col(name)).alias("d")).filter("d is not null")
        every = self.base(table).df.select(F.to_date(col(name)).alias("d")).filter("d is not null")
        if function in ("SAMEPERIODLASTYEAR", "DATEADD"):
            n, unit = (-1, "YEAR") if function == "SAMEPERIODLASTYEAR" else args
            months = {"YEAR": 12, "QUARTER": 3, "MONTH": 1}.get(unit)
            moved = F.add_months("d", n * months) if months else F.date_add("d", n)
            out = days.select(*tags, moved.alias("d")).distinct().join(every, "d", "left_semi")
            return Rel(out, seen.tags)
        agg = F.max("d") if function == "DATESYTD" else F.min("d")
        edge = (days.groupBy(*tags) if seen.tags else days.groupBy()).agg(agg.alias("__edge")).filter("__edge is not null")
        # All three look for whole periods, so they are equi-joins on the period.
        if function == "PREVIOUSMONTH":
            edge, period = edge.withColumn("__p", F.add_months(F.trunc("__edge", "MM"), -1)), F.trunc("d", "MM")
        elif function == "PREVIOUSYEAR":
            edge, period = edge.withColumn("__p", F.year("__edge") - 1), F.year("d")
        else:
            edge, period = edge.withColumn("__p", F.year("__edge")), F.year("d")
        out = every.distinct().withColumn("__p", period).join(edge, "__p")
        if function == "DATESYTD":
            out = out.filter("d <= __edge")
        return Rel(out.select("d", *tags), seen.tags)


def among(c: Column, dtype: str, values: frozenset) -> Column:
    """Null-safe membership, with values taken in the column's type."""
    known = [as_column_type(v, dtype) for v in values if v is not None]
    known = [v for v in known if v is not None]
    test = c.isin(*known) if known else F.lit(False)
    return F.coalesce(test, F.lit(False)) | c.isNull() if None in values else F.coalesce(test, F.lit(False))


def predicate(model: Model, table: str, tree) -> Column:
    """A filter predicate over one table's physical columns."""
    value = _predicate_value(model, table, tree)
    if value.dtype != ty.BOOLEAN:
        fail("FILTER_PREDICATE_NOT_BOOLEAN", "a filter needs a comparison")
    return value.column


def _predicate_value(model: Model, table: str, tree) -> Typed:
    if isinstance(tree, dax.Literal):
        return scalars.literal(tree.value)
    if isinstance(tree, dax.Negate) and isinstance(tree.value, dax.Literal):
        return scalars.negate(scalars.literal(tree.value.value))
    if isinstance(tree, dax.Ref) and tree.column is not None and tree.table is not None:
        t, c = model.column(tree.table, tree.column)
        if t != table:
            fail("FILTER_ROW_CONTEXT_VIOLATION", f"a filter of {table} can't read {t}")
        if model.is_calculated((t, c)):
            fail("FILTER_ROW_CONTEXT_VIOLATION", f"filters read physical columns; {t}[{c}] is calculated")
        return Typed(col(cell(t, c)), model.columns(t)[c])
    if isinstance(tree, dax.Ref) and tree.table is None and tree.column is not None:
        fail("BOOLEAN_FILTER_MEASURE_REFERENCE", f"a filter can't read the measure [{tree.column}]")
    if isinstance(tree, dax.Call):
        fail("BOOLEAN_FILTER_NESTED_CALCULATE" if tree.name == "CALCULATE" else "CALCULATE_INVALID_FILTER_ARGUMENT", f"{tree.name} can't stand inside a filter")
    if isinstance(tree, dax.Binary) and tree.sign not in "+-*/":
        return scalars.operate(tree.sign, _predicate_value(model, table, tree.left), _predicate_value(model, table, tree.right))
    return fail("CALCULATE_INVALID_FILTER_ARGUMENT", "a filter compares columns of one table with values")


def time_column(model: Model, call: dax.Call) -> str:
    """The marked date table that a time-intelligence call names."""
    code = "TOTALYTD_INVALID_ARGUMENT" if call.name == "TOTALYTD" else "TIME_INTELLIGENCE_INVALID_ARGUMENT"
    at = call.args[-1] if call.name == "TOTALYTD" else call.args[0] if call.args else None
    if not isinstance(at, dax.Ref) or at.table is None or at.column is None:
        fail(code, f"{call.name} takes a date column")
    t, c = model.column(at.table, at.column)
    if model.date_tables.get(t) != c:
        fail("DATE_TABLE_REQUIRED", f"{t}[{c}] isn't the date column of a marked date table")
    return t


def time_call(model: Model, call: dax.Call) -> tuple[str, tuple[str, tuple]]:
    """(date table, (function, arguments))."""
    if call.name != "DATEADD":
        if len(call.args) != 1:
            fail("TIME_INTELLIGENCE_INVALID_ARGUMENT", f"{call.name} takes one argument")
        return time_column(model, call), (call.name, ())
    if len(call.args) != 3:
        fail("TIME_INTELLIGENCE_INVALID_ARGUMENT", "DATEADD takes a date column, a number and an interval")
    t, (_, n, unit) = time_column(model, call), call.args
    sign, n = (-1, n.value) if isinstance(n, dax.Negate) else (1, n)
    if not isinstance(n, dax.Literal) or isinstance(n.value, bool) or not isinstance(n.value, (int, float)) or n.value != int(n.value):
        fail("DATEADD_INTERVAL_COUNT_INVALID", "DATEADD's number is a whole constant")
    if not isinstance(unit, dax.Ref) or unit.column is not None or (unit.table or "").upper() not in ("YEAR", "QUARTER", "MONTH", "DAY"):
        fail("DATEADD_INVALID_INTERVAL", "DATEADD's interval is YEAR, QUARTER, MONTH or DAY")
    return t, ("DATEADD", (sign * int(n.value), unit.table.upper()))


class RowScope:
    """Compiles an expression over the rows of one table: calculated columns, and what iterators evaluate.

    RELATED columns and, in iterators, measures are joined to the rows as they come up.
    """

    def __init__(self, model: Model, table: str, rel: Rel, measure=None, only: str | None = None):
        self.model, self.table, self.rel = model, table, rel
        self.measure = measure  # a function (name, rel) -> (rel, Typed), in iterators
        self.only = only  # the single column that VALUES leaves
        self.lookups: dict[tuple[str, str], Typed] = {}

    def value(self, tree, names: dict | None = None) -> Typed:
        names = names or {}
        if isinstance(tree, dax.Literal):
            return scalars.literal(tree.value)
        if isinstance(tree, dax.Negate):
            return scalars.negate(self.value(tree.value, names))
        if isinstance(tree, dax.Binary):
            return scalars.operate(tree.sign, self.value(tree.left, names), self.value(tree.right, names))
        if isinstance(tree, dax.Let):
            if self.measure:
                fail("ITERATOR_ROW_SCOPE_VIOLATION", "VAR can't stand inside an iterator's row expression")
            return let(tree, names, self.value)
        if isinstance(tree, dax.Ref):
            return self.reference(tree, names)
        return self.call(tree, names)

    def reference(self, ref: dax.Ref, names: dict) -> Typed:
        if ref.column is None:
            if ref.table.lower() in names:
                return names[ref.table.lower()]
            fail("BARE_TABLE_REFERENCE" if any(t.lower() == ref.table.lower() for t in self.model.tables) else "UNKNOWN_VARIABLE", f"{ref.table} is no value")
        if ref.table is None and self.measure:
            if not self.model.measure(ref.column):
                fail("UNKNOWN_MEASURE", f"there is no measure [{ref.column}]")
            self.rel, got = self.measure(ref.column, self.rel)
            return got
        t, c = self.model.column(ref.table or self.table, ref.column)
        if t != self.table:
            fail("ITERATOR_ROW_SCOPE_VIOLATION" if self.measure else "COLUMN_OUTSIDE_ROW_CONTEXT", f"{t}[{c}] isn't a column of {self.table}; RELATED reads it")
        if self.only is not None and c != self.only:
            fail("ITERATOR_ROW_SCOPE_VIOLATION", f"only {t}[{self.only}] is there")
        if self.model.is_calculated((t, c)):
            if not self.measure:
                fail("UNKNOWN_COLUMN", f"{t}[{c}] is calculated; calculated columns read physical ones")
            inner = RowScope(self.model, t, self.rel)
            got = inner.value(dax.parse(self.model.calculated[t, c]))
            self.rel = inner.rel
            return got
        return Typed(col(cell(t, c)), self.model.columns(t)[c])

    def call(self, tree: dax.Call, names: dict) -> Typed:
        if tree.name == "RELATED":
            return self.related(tree)
        if tree.name in scalars.SCALAR and not (tree.name == "DIVIDE" or self.measure and tree.name == "ISBLANK"):
            return scalars.SCALAR[tree.name]([self.value(a, names) for a in tree.args])
        if tree.name in {"CALCULATE", *MODIFIERS}:
            fail("ITERATOR_CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED" if self.measure else "CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED", f"{tree.name} can't stand in a row expression")
        return fail("UNSUPPORTED_FUNCTION", f"{tree.name} can't stand in a row expression")

    def related(self, tree: dax.Call) -> Typed:
        if len(tree.args) != 1 or not isinstance(tree.args[0], dax.Ref) or tree.args[0].table is None or tree.args[0].column is None:
            fail("INVALID_FUNCTION_ARGUMENT", "RELATED takes a column of another table")
        t, c = self.model.column(tree.args[0].table, tree.args[0].column)
        if self.model.is_calculated((t, c)):
            fail("UNKNOWN_COLUMN", f"RELATED reads physical columns; {t}[{c}] is calculated")
        if (t, c) in self.lookups:
            return self.lookups[t, c]
        here, there = self.lookup(t)
        one = self.model.tables[t].select(F.col(f"`{there}`").alias("__key"), F.col(f"`{c}`").alias(f"related:{cell(t, c)}"))
        self.rel = Rel(self.rel.df.join(one, col(cell(self.table, here)) == F.col("__key"), "left").drop("__key"), self.rel.tags)
        self.lookups[t, c] = Typed(col(f"related:{cell(t, c)}"), self.model.columns(t)[c])
        return self.lookups[t, c]

    def lookup(self, table: str) -> tuple[str, str]:
        """(own key column, the other table's) of the relationship along which RELATED looks."""
        between = [r for r in self.model.relationships if {r.left[0], r.right[0]} == {self.table, table}]
        if not between:
            fail("RELATED_NO_RELATIONSHIP", f"{self.table} and {table} aren't related")
        active = [r for r in between if r.active]
        if not active:
            fail("RELATED_INACTIVE_RELATIONSHIP", f"the relationship of {self.table} and {table} is inactive")
        if len(active) > 1:
            fail("RELATED_AMBIGUOUS_RELATIONSHIP", f"{self.table} and {table} have several relationships")
        r = active[0]
        if r.cardinality == MANY_MANY:
            fail("RELATED_UNSUPPORTED_CARDINALITY", "RELATED needs one row on the other side")
        if r.cardinality == ONE_MANY and r.left[0] != table:
            fail("RELATED_WRONG_DIRECTION", f"{table} is on the many side")
        return (r.right[1], r.left[1]) if r.left[0] == table else (r.left[1], r.right[1])


def let(tree: dax.Let, names: dict, value) -> Typed:
    """VAR: each value is bound where it is declared."""
    known, later = dict(names), {n for n, _ in tree.names}
    own = set()
    for n, v in tree.names:
        if n in own:
            fail("DUPLICATE_VARIABLE", f"the variable {n} is declared twice")
        forward = {r.table.lower() for r in dax.walk(v) if isinstance(r, dax.Ref) and r.column is None and r.table} & (later - own) - set(names)
        if forward:
            fail("FORWARD_VARIABLE_REFERENCE", f"{n} reads {', '.join(sorted(forward))} before its declaration")
        if isinstance(v, dax.Call) and v.name in TABLES | {"SUMMARIZE", "ADDCOLUMNS", "SELECTCOLUMNS", "ALL"}:
            fail("TABLE_VARIABLE_NOT_SUPPORTED", f"the variable {n} would be a table")
        known[n] = value(v, known)
        own.add(n)
    return value(tree.body, known)


def calculated_value(model: Model, table: str, expression: str) -> tuple[Rel, Typed]:
    """(rows of the table, the expression's value over them)."""
    scope = RowScope(model, table, Rows(model).base(table))
    value = scope.value(dax.parse(expression))
    return scope.rel, value


def calculated_column(model: Model, table: str, expression: str, name: str) -> DataFrame:
    """The table with a calculated column and, in `<name>__error`, the code of each row's error."""
    rel, v = calculated_value(model, table, expression)
    error = F.lit(None).cast("string") if v.error is None else v.error
    return rel.df.select(*[col(cell(table, c)).alias(c) for c in model.columns(table)], F.when(error.isNull(), v.column).alias(name), error.alias(f"{name}__error"))


_ids = itertools.count()


class Plan:
    """One expression's, or several expressions', leaves and how they meet the members."""

    def __init__(self, model: Model):
        self.model, self.rows = model, Rows(model)
        self.leaves: dict = {}  # key: (rel, {name: aggregate})
        self.measures: dict = {}
        self.open: list[str] = []
        self.tagged: dict[str, tuple[str, str]] = {}  # tag column: the column whose values it takes

    # Leaves.
    def leaf(self, key, make, aggregate) -> Column:
        """The column of an aggregate over the rows that `make` compiles; rows of one key are made once."""
        if key not in self.leaves:
            self.leaves[key] = (make(), {})
        rel, found = self.leaves[key]
        value = aggregate(rel)
        text = str(value)
        if text not in found:
            found[text] = (f"leaf{next(_ids)}", value)
        return F.col(found[text][0])

    def result(self, spine: Rel | None, columns: dict[str, Typed]) -> Rel:
        """The columns beside the spine's tags (None: one row). A value with an error is null; see `<name>__error`."""
        df, tags = (spine.df, spine.tags) if spine else (None, ())
        for rel, aggregates in self.leaves.values():
            made = [v.alias(n) for n, v in aggregates.values()]
            if not made:
                continue
            if not rel.tags:
                one = rel.df.agg(*made)
                df = one if df is None else df.crossJoin(F.broadcast(one))  # one row
                continue
            by = rel.df.groupBy(*[col(t).alias(f"__{t}") for t in rel.tags]).agg(*made)
            on = null_safe(df, by, [(t, f"__{t}") for t in rel.tags])
            df = df.join(by, on, "left").drop(*[f"__{t}" for t in rel.tags])
        if df is None:
            df = next(iter(self.model.tables.values())).sparkSession.range(1).drop("id")
        out = []
        for n, v in columns.items():
            out += [v.column.alias(n)] if v.error is None else [F.when(v.error.isNull(), v.column).alias(n), v.error.alias(f"{n}__error")]
        return Rel(df.select(*[col(t) for t in tags], *[col(c) for c in df.columns if c.startswith("keep:")], *out), tags)

    # Expressions.
    def value(self, tree, ctx: Context, names: dict | None = None) -> Typed:
        names = names or {}
        if isinstance(tree, dax.Literal):
            return scalars.literal(tree.value)
        if isinstance(tree, dax.Negate):
            return scalars.negate(self.value(tree.value, ctx, names))
        if isinstance(tree, dax.Binary):
            return scalars.operate(tree.sign, self.value(tree.left, ctx, names), self.value(tree.right, ctx, names))
        if isinstance(tree, dax.Let):
            return let(tree, names, lambda t, n: self.value(t, ctx, n))
        if isinstance(tree, dax.Ref):
            return self.reference(tree, ctx, names)
        return self.call(tree, ctx, names)

    def reference(self, ref: dax.Ref, ctx: Context, names: dict) -> Typed:
        if ref.column is None:
            if ref.table.lower() in names:
                return names[ref.table.lower()]
            known = any(t.lower() == ref.table.lower() for t in self.model.tables)
            fail("BARE_TABLE_REFERENCE" if known else "UNKNOWN_VARIABLE", f"{ref.table} is no value")
        if ref.table is not None:
            t, c = self.model.column(ref.table, ref.column)
            fail("COLUMN_REQUIRES_AGGREGATION", f"{t}[{c}] has many values here")
        return self.named(ref.column, ctx)

    def named(self, name: str, ctx: Context) -> Typed:
        found = self.model.measure(name)
        if not found:
            fail("UNKNOWN_MEASURE", f"there is no measure [{name}]")
        name, text = found
        if name in self.open:
            fail("MEASURE_DEPENDENCY_CYCLE", " -> ".join([*self.open[self.open.index(name) :], name]))
        if (name, ctx) not in self.measures:
            self.open.append(name)
            self.measures[name, ctx] = self.value(dax.parse(text), ctx)
            self.open.pop()
        return self.measures[name, ctx]

    def call(self, tree: dax.Call, ctx: Context, names: dict) -> Typed:
        name = tree.name
        if name in scalars.SCALAR:
            return scalars.SCALAR[name]([self.value(a, ctx, names) for a in tree.args])
        if name in AGGREGATES:
            return self.aggregate(tree, ctx)
        if name == "COUNTROWS":
            return self.count_rows(tree, ctx)
        if name in ITERATORS:
            return self.iterate(tree, ctx)
        if name in ("SELECTEDVALUE", "HASONEVALUE"):
            return self.one_value(tree, ctx, names)
        if name == "CALCULATE":
            return self.calculate(tree, ctx, names)
        if name == "TOTALYTD":
            if len(tree.args) != 2:
                fail("TOTALYTD_INVALID_ARGUMENT", "TOTALYTD takes an expression and a date column")
            time_column(self.model, tree)
            return self.calculate(dax.Call("CALCULATE", (tree.args[0], dax.Call("DATESYTD", (tree.args[1],)))), ctx, names)
        if name == "RELATED":
            fail("RELATED_REQUIRES_ROW_CONTEXT", "RELATED needs a row")
        if name in ("USERELATIONSHIP", "CROSSFILTER"):
            fail(f"{name}_INVALID_CONTEXT", f"{name} stands inside CALCULATE")
        if name == "KEEPFILTERS":
            fail("CALCULATE_INVALID_FILTER_ARGUMENT", "KEEPFILTERS stands inside CALCULATE")
        if name in ("REMOVEFILTERS", "ALL", "FILTER"):
            fail({"REMOVEFILTERS": "INVALID_REMOVEFILTERS_ARGUMENT", "ALL": "INVALID_ALL_ARGUMENT"}.get(name, "INVALID_TABLE_EXPRESSION_ARGUMENT"), f"{name} stands inside CALCULATE")
        if name in TABLES:
            fail("INVALID_TABLE_EXPRESSION_ARGUMENT", f"{name} gives a table, not a value")
        return fail("UNSUPPORTED_FUNCTION", f"there is no function {name}")

    def argument(self, tree: dax.Call, code: str) -> tuple[str, str, str]:
        """(table, column, type) of a call's first argument, which must be T[C]."""
        ref = tree.args[0] if tree.args else None
        if not isinstance(ref, dax.Ref) or ref.table is None or ref.column is None:
            fail(code, f"{tree.name} takes a column")
        t, c = self.model.column(ref.table, ref.column)
        return t, c, self.model.columns(t).get(c, "")

    def aggregate(self, tree: dax.Call, ctx: Context) -> Typed:
        if len(tree.args) != 1:
            fail("INVALID_AGGREGATION_ARGUMENT", f"{tree.name} takes one column")
        t, c, dtype = self.argument(tree, "INVALID_AGGREGATION_ARGUMENT")
        if self.model.is_calculated((t, c)):
            return self.over(tree.name, t, ctx, dax.Ref(t, c), lambda: self.rows.visible(t, ctx), ("rows", t, ctx))
        self.check_type(tree.name, dtype, f"{t}[{c}]", "NON_NUMERIC_AGGREGATION")
        value = self.leaf(("rows", t, ctx), lambda: self.rows.visible(t, ctx), lambda rel: AGGREGATES[tree.name](col(cell(t, c))))
        return shaped(tree.name, value, dtype)

    @staticmethod
    def check_type(name: str, dtype: str, what: str, code: str) -> None:
        allowed = {"SUM": ty.NUMERIC, "AVERAGE": ty.NUMERIC, "MIN": ty.NUMERIC | ty.TEMPORAL, "MAX": ty.NUMERIC | ty.TEMPORAL}.get(name)
        if allowed and dtype not in allowed | {ty.NULL}:
            fail(code, f"{name} doesn't take {what}, which is {dtype}")

    def table(self, tree, ctx: Context):
        """(table, its visible rows' maker, a key for them, the single column of VALUES) of a table expression."""
        if isinstance(tree, dax.Ref) and tree.column is None:
            t = self.model.table(tree.table)
            return t, lambda: self.rows.visible(t, ctx), ("rows", t, ctx), None
        if isinstance(tree, dax.Call) and tree.name == "FILTER":
            t, tests = filter_parts(self.model, tree)

            def made() -> Rel:
                rel = self.rows.visible(t, ctx)
                for test in tests:
                    rel = rel.filter(predicate(self.model, t, test))
                return rel

            for test in tests:
                predicate(self.model, t, test)
            return t, made, ("filter", t, ctx, tree), None
        if isinstance(tree, dax.Call) and tree.name in ("VALUES", "DISTINCT"):
            code = f"INVALID_{tree.name}_ARGUMENT"
            if len(tree.args) != 1:
                fail(code, f"{tree.name} takes one column")
            t, c, _ = self.argument(tree, code)
            if self.model.is_calculated((t, c)):
                fail(code, f"{tree.name} takes a physical column")

            def distinct() -> Rel:
                rel = self.rows.visible(t, ctx)
                return Rel(rel.df.select(*[col(x) for x in rel.tags], col(cell(t, c))).distinct(), rel.tags)

            return t, distinct, ("values", t, ctx, c), c
        return None

    def count_rows(self, tree: dax.Call, ctx: Context) -> Typed:
        if len(tree.args) != 1:
            fail("INVALID_TABLE_EXPRESSION_ARGUMENT", "COUNTROWS takes one table")
        at, error = tree.args[0], None
        if isinstance(at, dax.Call) and at.name in TIME:
            t, call = time_call(self.model, at)
            error = self.not_contiguous(t, ctx, call)
            made, key = lambda: self.rows.dates(t, ctx, *call), ("dates", t, ctx, call)
        else:
            found = self.table(at, ctx)
            if not found:
                fail("INVALID_TABLE_EXPRESSION_ARGUMENT", "COUNTROWS takes a table")
            _, made, key, _ = found
        value = self.leaf(key, made, lambda rel: F.count(F.lit(1)))
        return Typed(F.coalesce(value, F.lit(0)), ty.INTEGER, error)

    def iterate(self, tree: dax.Call, ctx: Context) -> Typed:
        if len(tree.args) != 2:
            fail("INVALID_ITERATOR_ARGUMENT", f"{tree.name} takes a table and an expression")
        if isinstance(tree.args[0], dax.Call) and tree.args[0].name in TIME:
            fail("ITERATOR_UNSUPPORTED_TABLE_EXPRESSION", "iterators don't take time-intelligence tables")
        found = self.table(tree.args[0], ctx)
        if not found:
            known = isinstance(tree.args[0], dax.Call)
            fail("ITERATOR_UNSUPPORTED_TABLE_EXPRESSION" if known else "ITERATOR_TABLE_REQUIRED", f"{tree.name} takes a table first")
        t, made, key, only = found
        return self.over(ITERATORS[tree.name], t, ctx, tree.args[1], made, key, only, iterator=True)

    def over(self, function: str, table: str, ctx: Context, tree, made, key, only: str | None = None, iterator: bool = False) -> Typed:
        """An aggregate of a row expression."""
        sparse = blank_with_measures(tree)
        scope = RowScope(self.model, table, made(), lambda name, rel: self.transition(name, table, rel, ctx, only, sparse), only)
        v = scope.value(tree)
        if iterator:
            allowed = {"SUM": ty.NUMERIC, "AVERAGE": ty.NUMERIC, "MIN": ty.NUMERIC | ty.TEMPORAL | {ty.STRING}, "MAX": ty.NUMERIC | ty.TEMPORAL | {ty.STRING}}.get(function)
            if allowed and v.dtype not in allowed | {ty.NULL}:
                fail("ITERATOR_EXPRESSION_TYPE_ERROR", f"the row expression is {v.dtype}")
        else:
            self.check_type(function, v.dtype, "the calculated column", "NON_NUMERIC_AGGREGATION")
        own = (*key, "over", tree)
        value = self.leaf(own, lambda: scope.rel, lambda rel: AGGREGATES[function](v.column))
        error = None
        if v.error is not None:
            error = self.leaf(own, lambda: scope.rel, lambda rel: F.min(v.error))
        return replace(shaped(function, value, v.dtype), error=error)

    def transition(self, name: str, table: str, rel: Rel, ctx: Context, only: str | None, sparse: bool = False) -> tuple[Rel, Typed]:
        """A measure for each row: the row's columns become filters, and the measure is computed once for each
        distinct row, all in one plan. `sparse`: rows for which it is blank don't count."""
        every = list(self.model.columns(table))
        key = self.model.keys.get(table)
        # A key stands for all columns' filters, unless the measure replaces or removes some of them.
        columns = (only,) if only else (key,) if key and not self.modifies(name, table, set()) else tuple(every)
        tag = Tag(f"row{next(_ids)}", table, columns)
        inner = ctx.without_columns({(table, c) for c in ((only,) if only else every)})
        for c in columns:
            inner = inner.keep((table, c), Filter(tag=tag))
        plan = Plan(self.model)
        plan.open, plan.tagged = self.open, {**self.tagged, **{tag.name(c): (table, c) for c in columns}}
        v = plan.named(name, inner)
        # The measure may depend on a member that doesn't filter these rows: then each row counts for each member.
        new = sorted({t for leaf, _ in plan.leaves.values() for t in leaf.tags} - {*rel.tags, *tag.names()})
        if new and sparse and (met := self.where_not_blank(plan, v, rel, table, columns, tag, new)):
            return met
        for t in new:
            of = plan.tagged[t]
            every_member = self.rows.base(of[0]).df.select(col(cell(*of)).alias(t)).distinct()
            rel = Rel(rel.df.crossJoin(every_member), (*rel.tags, t))
        names = {t: f"__outer:{t}" for t in rel.tags} | {tag.name(c): f"__row:{c}" for c in columns}
        spine = rel.df.select(*[col(t) for t in rel.tags], *[col(cell(table, c)).alias(tag.name(c)) for c in columns]).distinct()
        out = plan.result(Rel(spine, (*rel.tags, *tag.names())), {"__value": v}).df
        got = out.select(*[col(a).alias(b) for a, b in names.items()], *[F.col(c).alias(f"{c}:{tag.id}") for c in out.columns if c.startswith("__value")])
        on = null_safe(rel.df, got, [(cell(table, c), f"__row:{c}") for c in columns] + [(t, f"__outer:{t}") for t in rel.tags])
        joined = rel.df.join(got, on, "left").drop(*names.values())
        error = col(f"__value__error:{tag.id}") if v.error is not None else None
        value = col(f"__value:{tag.id}")
        return Rel(joined, rel.tags), Typed(value, v.dtype, error)

    def modifies(self, measure: str, table: str, seen: set[str]) -> bool:
        """Whether a measure, or one that it reads, has a CALCULATE modifier that names the table."""
        found = self.model.measure(measure)
        if not found or found[0] in seen:
            return False
        seen.add(found[0])
        for n in dax.walk(dax.parse(found[1])):
            if isinstance(n, dax.Ref) and n.table is None and n.column is not None and self.modifies(n.column, table, seen):
                return True
            if isinstance(n, dax.Call) and n.name in ("CALCULATE", "TOTALYTD") and any(isinstance(r, dax.Ref) and r.table and r.table.lower() == table.lower() for m in n.args[1:] for r in dax.walk(m)):
                return True
        return False

    def where_not_blank(self, plan: Plan, v: Typed, rel: Rel, table: str, columns: tuple[str, ...], tag: Tag, new: list[str]) -> tuple[Rel, Typed] | None:
        """The rows with those new members only for which the measure's leaves have rows: an equi-join, where a row's
        value for the others is known to be blank. None where it isn't."""
        leaves = [leaf for leaf, aggregates in plan.leaves.values() if aggregates]
        own = leaves[0].tags
        if any(set(leaf.tags) != set(own) for leaf in leaves) or not {*tag.names(), *new} <= set(own):
            return None
        none = {n: F.lit(None).cast(leaf.df.agg(a.alias("x")).schema["x"].dataType) for leaf, aggregates in plan.leaves.values() for n, a in aggregates.values()}
        empty = rel.df.sparkSession.sql("SELECT 1 AS __one").select(*[x.alias(n) for n, x in none.items()])
        something = v.column.isNotNull() if v.error is None else v.column.isNotNull() | v.error.isNotNull()
        if empty.select(something).first()[0]:
            return None
        spine = functools.reduce(DataFrame.unionAll, [leaf.df.select(*[col(t) for t in own]) for leaf in leaves]).distinct()
        out = plan.result(Rel(spine, own), {"__value": v}).df
        shared = [t for t in rel.tags if t in own]
        names = {tag.name(c): f"__row:{c}" for c in columns} | {t: f"__outer:{t}" for t in shared} | {t: t for t in new}
        got = out.select(*[col(a).alias(b) for a, b in names.items()], *[F.col(c).alias(f"{c}:{tag.id}") for c in out.columns if c.startswith("__value")])
        on = null_safe(rel.df, got, [(cell(table, c), f"__row:{c}") for c in columns] + [(t, f"__outer:{t}") for t in shared])
        joined = rel.df.join(got, on, "inner").drop(*[b for b in names.values() if b.startswith(("__row:", "__outer:"))])
        error = col(f"__value__error:{tag.id}") if v.error is not None else None
        return Rel(joined, (*rel.tags, *new)), Typed(col(f"__value:{tag.id}"), v.dtype, error)

    def one_value(self, tree: dax.Call, ctx: Context, names: dict) -> Typed:
        most = 2 if tree.name == "SELECTEDVALUE" else 1
        if not 1 <= len(tree.args) <= most:
            fail("SELECTEDVALUE_INVALID_ARGUMENT" if most == 2 else "INVALID_FUNCTION_ARGUMENT", f"{tree.name} takes a column")
        t, c, dtype = self.argument(tree, "SELECTEDVALUE_INVALID_ARGUMENT" if most == 2 else "INVALID_FUNCTION_ARGUMENT")
        if self.model.is_calculated((t, c)):
            fail("SELECTEDVALUE_INVALID_ARGUMENT" if most == 2 else "INVALID_FUNCTION_ARGUMENT", f"{tree.name} takes a physical column")
        own = col(cell(t, c))
        leaf = lambda agg: self.leaf(("rows", t, ctx), lambda: self.rows.visible(t, ctx), lambda rel: agg)
        # One value: the least is the greatest and there is no blank, or there are only blanks.
        lo, hi, blanks = leaf(F.min(own)), leaf(F.max(own)), leaf(F.max(own.isNull()))
        blank = F.coalesce(blanks, F.lit(False))
        one = F.when(lo.isNull(), blank).otherwise((lo == hi) & ~blank)
        if tree.name == "HASONEVALUE":
            return Typed(F.coalesce(one, F.lit(False)), ty.BOOLEAN)
        other = self.value(tree.args[1], ctx, names) if len(tree.args) == 2 else scalars.blank_value()
        return scalars.choose([(F.coalesce(one, F.lit(False)), Typed(hi, dtype))], other, None)

    def not_contiguous(self, table: str, ctx: Context, call: tuple) -> Column | None:
        """DATEADD's error where the visible dates have gaps."""
        if call[0] != "DATEADD":
            return None
        name = cell(table, self.model.date_tables[table])
        day = F.to_date(col(name))
        gap = F.datediff(F.max(day), F.min(day)) + 1 != F.count_distinct(day)
        found = self.leaf(("rows", table, ctx), lambda: self.rows.visible(table, ctx), lambda rel: gap)
        return F.when(F.coalesce(found, F.lit(False)), F.lit("DATEADD_NON_CONTIGUOUS_CONTEXT"))

    # CALCULATE.
    def calculate(self, tree: dax.Call, ctx: Context, names: dict) -> Typed:
        if not tree.args:
            fail("INVALID_CALCULATE_ARITY", "CALCULATE takes an expression")
        now, picked, errors = ctx, set(), []
        for m in tree.args[1:]:
            now, error = self.modified(m, now, ctx, picked)
            errors.append(error)
        v = self.value(tree.args[0], now, names)
        return replace(v, error=scalars.first_error(*errors, v.error))

    def modified(self, m, now: Context, ambient: Context, picked: set) -> tuple[Context, Column | None]:
        """The context after one modifier. `picked`: the tables that have a selection from this CALCULATE."""
        bad = "CALCULATE_INVALID_FILTER_ARGUMENT"
        if isinstance(m, dax.Call):
            if m.name in TIME:
                t, call = time_call(self.model, m)
                picked.add(t)
                return now.without_table(t).select(t, Selection(ambient, dates=call), True), self.not_contiguous(t, ambient, call)
            if m.name in ("REMOVEFILTERS", "ALL"):
                return self.removed(m, now), None
            if m.name == "KEEPFILTERS":
                if len(m.args) != 1 or (got := self.equality(m.args[0])) is None:
                    fail("UNSUPPORTED_KEEPFILTERS_SHAPE", "KEEPFILTERS takes T[C] = value")
                return now.keep(got[0], Filter(frozenset([got[1]]))), None
            if m.name == "FILTER":
                t, tests = filter_parts(self.model, m)
                fresh = t not in picked
                picked.add(t)
                if fresh:
                    now = now.without_table(t)
                for n, test in enumerate(tests):
                    predicate(self.model, t, test)
                    now = now.select(t, Selection(ambient, test), fresh and not n)
                return now, None
            if m.name == "USERELATIONSHIP":
                return self.use_relationship(m, now), None
            if m.name == "CROSSFILTER":
                return self.cross_filter(m, now), None
            fail("BOOLEAN_FILTER_NESTED_CALCULATE" if m.name == "CALCULATE" else bad, f"{m.name} is no filter")
        if not isinstance(m, dax.Binary):
            fail(bad, "a filter is a comparison, a table filter or a modifier")
        if (got := self.equality(m)) is not None:
            return now.replaced(got[0], Filter(frozenset([got[1]]))), None
        columns = {self.model.column(t, c) for t, c in dax.references(m) if t is not None}
        if any(t is None for t, _ in dax.references(m)):
            fail("BOOLEAN_FILTER_MEASURE_REFERENCE", "a filter can't read a measure")
        tables = {t for t, _ in columns}
        if len(tables) != 1:
            fail("BOOLEAN_FILTER_MULTIPLE_TABLES" if tables else bad, "a filter is about columns of one table")
        t = tables.pop()
        predicate(self.model, t, m)
        fresh = t not in picked
        picked.add(t)
        return now.without_columns(columns).select(t, Selection(ambient, m, frozenset(c for _, c in columns)), fresh), None

    def equality(self, m):
        """((table, column), value) of `T[C] = literal`, in either order."""
        if not isinstance(m, dax.Binary) or m.sign != "=":
            return None
        for a, b in ((m.left, m.right), (m.right, m.left)):
            if isinstance(b, dax.Negate) and isinstance(b.value, dax.Literal) and isinstance(b.value.value, (int, float)):
                b = dax.Literal(-b.value.value)
            blank = isinstance(b, dax.Call) and b.name == "BLANK" and not b.args
            if isinstance(a, dax.Ref) and a.table is not None and a.column is not None and (blank or isinstance(b, dax.Literal)):
                t, c = self.model.column(a.table, a.column)
                if self.model.is_calculated((t, c)):
                    fail("FILTER_ROW_CONTEXT_VIOLATION", f"filters read physical columns; {t}[{c}] is calculated")
                return (t, c), None if blank else b.value
        return None

    def removed(self, m: dax.Call, now: Context) -> Context:
        code = f"INVALID_{m.name}_ARGUMENT"
        if not m.args:
            if m.name == "ALL":
                fail(code, "ALL takes a table or columns")
            return now.cleared()
        if m.name == "ALL" and len(m.args) > 1:
            fail(code, "ALL takes one table or column")
        for a in m.args:
            if not isinstance(a, dax.Ref) or a.table is None:
                fail(code, f"{m.name} takes tables and columns")
            if a.column is None:
                now = now.without_table(self.model.table(a.table))
            else:
                now = now.without_columns({self.model.column(a.table, a.column)})
        return now

    def between(self, m: dax.Call, count: int):
        """The relationship that two columns name, and the columns."""
        name = m.name
        if len(m.args) != count:
            fail(f"{name}_INVALID_ARITY", f"{name} takes {count} arguments")
        ends = []
        for a in m.args[:2]:
            if not isinstance(a, dax.Ref) or a.table is None or a.column is None:
                fail(f"{name}_COLUMN_REQUIRED", f"{name} takes columns")
            ends.append(self.model.column(a.table, a.column))
        found = [r for r in self.model.relationships if {r.left, r.right} == set(ends)]
        if not found:
            fail(f"{name}_RELATIONSHIP_NOT_FOUND", "these columns aren't related")
        if len(found) > 1:
            fail(f"{name}_AMBIGUOUS_RELATIONSHIP", "several relationships have these columns")
        return found[0], ends

    def use_relationship(self, m: dax.Call, now: Context) -> Context:
        r, ends = self.between(m, 2)
        siblings = {x.id for x in self.model.relationships if x.id != r.id and {x.left[0], x.right[0]} == {r.left[0], r.right[0]}}
        ways = dict(now.ways)
        if r.cardinality == ONE_ONE:  # the second column's table filters the first's
            ways[r.id] = "left-to-right" if r.left == ends[1] else "right-to-left"
        return replace(now, active=now.active | {r.id}, off=(now.off - {r.id}) | siblings, ways=tuple(sorted(ways.items())))

    def cross_filter(self, m: dax.Call, now: Context) -> Context:
        r, _ = self.between(m, 3)
        word = m.args[2].table.upper() if isinstance(m.args[2], dax.Ref) and m.args[2].column is None else ""
        if word == "NONE":
            return replace(now, off=now.off | {r.id})
        if word not in DIRECTIONS:
            fail("CROSSFILTER_INVALID_DIRECTION", f"{word or 'that'} is no direction")
        way = DIRECTIONS[word] or (r.direction if r.direction != "both" else "left-to-right")
        if r.cardinality == ONE_MANY and way == "right-to-left" or r.cardinality == ONE_ONE and word == "ONEWAY":
            fail("CROSSFILTER_DIRECTION_INVALID_FOR_CARDINALITY", f"{word} doesn't suit {r.cardinality}")
        return replace(now, active=now.active | {r.id}, off=now.off - {r.id}, ways=tuple(sorted({**dict(now.ways), r.id: way}.items())))


def blank_with_measures(tree) -> bool:
    """Whether a row expression is blank where one of its measures is: between them is nothing but arithmetic."""
    if isinstance(tree, dax.Binary) and tree.sign in ("+", "-", "*", "/"):
        return blank_with_measures(tree.left) and blank_with_measures(tree.right)
    if isinstance(tree, dax.Negate):
        return blank_with_measures(tree.value)
    return isinstance(tree, dax.Ref) or not any(isinstance(n, dax.Ref) and n.table is None for n in dax.walk(tree))


def filter_parts(model: Model, tree: dax.Call) -> tuple[str, list]:
    """(table, predicates) of FILTER(table, predicate), whose table may be a FILTER again."""
    if len(tree.args) != 2:
        fail("INVALID_TABLE_EXPRESSION_ARGUMENT", "FILTER takes a table and a predicate")
    at, test = tree.args
    if isinstance(at, dax.Call) and at.name == "FILTER":
        t, tests = filter_parts(model, at)
        return t, [*tests, test]
    if not isinstance(at, dax.Ref) or at.column is not None:
        fail("INVALID_TABLE_EXPRESSION_ARGUMENT", "FILTER takes a table of the model")
    return model.table(at.table), [test]


def shaped(function: str, value: Column, dtype: str) -> Typed:
    """An aggregate's column and type; counts of nothing are 0."""
    if function in ("COUNT", "DISTINCTCOUNT"):
        return Typed(F.coalesce(value, F.lit(0)), ty.INTEGER)
    return Typed(value, ty.DECIMAL if function == "AVERAGE" else dtype if dtype != ty.NULL else ty.INTEGER)


# Entry points.
def evaluate(model: Model, expressions: dict[str, str], filters: Context | dict | None = None) -> DataFrame:
    """One row with the value of each expression under the filters."""
    model.require_valid_graph()
    ctx = filters if isinstance(filters, Context) else Context.of(checked(model, filters))
    plan = Plan(model)
    return plan.result(None, {n: plan.value(dax.parse(e), ctx) for n, e in expressions.items()}).df


def checked(model: Model, filters: dict | None) -> dict:
    """Filters with their columns' names as the model has them."""
    return {model.column(t, c): v for (t, c), v in (filters or {}).items()}


def grouped(model: Model, dimension: tuple[str, str], expressions: dict[str, str], filters: Context | dict | None = None, member: str = "member") -> DataFrame:
    """A row for each distinct value of a column of its unfiltered table, with each expression's value for it."""
    model.require_valid_graph()
    t, c = model.column(*dimension)
    if model.is_calculated((t, c)):
        fail("UNKNOWN_COLUMN", f"groupings take physical columns; {t}[{c}] is calculated")
    ctx = filters if isinstance(filters, Context) else Context.of(checked(model, filters))
    tag = Tag("member", t, (c,))
    plan = Plan(model)
    plan.tagged[tag.name(c)] = (t, c)
    ctx = ctx.keep((t, c), Filter(tag=tag))
    values = {n: plan.value(dax.parse(e), ctx) for n, e in expressions.items()}
    spine = plan.rows.base(t).df.select(col(cell(t, c)).alias(tag.name(c))).distinct()
    return plan.result(Rel(spine, (tag.name(c),)), values).df.withColumnRenamed(tag.name(c), member)


def check_measure(model: Model, name: str) -> None:
    """Compiles a measure without running it; raises what is wrong with it."""
    if cycle := model.measure_cycle():
        fail("MEASURE_DEPENDENCY_CYCLE", " -> ".join(cycle))
    Plan(model).named(name, EMPTY)
