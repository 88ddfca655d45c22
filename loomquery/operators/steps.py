"""The data-preparation steps: each takes a frame and returns a new one, or raises EngineError and changes nothing.

A step is a dataclass; `apply` compiles it into the frame's lazy plan. Two kinds can fail on a value, `ChangeType` and
`CustomColumn`. With check="eager" they look for such rows first (one job) and raise; with check="lazy" the plan
itself fails on the first such row, so the data are read once.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as ty
from ..diagnostics import Diagnostic, EngineError, fail
from ..functions import formula
from ..shared import written
from .conditions import matches, text_of
from .frame import Col, Frame, hidden, quoted

INVALID = "QUERY_INVALID_STEP_CONFIG"
#: Columns that a pivot makes at most; more is an error.
MOST_PIVOTED = 1000


@dataclass(frozen=True)
class Context:
    """What steps may need besides their frame: other queries' frames by name, and how value errors are found."""

    sources: dict[str, Frame] = field(default_factory=dict)
    check: str = "eager"

    def source(self, name: str) -> Frame:
        if name not in self.sources:
            fail("QUERY_DEPENDENCY_NOT_FOUND", f"there is no query or table {name!r}", source=name)
        return self.sources[name]


@dataclass(frozen=True)
class Step:
    #: Whether the step's result depends on the order of rows.
    needs_order = False
    #: Steps that work row by row, so that they are legal on a stream.
    row_wise = False

    def apply(self, f: Frame, ctx: Context) -> Frame:
        raise NotImplementedError


def _checked(f: Frame, df: DataFrame, error: Column, code: str | None, message: str, check: str, sample: Column) -> DataFrame:
    """`df` unless `error` (a code or null) is set in some row."""
    if check == "lazy":
        return df.filter(F.when(error.isNotNull(), F.raise_error(F.concat(error, F.lit(": " + message))).cast("boolean")).otherwise(True))
    bad = df.filter(error.isNotNull()).select(error.alias("code"), sample.cast("string").alias("v"))
    found = bad.groupBy().agg(F.count("*").alias("n"), F.min("code").alias("code")).first()
    if found["n"]:
        some = [r["v"] for r in bad.limit(5).collect()]
        raise EngineError(Diagnostic(code or found["code"], f"{message}: {found['n']} rows", details={"count": found["n"], "samples": some}))
    return df


@dataclass(frozen=True)
class RenameColumns(Step):
    renames: dict[str, str]
    row_wise = True

    def apply(self, f, ctx):
        for i, name in self.renames.items():
            f.find(i)
            if not name.strip():
                fail(INVALID, "a column needs a name", column=i)
        cols = tuple(replace(c, name=self.renames.get(c.id, c.name).strip() if c.id in self.renames else c.name) for c in f.cols)
        names = [c.name.lower() for c in cols]
        if len(set(names)) < len(names):
            fail("QUERY_DUPLICATE_COLUMN_NAME", "two columns would have one name", names=sorted({n for n in names if names.count(n) > 1}))
        return replace(f, cols=cols)


@dataclass(frozen=True)
class RemoveColumns(Step):
    columns: list[str]
    row_wise = True

    def apply(self, f, ctx):
        gone = {f.find(i).id for i in self.columns}
        left = tuple(c for c in f.cols if c.id not in gone)
        if not left:
            fail("QUERY_NO_COLUMNS", "no column would be left")
        return replace(f, df=f.df.drop(*[hidden(i) for i in gone]), cols=left)


@dataclass(frozen=True)
class ReorderColumns(Step):
    columns: list[str]
    row_wise = True

    def apply(self, f, ctx):
        first = [f.find(i) for i in dict.fromkeys(self.columns)]
        return replace(f, cols=(*first, *(c for c in f.cols if c not in first)))


@dataclass(frozen=True)
class ChangeType(Step):
    changes: dict[str, str]
    row_wise = True

    def apply(self, f, ctx):
        df, cols = f.df, {c.id: c for c in f.cols}
        for i, dtype in self.changes.items():
            c = f.find(i)
            if dtype not in ty.SPARK_TYPE or dtype in (ty.NULL, ty.UNKNOWN):
                fail(INVALID, f"{dtype!r} is no type to change to", column=i)
            old = F.col(quoted(hidden(i)))
            new = converted(old, c.dtype, dtype)
            error = F.when(old.isNotNull() & new.isNull(), F.lit("QUERY_TYPE_CONVERSION_FAILED"))
            df = _checked(f, df, error, None, f"{c.name} has values that are no {dtype}", ctx.check, old).withColumn(hidden(i), new)
            cols[i] = replace(c, dtype=dtype)
        return replace(f, df=df, cols=tuple(cols[c.id] for c in f.cols))


def converted(c: Column, old: str, new: str) -> Column:
    """A value in a new type, or null if that would lose something."""
    if old == new:
        return c
    if new == ty.STRING:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if old == ty.DATETIME else text_of(c, old)
    text = F.trim(text_of(c, old))
    if new == ty.INTEGER:
        return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    if new == ty.DECIMAL:
        return c.cast("double") if old == ty.INTEGER else F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
    if new == ty.BOOLEAN:
        low = F.lower(text)
        return F.when(low == "true", True).when(low == "false", False)
    if new == ty.DATE:
        return F.to_date(c) if old == ty.DATETIME else F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(text, 1, 10).try_cast("date"))
    return c.cast("timestamp") if old == ty.DATE else F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), text.try_cast("timestamp"))


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: Any = None

    def holds(self, f: Frame) -> Column:
        c = f.find(self.column)
        return matches(f.col(c.id), c.dtype, self.operator, self.value)


@dataclass(frozen=True)
class FilterRows(Step):
    conditions: list[Condition]
    logic: str = "and"
    row_wise = True

    def apply(self, f, ctx):
        if not self.conditions or self.logic not in ("and", "or"):
            fail("QUERY_INVALID_FILTER", "a filter needs conditions, joined by and/or")
        tests = [c.holds(f) for c in self.conditions]
        return replace(f, df=f.df.filter(functools.reduce((lambda a, b: a & b) if self.logic == "and" else (lambda a, b: a | b), tests)))


@dataclass(frozen=True)
class ReplaceValues(Step):
    replacements: list[tuple[str, Any, Any]]  # (column, find, replace), applied in turn
    row_wise = True

    def apply(self, f, ctx):
        df = f.df
        for i, find, new in self.replacements:
            c = f.find(i)
            if new is not None and c.dtype not in (ty.UNKNOWN, ty.NULL) and ty.common_type([c.dtype, ty.literal_type(new)]) != c.dtype:
                fail(INVALID, f"{new!r} is no {c.dtype}", column=i)
            if find is not None and ty.family(ty.literal_type(find)) != ty.family(c.dtype):
                continue  # no cell of this type equals it
            to, own = ty.SPARK_TYPE[c.dtype], F.col(quoted(hidden(i)))
            df = df.withColumn(hidden(i), F.when(own.eqNullSafe(F.lit(find).cast(to)), F.lit(new).cast(to)).otherwise(own))
        return replace(f, df=df)


@dataclass(frozen=True)
class RemoveDuplicates(Step):
    columns: list[str] = field(default_factory=list)

    @property
    def needs_order(self):
        return bool(self.columns)

    def apply(self, f, ctx):
        ids = [f.find(i).id for i in self.columns]
        if not ids and not f.order:
            return replace(f, df=f.df.dropDuplicates([hidden(c.id) for c in f.cols]))
        # Of each group the first row: a grouped minimum combines before it shuffles, which a window doesn't.
        f = f.ordered()
        keys = ids or [c.id for c in f.cols]
        rest = [c for c in f.df.columns if c not in {hidden(i) for i in keys}]
        least = F.min_by(F.struct(*[F.col(quoted(c)) for c in rest]), sort_rank(f.df, f.order)) if rest else F.lit(None)
        df = f.df.groupBy(*[F.col(quoted(hidden(i))) for i in keys]).agg(least.alias("first"))
        df = df.select(*[F.col(quoted(hidden(i))) for i in keys], *[F.col("first").getField(c).alias(c) for c in rest])
        return replace(f, df=df)


def sort_rank(df: DataFrame, order: tuple[tuple[str, bool], ...]) -> Column:
    """Rows' places in an order as one struct that ascends, so that grouped minima find first rows."""
    parts = []
    for k, (name, up) in enumerate(order):
        c, kind = F.col(quoted(name)), df.schema[name].dataType
        if up:
            parts += [c.isNotNull().alias(f"k{k}"), c.alias(f"v{k}")]
            continue
        if isinstance(kind, T.StringType):  # bytes complemented; a prefix of a text sorts behind it
            c = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
        elif isinstance(kind, T.BooleanType):
            c = ~c
        elif isinstance(kind, T.DateType):
            c = -F.unix_date(c)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = -F.unix_micros(c.cast("timestamp"))
        else:
            c = -c
        parts += [F.col(quoted(name)).isNull().alias(f"k{k}"), c.alias(f"v{k}")]
    return F.struct(*parts)


@dataclass(frozen=True)
class SortRows(Step):
    keys: list[tuple[str, str]]  # (column, "asc" or "desc")

    def apply(self, f, ctx):
        if not self.keys or any(d not in ("asc", "desc") for _, d in self.keys):
            fail(INVALID, "a sort needs columns, each asc or desc")
        df, order = f.df, []
        for n, (i, direction) in enumerate(self.keys):
            name = f"__sort{len(f.order)}_{n}"
            df = df.withColumn(name, f.col(f.find(i).id))
            order.append((name, direction == "asc"))
        return replace(f, df=df, order=(*order, *f.order))


@dataclass(frozen=True)
class Fill(Step):
    columns: list[str]
    direction: str = "down"
    needs_order = True

    def apply(self, f, ctx):
        if self.direction not in ("down", "up"):
            fail(INVALID, "fill goes down or up")
        f = f.ordered()
        ids = [f.find(i).id for i in self.columns]
        df = filled(f.df, [hidden(i) for i in ids], f.sort_keys(flip=self.direction == "up"))
        return replace(f, df=df)


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows cut into ranges along `order`, numbered by `__part`.

    The bounds come from a sample, so what reads the ranges twice must read the same cut: it is written to the shared folder
    (a job of its own), which outlives lost executors and goes when the driver ends.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def filled(df: DataFrame, names: list[str], order: list[Column]) -> DataFrame:
    """Last non-blank value carried along `order`, without bringing all rows into one task.

    Rows are cut into range partitions; each is filled on its own, and what is open at its start comes from the last
    value of the partitions before it, one row each.
    """
    df = in_ranges(df, order)
    own = Window.partitionBy("__part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__at", F.row_number().over(own))
    ends = df.groupBy("__part").agg(*[F.max_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), F.col("__at"))).alias(f"__e{k}") for k, c in enumerate(names)])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__part"), *[F.last(f"__e{k}", True).over(before).alias(f"__e{k}") for k in range(len(names))])
    df = df.withColumns({c: F.last(F.col(quoted(c)), True).over(upto) for c in names}).join(F.broadcast(ends), "__part", "left")
    df = df.withColumns({c: F.coalesce(F.col(quoted(c)), F.col(f"__e{k}")) for k, c in enumerate(names)})
    return df.drop("__part", "__at", *[f"__e{k}" for k in range(len(names))])


@dataclass(frozen=True)
class SplitColumn(Step):
    column: str
    delimiter: str
    names: tuple[str, str]
    ids: tuple[str, str]
    remove_source: bool = False
    row_wise = True

    def apply(self, f, ctx):
        if not self.delimiter:
            fail(INVALID, "a split needs a delimiter")
        c = f.find(self.column)
        text = text_of(f.col(c.id), c.dtype)
        at, size = F.instr(text, self.delimiter), len(self.delimiter)
        first = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
        second = F.when(at > 0, F.substring(text, at + size, F.length(text)))
        new = {self.ids[0]: (self.names[0], ty.STRING, first), self.ids[1]: (self.names[1], ty.STRING, second)}
        return _without(f.with_columns(new, {c.id} if self.remove_source else frozenset()), f, {c.id} if self.remove_source else set())


def _without(made: Frame, old: Frame, gone: set[str]) -> Frame:
    return replace(made, df=made.df.drop(*[hidden(i) for i in gone])) if gone else made


@dataclass(frozen=True)
class MergeColumns(Step):
    columns: list[str]
    delimiter: str
    name: str
    id: str
    remove_source: bool = False
    row_wise = True

    def apply(self, f, ctx):
        if len(self.columns) < 2:
            fail(INVALID, "a merge needs two columns or more")
        cols = [f.find(i) for i in self.columns]
        # A blank keeps its slot.
        text = F.array_join(F.array(*[text_of(f.col(c.id), c.dtype) for c in cols]), self.delimiter, "")
        gone = {c.id for c in cols} if self.remove_source else set()
        return _without(f.with_columns({self.id: (self.name, ty.STRING, text)}, gone), f, gone)


@dataclass(frozen=True)
class Aggregation:
    id: str
    name: str
    function: str  # count-rows, sum, average, min, max
    column: str | None = None


@dataclass(frozen=True)
class GroupBy(Step):
    columns: list[str]
    aggregations: list[Aggregation]

    def apply(self, f, ctx):
        if not self.aggregations and not self.columns:
            fail(INVALID, "a grouping needs columns or aggregations")
        keys = [f.find(i) for i in self.columns]
        made, cols = [], list(keys)
        for a in self.aggregations:
            value, dtype = aggregate(f, a)
            made.append(value.alias(hidden(a.id)))
            cols.append(Col(a.id, a.name, dtype))
        names = [c.name.lower() for c in cols]
        if len(set(names)) < len(names):
            fail("QUERY_DUPLICATE_COLUMN_NAME", "two columns would have one name")
        order = [F.min(sort_rank(f.df, f.order)).alias("__group")] if f.order else []
        count = [F.count(F.lit(1)).alias("__n")]
        df = f.df.groupBy(*[F.col(quoted(hidden(c.id))) for c in keys]).agg(*made, *order, *count)
        if not keys:
            df = df.filter("__n > 0")  # no rows: no group
        return Frame(df.drop("__n"), tuple(cols), (("__group", True),) if f.order else ())


def aggregate(f: Frame, a: Aggregation) -> tuple[Column, str]:
    if a.function == "count-rows":
        return F.count(F.lit(1)), ty.INTEGER
    if a.column is None or a.function not in ("sum", "average", "min", "max"):
        fail(INVALID, f"no aggregation: {a.function!r} of {a.column!r}")
    c = f.find(a.column)
    allowed = ty.NUMERIC if a.function in ("sum", "average") else ty.NUMERIC | ty.TEMPORAL
    if c.dtype not in allowed:
        fail(INVALID, f"{a.function} doesn't take the {c.dtype} column {c.name}", column=c.id)
    run = {"sum": F.sum, "average": F.avg, "min": F.min, "max": F.max}[a.function]
    return run(f.col(c.id)), ty.DECIMAL if a.function == "average" else c.dtype


JOINS = {"left-outer": "left", "right-outer": "right", "full-outer": "full", "inner": "inner", "left-anti": "left_anti", "right-anti": "left_anti"}


@dataclass(frozen=True)
class MergeQueries(Step):
    right: str
    kind: str
    left_keys: list[str]
    right_keys: list[str]
    expand: list[tuple[str, str, str]]  # (right column, new id, new name)

    def apply(self, f, ctx):
        r = ctx.source(self.right)
        if self.kind not in JOINS or not self.left_keys or len(self.left_keys) != len(self.right_keys):
            fail(INVALID, "a merge needs a join kind and as many left keys as right keys")
        lk, rk = [f.find(i) for i in self.left_keys], [r.find(i, "QUERY_DEPENDENCY_SCHEMA_CHANGED") for i in self.right_keys]
        for a, b in zip(lk, rk, strict=True):
            if ty.family(a.dtype) != ty.family(b.dtype):
                fail("QUERY_JOIN_KEY_TYPE_MISMATCH", f"{a.name} is {a.dtype}, {b.name} is {b.dtype}")
        names = [c.name.lower() for c in f.cols] + [n.lower() for _, _, n in self.expand]
        if len(set(names)) < len(names):
            fail("QUERY_MERGE_COLUMN_COLLISION", "an expanded column has a name that is there already")
        new = [(r.find(i, "QUERY_DEPENDENCY_SCHEMA_CHANGED"), n, name) for i, n, name in self.expand]
        # The right side under names of its own, so that its keys are never the left's.
        right = r.df.select(
            *[F.col(quoted(hidden(b.id))).alias(f"__k{k}") for k, b in enumerate(rk)],
            *[F.col(quoted(hidden(c.id))).alias(hidden(i)) for c, i, _ in new],
            *[F.col(quoted(n)).alias(f"__r{k}") for k, (n, _) in enumerate(r.order)],
        )
        on = functools.reduce(lambda x, y: x & y, [f.df[quoted(hidden(a.id))] == right[f"__k{k}"] for k, a in enumerate(lk)])
        cols = (*f.cols, *(Col(i, name, c.dtype) for c, i, name in new))
        left_rank, right_rank = list(f.order), [(f"__r{k}", up) for k, (_, up) in enumerate(r.order)]
        if self.kind == "left-anti":
            df = f.df.join(right, on, "left_anti").withColumns({hidden(i): F.lit(None).cast(ty.SPARK_TYPE[c.dtype]) for c, i, _ in new})
            return replace(f, df=df, cols=cols)
        if self.kind == "right-anti":
            df = right.join(f.df, on, "left_anti").withColumns({hidden(c.id): F.lit(None).cast(ty.SPARK_TYPE[c.dtype]) for c in f.cols})
            return Frame(df, cols, tuple(right_rank))
        df = f.df.withColumn("__left", F.lit(True)).join(right, on, JOINS[self.kind])
        order = []
        if left_rank or right_rank:
            df = df.withColumn("__late", F.col("__left").isNull())  # unmatched right rows come last
            order = [("__late", True), *left_rank, *right_rank]
        return Frame(df.drop("__left", *[f"__k{k}" for k in range(len(rk))]), cols, tuple(order))


@dataclass(frozen=True)
class AppendQueries(Step):
    sources: list[str]
    row_wise = True

    def apply(self, f, ctx):
        frames = [f, *(ctx.source(s) for s in self.sources)]
        names: dict[str, Col] = {}
        for x in frames:
            for c in x.cols:
                names.setdefault(c.name.lower(), c)
        cols = []
        for key, c in names.items():
            dtype = ty.common_type([own.dtype for x in frames for own in x.cols if own.name.lower() == key])
            if dtype is None:
                fail(INVALID, f"column {c.name} has types that don't go together")
            cols.append(replace(c, id=c.id if c in f.cols else f"append:{c.name}", dtype=dtype))
        ordered = any(x.order for x in frames)
        parts = []
        for n, x in enumerate(frames):
            own = {c.name.lower(): c for c in x.cols}
            if ordered and [k for k, _ in x.order] != ["__row"]:
                x = replace(x, df=numbered(x.df, x.sort_keys(), "__row")) if x.order else x.ordered()
            rank = [F.lit(n).alias("__source"), F.col("__row")] if ordered else []
            cell = lambda key, x=x, own=own: F.col(quoted(hidden(own[key].id))) if key in own else F.lit(None)
            parts.append(x.df.select(*[cell(c.name.lower()).cast(ty.SPARK_TYPE[c.dtype]).alias(hidden(c.id)) for c in cols], *rank))
        df = functools.reduce(lambda a, b: a.unionByName(b), parts)
        return Frame(df, tuple(cols), (("__source", True), ("__row", True)) if ordered else ())


@dataclass(frozen=True)
class PivotColumn(Step):
    id: str  # names the step: new columns' ids derive from it and the pivot value
    pivot: str
    value: str
    aggregation: str  # sum, count, min, max, first

    @property
    def needs_order(self):
        return self.aggregation == "first"

    def apply(self, f, ctx):
        p, v = f.find(self.pivot), f.find(self.value)
        if p.id == v.id:
            fail(INVALID, "pivot and value must be different columns")
        if self.aggregation not in ("sum", "count", "min", "max", "first"):
            fail("QUERY_PIVOT_AGGREGATION_INVALID", f"no aggregation: {self.aggregation!r}")
        if self.aggregation == "sum" and v.dtype not in ty.NUMERIC or self.aggregation in ("min", "max") and v.dtype not in ty.NUMERIC | ty.TEMPORAL:
            fail("QUERY_PIVOT_VALUE_TYPE_INVALID", f"{self.aggregation} doesn't take the {v.dtype} column {v.name}")
        if self.aggregation == "first":
            f = f.ordered()
        text = text_of(f.col(p.id), p.dtype)
        label = F.when(text.isNull() | (text == ""), "(blank)").otherwise(text)
        found = sorted(r[0] for r in f.df.select(label).distinct().limit(MOST_PIVOTED + 1).collect())
        if len(found) > MOST_PIVOTED:
            fail("QUERY_COLUMN_LIMIT_EXCEEDED", f"{p.name} has more than {MOST_PIVOTED} values to make columns of", limit=MOST_PIVOTED)
        others = [c for c in f.cols if c.id not in (p.id, v.id)]
        names = [c.name.lower() for c in others] + [x.lower() for x in found]
        if len(set(names)) < len(names):
            fail("QUERY_PIVOT_SCHEMA_COLLISION", "a pivoted value has a name that is there already")
        own = f.col(v.id)
        if self.aggregation == "first":
            agg = F.min_by(F.struct(own.alias("v")), sort_rank(f.df, f.order))["v"]
        else:
            agg = {"sum": F.sum(own), "count": F.count(F.lit(1)), "min": F.min(own), "max": F.max(own)}[self.aggregation]
        dtype = ty.INTEGER if self.aggregation == "count" else v.dtype
        cols = [Col(pivot_id(self.id, x), x, dtype) for x in found]
        keyed = f.df.withColumn("__pivot", label)
        df = keyed.groupBy(*[F.col(quoted(hidden(c.id))) for c in others]).pivot("__pivot", found).agg(agg) if found else keyed.groupBy(*[F.col(quoted(hidden(c.id))) for c in others]).agg(F.lit(1).alias("__n")).drop("__n")
        df = df.select(*[F.col(quoted(hidden(c.id))) for c in others], *[F.col(quoted(c.name)).alias(hidden(c.id)) for c in cols])
        return Frame(df, (*others, *cols))


def pivot_id(step: str, value: str) -> str:
    return f"{step}:{hashlib.sha1(value.encode()).hexdigest()[:12]}"


@dataclass(frozen=True)
class UnpivotColumns(Step):
    columns: list[str]
    mode: str = "selected"  # or "other-columns"
    attribute: tuple[str, str] = ("attribute", "Attribute")  # (id, name)
    value: tuple[str, str] = ("value", "Value")

    def apply(self, f, ctx):
        given = [f.find(i, "QUERY_UNPIVOT_COLUMN_NOT_FOUND") for i in self.columns]
        turned = given if self.mode == "selected" else [c for c in f.cols if c not in given]
        if not turned or self.mode not in ("selected", "other-columns"):
            fail(INVALID, "an unpivot needs columns to turn")
        kept = [c for c in f.cols if c not in turned]
        dtype = ty.common_type([c.dtype for c in turned])
        to = dtype or ty.UNKNOWN
        cell = lambda c: (f.col(c.id) if dtype else text_of(f.col(c.id), c.dtype)).cast(ty.SPARK_TYPE[to])
        # One pass and no shuffle: each row becomes one for each turned column, blanks too.
        cells = F.array(*[F.struct(F.lit(n).alias("__turn"), F.lit(c.name).alias(hidden(self.attribute[0])), cell(c).alias(hidden(self.value[0]))) for n, c in enumerate(turned)])
        order = [F.col(quoted(n)) for n, _ in f.order]
        df = f.df.select(*[F.col(quoted(hidden(c.id))) for c in kept], *order, F.inline(cells))
        cols = (*kept, Col(self.attribute[0], self.attribute[1], ty.STRING), Col(self.value[0], self.value[1], to))
        return Frame(df, cols, (*f.order, ("__turn", True)) if f.order else ())


@dataclass(frozen=True)
class ConditionalColumn(Step):
    id: str
    name: str
    clauses: list[tuple[Condition, Any]]
    otherwise: Any = None
    row_wise = True

    def apply(self, f, ctx):
        if not self.clauses:
            fail(INVALID, "a conditional column needs clauses")
        dtype = ty.common_type([ty.literal_type(v) for _, v in self.clauses] + [ty.literal_type(self.otherwise)])
        if dtype is None:
            fail("QUERY_CONDITIONAL_INVALID_RESULT_TYPE", "the results' types don't go together")
        to, out = ty.SPARK_TYPE[dtype], None
        for test, v in self.clauses:
            out = (F if out is None else out).when(test.holds(f), F.lit(v).cast(to))
        return f.with_columns({self.id: (self.name, dtype, out.otherwise(F.lit(self.otherwise).cast(to)))})


@dataclass(frozen=True)
class IndexColumn(Step):
    id: str
    name: str
    start: float = 0
    increment: float = 1
    needs_order = True

    def apply(self, f, ctx):
        if not self.increment or any(x != x or abs(x) == float("inf") for x in (self.start, self.increment)):
            fail("QUERY_INDEX_INVALID_CONFIG", "an index needs a finite start and an increment other than 0")
        f = f.ordered()
        whole = float(self.start).is_integer() and float(self.increment).is_integer()
        df = numbered(f.df, f.sort_keys(), "__n")
        value = F.lit(self.start) + F.col("__n") * F.lit(self.increment)
        made = replace(f, df=df).with_columns({self.id: (self.name, ty.INTEGER if whole else ty.DECIMAL, value.cast("bigint" if whole else "double"))})
        return replace(made, df=made.df.drop("__n"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 along `order`: within range partitions, plus the sizes of those before, a row each."""
    df = in_ranges(df, order)
    df = df.withColumn(name, F.row_number().over(Window.partitionBy("__part").orderBy(*order)).cast("bigint") - 1)
    sizes = df.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return df.withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


@dataclass(frozen=True)
class CustomColumn(Step):
    id: str
    name: str
    expression: str
    row_wise = True

    def apply(self, f, ctx):
        v = formula.compiled(self.expression, f)
        df = f.df if v.error is None else _checked(f, f.df, v.error, None, f"{self.name} has rows that can't be computed", ctx.check, F.lit(self.name))
        return replace(f, df=df).with_columns({self.id: (self.name, v.dtype, v.column)})


KINDS = {
    "rename-columns": RenameColumns, "remove-columns": RemoveColumns, "reorder-columns": ReorderColumns, "change-type": ChangeType,
    "filter-rows": FilterRows, "replace-values": ReplaceValues, "remove-duplicates": RemoveDuplicates, "sort-rows": SortRows, "fill": Fill,
    "split-column": SplitColumn, "merge-columns": MergeColumns, "group-by": GroupBy, "merge-queries": MergeQueries, "append-queries": AppendQueries,
    "pivot-column": PivotColumn, "unpivot-columns": UnpivotColumns, "conditional-column": ConditionalColumn, "index-column": IndexColumn, "custom-column": CustomColumn,
}
