"""The semantic model: tables, relationships, calculated columns, measures, date tables; and its checks."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import Diagnostic, EngineError, fail
from . import dax

ONE_MANY, ONE_ONE, MANY_MANY = "one-to-many", "one-to-one", "many-to-many"


@dataclass(frozen=True)
class Relationship:
    """`left` is the one side of a one-to-many relationship; `direction` says which side filters which."""

    left: tuple[str, str]
    right: tuple[str, str]
    cardinality: str = ONE_MANY
    direction: str = "left-to-right"  # right-to-left, both
    active: bool = True

    @property
    def id(self) -> str:
        return f"{self.left[0]}[{self.left[1]}]-{self.right[0]}[{self.right[1]}]"

    def edges(self, direction: str | None = None) -> list[tuple[tuple[str, str], tuple[str, str]]]:
        way = direction or self.direction
        return [(self.left, self.right)] * (way != "right-to-left") + [(self.right, self.left)] * (way != "left-to-right")


@dataclass(frozen=True)
class Measure:
    name: str
    expression: str
    home: str | None = None


@dataclass(frozen=True)
class CalculatedColumn:
    table: str
    name: str
    expression: str


@dataclass
class Model:
    tables: dict[str, DataFrame]
    relationships: list[Relationship] = field(default_factory=list)
    measures: dict[str, str] = field(default_factory=dict)
    calculated: dict[tuple[str, str], str] = field(default_factory=dict)
    date_tables: dict[str, str] = field(default_factory=dict)  # table: date column
    #: Columns that identify a table's rows; context transition then tags rows by them instead of by all columns.
    keys: dict[str, str] = field(default_factory=dict)
    #: Where tables come from (a file's, sheet's, sample's or query's name), for those who name them by it.
    source_keys: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self._types: dict[str, dict[str, str]] = {}  # by table, as they are asked for: `tables` may be lazy

    # Names are looked up without regard to case.
    def table(self, name: str) -> str:
        for t in self.tables:
            if t.lower() == name.lower():
                return t
        return fail("UNKNOWN_TABLE", f"there is no table {name}", table=name)

    def column(self, table: str, name: str) -> tuple[str, str]:
        t = self.table(table)
        for c in self.columns(t):
            if c.lower() == name.lower():
                return t, c
        for (ct, c) in self.calculated:
            if ct == t and c.lower() == name.lower():
                return t, c
        return fail("UNKNOWN_COLUMN", f"there is no column {t}[{name}]", table=t, column=name)

    def columns(self, table: str) -> dict[str, str]:
        """Physical columns and their types."""
        if table not in self._types:
            self._types[table] = {f.name: ty.logical_type(f.dataType) for f in self.tables[table].schema.fields}
        return self._types[table]

    def is_calculated(self, column: tuple[str, str]) -> bool:
        return column in self.calculated

    def measure(self, name: str) -> tuple[str, str] | None:
        for m, text in self.measures.items():
            if m.lower() == name.lower():
                return m, text
        return None

    # Definitions, checked as they are added.
    def add_measure(self, name: str, expression: str) -> None:
        if self.measure(name):
            fail("DUPLICATE_MEASURE", f"there is a measure [{name}]")
        from .measures import check_measure

        trial = replace(self, measures={**self.measures, name: expression})
        check_measure(trial, name)
        self.measures[name] = expression

    def add_column(self, table: str, name: str, expression: str) -> None:
        t = self.table(table)
        if name.lower() in {c.lower() for c in self.columns(t)}:
            fail("COLUMN_NAME_CONFLICT", f"{t} has a column {name}")
        if any(ct == t and c.lower() == name.lower() for ct, c in self.calculated):
            fail("DUPLICATE_CALCULATED_COLUMN", f"{t} has a calculated column {name}")
        from .measures import calculated_value

        calculated_value(self, t, expression)
        self.calculated[t, name] = expression

    def measure_cycle(self) -> list[str] | None:
        """The names of measures that depend on each other in a circle."""
        needs = {m: {x for t, c in dax.references(dax.parse(text)) if t is None and (x := (self.measure(c) or [None])[0])} for m, text in self.measures.items()}

        def visit(m: str, path: list[str]) -> list[str] | None:
            if m in path:
                return path[path.index(m) :] + [m]
            for n in sorted(needs[m]):
                if found := visit(n, [*path, m]):
                    return found
            return None

        return next((c for m in needs if (c := visit(m, []))), None)

    # The relationship graph.
    def edges(self, relationships=None):
        return [e for r in (self.relationships if relationships is None else relationships) if r.active for e in r.edges()]

    def ambiguous(self) -> tuple[str, str] | None:
        """Two tables with more than one directed path of active relationships between them."""
        out = defaultdict(list)
        for (a, _), (b, _) in self.edges():
            out[a].append(b)

        def paths(a: str, seen: frozenset) -> dict[str, int]:
            counts: dict[str, int] = defaultdict(int)
            for b in out[a]:
                if b not in seen:
                    counts[b] += 1
                    for c, n in paths(b, seen | {b}).items():
                        counts[c] += n
            return counts

        for t in self.tables:
            for u, n in paths(t, frozenset({t})).items():
                if n > 1:
                    return t, u
        return None

    def require_valid_graph(self) -> None:
        if pair := self.ambiguous():
            raise EngineError(Diagnostic("FILTER_GRAPH_INVALID", f"{pair[0]} reaches {pair[1]} by more than one path", details={"reason": "AMBIGUOUS_FILTER_PATH"}))

    def check_relationship(self, r: Relationship) -> list[Diagnostic]:
        """Findings on a relationship that is to be added: its shape, then (one job) its data."""
        out: list[Diagnostic] = []
        say = lambda code, message, severity="error", **d: out.append(Diagnostic(code, message, severity, d))
        kinds = []
        for t, c in (r.left, r.right):
            if t not in self.tables or c not in self.columns(t):
                say("MISSING_REFERENCE", f"there is no {t}[{c}]")
            else:
                kinds.append(self.columns(t)[c])
        if r.left[0] == r.right[0]:
            say("SELF_RELATIONSHIP", "a table can't be related to itself")
        if len(kinds) == 2 and (ty.family(kinds[0]) != ty.family(kinds[1]) or {ty.NULL, ty.UNKNOWN} & set(kinds)):
            say("COLUMN_TYPE_MISMATCH", f"{kinds[0]} and {kinds[1]} can't be related")
        if r.cardinality not in (ONE_MANY, ONE_ONE, MANY_MANY):
            say("INVALID_CARDINALITY", f"no cardinality: {r.cardinality}")
        if r.direction not in ("left-to-right", "right-to-left", "both") or r.cardinality == ONE_MANY and r.direction == "right-to-left":
            say("INVALID_CROSS_FILTER_DIRECTION", f"{r.direction} doesn't suit {r.cardinality}")
        if r.cardinality == ONE_ONE and r.direction != "both":
            say("ONE_TO_ONE_REQUIRES_BOTH", "a one-to-one relationship filters both ways")
        if any({r.left, r.right} == {x.left, x.right} for x in self.relationships):
            say("DUPLICATE_RELATIONSHIP", "these columns are related already")
        if any(d.severity == "error" for d in out):
            return out
        stats = self._key_stats(r)
        unique = lambda side: stats[f"{side}_rows"] == stats[f"{side}_keys"]
        if r.cardinality == ONE_MANY and not unique("left"):
            say("ONE_SIDE_NOT_UNIQUE", f"{r.left[0]}[{r.left[1]}] has repeated values")
        if r.cardinality == ONE_ONE:
            for side, code in (("left", "LEFT_SIDE_NOT_UNIQUE"), ("right", "RIGHT_SIDE_NOT_UNIQUE")):
                if not unique(side):
                    say(code, f"the {side} side has repeated values")
            say("ONE_TO_ONE_COVERAGE", "how many keys meet", "info", left=stats["left_keys"], right=stats["right_keys"], matched=stats["matched_keys"])
        if r.cardinality == ONE_MANY and stats["matched_rows"] < stats["right_rows"]:
            say("UNMATCHED_FOREIGN_KEYS", "rows of the many side have no partner", "warning", unmatched=stats["right_rows"] - stats["matched_rows"], rate=stats["matched_rows"] / stats["right_rows"])
        if r.cardinality == MANY_MANY:
            say("MANY_TO_MANY_RELATIONSHIP", "both sides may repeat", "warning")
        if r.direction == "both" and r.cardinality != ONE_ONE:
            say("BIDIRECTIONAL_RELATIONSHIP", "filters go both ways", "warning")
        if r.active and replace(self, relationships=[*self.relationships, r]).ambiguous():
            say("RELATIONSHIP_CREATES_AMBIGUOUS_PATH", "two tables would be joined by more than one path")
        return out

    def _key_stats(self, r: Relationship) -> dict:
        """Rows and distinct keys of both sides and how they meet, blanks aside, in one plan."""
        side = lambda at, n: self.tables[at[0]].select(F.col(f"`{at[1]}`").alias("k")).filter("k is not null").groupBy("k").agg(F.count("*").alias(n))
        both = side(r.left, "l").join(side(r.right, "r"), "k", "full")
        met = F.col("l").isNotNull() & F.col("r").isNotNull()
        row = both.agg(F.sum("l").alias("left_rows"), F.count("l").alias("left_keys"), F.sum("r").alias("right_rows"), F.count("r").alias("right_keys"), F.sum(F.when(met, F.col("r"))).alias("matched_rows"), F.count(F.when(met, 1)).alias("matched_keys")).first()
        return {k: v or 0 for k, v in row.asDict().items()}

    def add_relationship(self, r: Relationship) -> list[Diagnostic]:
        """Adds a relationship unless it has errors, which are raised; warnings are returned."""
        found = self.check_relationship(r)
        errors = [d for d in found if d.severity == "error"]
        if errors:
            raise EngineError(*errors)
        self.relationships.append(r)
        return found

    def roles(self) -> dict[str, str]:
        """fact, dimension or isolated, from active one-to-many relationships."""
        many = {r.right[0] for r in self.relationships if r.active and r.cardinality == ONE_MANY}
        one = {r.left[0] for r in self.relationships if r.active and r.cardinality == ONE_MANY}
        near = {t for r in self.relationships for t in (r.left[0], r.right[0])}
        return {t: "fact" if t in many - one else "dimension" if t in one else "isolated" if t not in near else "other" for t in self.tables}

    def findings(self) -> list[Diagnostic]:
        """What is worth knowing about the model's shape."""
        out: list[Diagnostic] = []
        say = lambda code, message, severity="info", **d: out.append(Diagnostic(code, message, severity, d))
        if pair := self.ambiguous():
            say("AMBIGUOUS_FILTER_PATH", f"{pair[0]} reaches {pair[1]} by more than one path", "error", tables=list(pair))
        roles = self.roles()
        for t, role in roles.items():
            if role == "isolated" and len(self.tables) > 1:
                say("ISOLATED_TABLE", f"{t} has no relationship", "warning", table=t)
        facts = [t for t, role in roles.items() if role == "fact"]
        if len(facts) > 1:
            say("MULTIPLE_FACT_TABLES", "several tables are on the many side alone", tables=facts)
        many = {r.right[0] for r in self.relationships if r.active and r.cardinality == ONE_MANY}
        for t, role in roles.items():
            if role == "dimension" and t in many:
                say("DIMENSION_ON_MANY_SIDE", f"{t} is a dimension of one table and on the many side of another", "warning", table=t)
        pairs = defaultdict(list)
        for r in self.relationships:
            pairs[frozenset((r.left[0], r.right[0]))].append(r)
            if not r.active:
                say("INACTIVE_RELATIONSHIP", f"{r.id} is inactive", relationship=r.id)
            if r.active and r.direction == "both" and r.cardinality != ONE_ONE:
                say("BIDIRECTIONAL_FILTERING_WARNING", f"{r.id} filters both ways", "warning", relationship=r.id)
            if r.active and r.cardinality == MANY_MANY:
                say("MANY_TO_MANY_WARNING", f"{r.id} may repeat on both sides", "warning", relationship=r.id)
        for names, rs in pairs.items():
            if len(rs) > 1:
                say("MULTIPLE_RELATIONSHIPS_BETWEEN_TABLES", "two tables have several relationships", tables=sorted(names))
                if any(t in self.date_tables for t in names) or sum(r.active for r in rs) == 1:
                    say("ROLE_PLAYING_RELATIONSHIP_PATTERN", "one table plays several roles for another", tables=sorted(names))
        if facts and not any(d.severity != "info" for d in out):
            say("STAR_SCHEMA_VALID", "dimensions filter facts by single paths")
        return out

    def check_date_table(self, table: str, column: str) -> list[Diagnostic]:
        """Findings on a table that is to be marked as a date table (one job)."""
        say = lambda code, message, **d: [Diagnostic(code, message, details=d)]
        if table not in self.tables:
            return say("DATE_TABLE_NOT_FOUND", f"there is no table {table}")
        if column not in self.columns(table):
            return say("DATE_COLUMN_NOT_FOUND", f"there is no {table}[{column}]")
        if self.columns(table)[column] not in ty.TEMPORAL:
            return say("DATE_TABLE_INVALID_TYPE", f"{table}[{column}] is no date")
        c = F.col(f"`{column}`")
        day, time = F.to_date(c), F.date_format(c, "HH:mm:ss.SSSSSS")
        s = self.tables[table].agg(F.count("*").alias("rows"), F.count(c).alias("filled"), F.count_distinct(day).alias("days"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.count_distinct(time).alias("times")).first()
        out = []
        if s["rows"] > s["filled"]:
            out += say("DATE_TABLE_DATE_HAS_BLANKS", "the date column has blanks", blanks=s["rows"] - s["filled"])
        if s["filled"] > s["days"]:
            out += say("DATE_TABLE_DATE_NOT_UNIQUE", "a date repeats")
        if s["days"] and (s["hi"] - s["lo"]).days + 1 != s["days"]:
            out += say("DATE_TABLE_NOT_CONTIGUOUS", "days are missing")
        if s["times"] > 1:
            out += say("DATE_TABLE_INCONSISTENT_TIME", "dates have different times of day")
        return out

    def mark_date_table(self, table: str, column: str) -> None:
        found = self.check_date_table(table, column)
        if found:
            raise EngineError(*found)
        self.date_tables[table] = column

    def unmark_date_table(self, table: str) -> None:
        self.date_tables.pop(table, None)
