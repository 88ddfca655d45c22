"""Filter contexts as immutable, hashable values: what a measure's position says about which rows it sees.

A column's filter is a set of values, or a tag, or both. A tag stands for "the current member" of a grouping, whose
value differs from result row to result row; it is what lets one plan compute a measure for all members at once.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

Column = tuple[str, str]


@dataclass(frozen=True)
class Tag:
    """A grouping: its members are tuples of the values of some columns of one table."""

    id: str
    table: str
    columns: tuple[str, ...]

    def name(self, column: str) -> str:
        return f"{self.id}:{column}"

    def names(self) -> list[str]:
        return [self.name(c) for c in self.columns]


@dataclass(frozen=True)
class Filter:
    values: frozenset | None = None
    tag: Tag | None = None

    def meet(self, other: Filter) -> Filter:
        values = other.values if self.values is None else self.values if other.values is None else self.values & other.values
        return Filter(values, other.tag or self.tag)


@dataclass(frozen=True)
class Selection:
    """Rows of a table: those visible in `ambient` for which `predicate` holds; or, with `dates`, a set of dates."""

    ambient: Any  # a Context
    predicate: Any = None  # a tree
    scope: frozenset | None = None  # the columns it is about; None: the whole table
    dates: Any = None  # (function, arguments)


@dataclass(frozen=True)
class Context:
    filters: tuple[tuple[Column, Filter], ...] = ()
    selections: tuple[tuple[str, tuple[Selection, ...]], ...] = ()
    active: frozenset = frozenset()  # relationship ids that are switched on
    off: frozenset = frozenset()  # and off; off wins
    ways: tuple[tuple[str, str], ...] = ()  # relationship id: direction

    @staticmethod
    def of(filters: dict[Column, Any] | None = None) -> Context:
        """From {(table, column): value, or a list or set of values}."""
        ctx = Context()
        for c, v in (filters or {}).items():
            ctx = ctx.keep(c, Filter(frozenset(v if isinstance(v, (list, set, tuple, frozenset)) else [v])))
        return ctx

    def filter_of(self, column: Column) -> Filter | None:
        return dict(self.filters).get(column)

    def _put(self, filters: dict) -> Context:
        return replace(self, filters=tuple(sorted(filters.items(), key=lambda x: x[0])))

    def keep(self, column: Column, f: Filter) -> Context:
        """Meets what the column's filter is already."""
        now = dict(self.filters)
        now[column] = now[column].meet(f) if column in now else f
        return self._put(now)

    def replaced(self, column: Column, f: Filter) -> Context:
        """The column's filter is f alone; selections about the column go."""
        return self.without_columns({column})._put({**dict(self.without_columns({column}).filters), column: f})

    def without_columns(self, columns: set[Column]) -> Context:
        ctx = self._put({c: f for c, f in self.filters if c not in columns})
        kept = []
        for t, found in self.selections:
            left = tuple(s for s in found if s.scope is None or not any((t, c) in columns for c in s.scope))
            kept += [(t, left)] if left else []
        return replace(ctx, selections=tuple(kept))

    def without_table(self, table: str) -> Context:
        ctx = self._put({c: f for c, f in self.filters if c[0] != table})
        return replace(ctx, selections=tuple((t, s) for t, s in self.selections if t != table))

    def cleared(self) -> Context:
        return replace(self, filters=(), selections=())

    def select(self, table: str, s: Selection, fresh: bool) -> Context:
        """Adds a selection; the first of a CALCULATE replaces the table's earlier ones, which its ambient rows hold."""
        now = dict(self.selections)
        now[table] = (s,) if fresh or table not in now else (*now[table], s)
        return replace(self, selections=tuple(sorted(now.items(), key=lambda x: x[0])))

    def merged(self, other: Context) -> Context:
        """Both contexts' filters; on one column, what both let through."""
        out = self
        for c, f in other.filters:
            out = out.keep(c, f)
        return out


EMPTY = Context()
