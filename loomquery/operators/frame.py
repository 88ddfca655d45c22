"""Frame: a lazy DataFrame with stable column ids and, where a step needs it, a row order.

Steps refer to columns by id, so renaming a column never breaks a later step. Row order lives in hidden
columns, which are added only when some step depends on order: they would otherwise keep filters from reaching
the scan. Catalyst prunes hidden columns that nothing reads.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import fail


@dataclass(frozen=True)
class Col:
    id: str
    name: str
    dtype: str


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    cols: tuple[Col, ...]
    #: Hidden columns by which rows are ordered, with their direction; earlier ones weigh more.
    order: tuple[tuple[str, bool], ...] = ()

    @staticmethod
    def of(df: DataFrame, ordered: bool = False) -> Frame:
        """A frame over a DataFrame; column ids are the first names."""
        cols = tuple(Col(f.name, f.name, ty.logical_type(f.dataType)) for f in df.schema.fields)
        frame = Frame(df.select(*[F.col(quoted(c.name)).alias(hidden(c.id)) for c in cols]), cols)
        return frame.ordered() if ordered else frame

    def find(self, column_id: str, code: str = "QUERY_COLUMN_NOT_FOUND") -> Col:
        for c in self.cols:
            if c.id == column_id:
                return c
        return fail(code, f"there is no column {column_id!r}", column=column_id)

    def col(self, column_id: str) -> Column:
        return F.col(quoted(hidden(self.find(column_id).id)))

    def ordered(self) -> Frame:
        """The frame with an order: that of the rows as they are read, unless it has one."""
        if self.order:
            return self
        return replace(self, df=self.df.withColumn("__row", F.monotonically_increasing_id()), order=(("__row", True),))

    def sort_keys(self, flip: bool = False) -> list[Column]:
        return [F.col(n).asc_nulls_first() if up != flip else F.col(n).desc_nulls_last() for n, up in self.order]

    def with_columns(self, new: dict[str, tuple[str, str, Column]], drop: set[str] = frozenset()) -> Frame:
        """Columns added at the end: {id: (name, type, value)}."""
        taken = {c.name.lower() for c in self.cols if c.id not in drop}
        for name, _, _ in new.values():
            if not name.strip():
                fail("QUERY_INVALID_STEP_CONFIG", "a column needs a name")
            if name.lower() in taken:
                fail("QUERY_DUPLICATE_COLUMN_NAME", f"a column is named {name!r} already", name=name)
            taken.add(name.lower())
        cols = tuple(c for c in self.cols if c.id not in drop) + tuple(Col(i, n, t) for i, (n, t, _) in new.items())
        df = self.df.withColumns({hidden(i): v for i, (_, _, v) in new.items()})
        return replace(self, df=df, cols=cols)

    def out(self) -> DataFrame:
        """The visible columns under their names."""
        return self.df.select(*[F.col(quoted(hidden(c.id))).alias(c.name) for c in self.cols])

    def sorted_out(self) -> DataFrame:
        """As `out`, in row order if the frame has one."""
        df = self.df.orderBy(*self.sort_keys()) if self.order else self.df
        return df.select(*[F.col(quoted(hidden(c.id))).alias(c.name) for c in self.cols])


def hidden(column_id: str) -> str:
    """The name under which a frame holds a column: ids never clash with names or order columns."""
    return f"c:{column_id}"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
