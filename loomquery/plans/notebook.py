"""A notebook: cells over one model that share a filter context, which slicers set."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from ..diagnostics import Diagnostic, EngineError, fail
from . import explain, visuals
from .measures import evaluate
from .model import Model
from .pipeline import described, fnv1a
from .validation import Subject, fingerprint
from .workspace import Workspace


@dataclass(frozen=True)
class Cell:
    """`kind`: measure (an expression), visual (a Visual), explain (an expression) or query (a query's name)."""

    kind: str
    content: Any


@dataclass
class Notebook:
    workspace: Workspace
    model_name: str
    cells: dict[str, Cell] = field(default_factory=dict)
    filters: dict[tuple[str, str], list] = field(default_factory=dict)

    def __post_init__(self):
        self._seen: dict[str, str] = {}

    @property
    def model(self) -> Model:
        return self.workspace.models[self.model_name]

    def add(self, name: str, cell: Cell) -> None:
        if name in self.cells:
            fail("INVALID_FUNCTION_ARGUMENT", f"there is a cell {name!r}")
        if cell.kind not in ("measure", "visual", "explain", "query"):
            fail("INVALID_FUNCTION_ARGUMENT", f"no kind of cell: {cell.kind!r}")
        self.cells[name] = cell

    def remove(self, name: str) -> None:
        self.cells.pop(name)

    def move(self, name: str, to: int) -> None:
        rest = [n for n in self.cells if n != name]
        order = [*rest[:to], name, *rest[to:]]
        self.cells = {n: self.cells[n] for n in order}

    def choose(self, column: tuple[str, str], values: list) -> None:
        """A slicer's selection: none chosen, none filtered."""
        at = self.model.column(*column)
        self.filters.pop(at, None)
        self.filters.update(visuals.slicer_filter(at, values))

    def clear(self) -> None:
        self.filters.clear()

    def problems(self, name: str) -> list[Diagnostic]:
        """What keeps a cell from being evaluated, found without running it."""
        cell = self.cells[name]
        try:
            if cell.kind == "visual":
                return visuals.preflight(self.model, cell.content)
            if cell.kind == "query":
                self.workspace.query_set("lazy").table(cell.content)
            else:
                evaluate(self.model, {"value": cell.content}, self.filters)
        except EngineError as e:
            return e.diagnostics
        return []

    def state(self, name: str) -> str:
        """Changes when the cell's result could: the model, the queries, the filters, the cell itself."""
        subject = Subject(self.model, self.workspace.query_set("lazy"))
        own = [described(self.cells[name].content), sorted((list(c), v) for c, v in self.filters.items())]
        return fnv1a(fingerprint(subject, []) + json.dumps(own, default=str))

    def stale(self, name: str) -> bool:
        """Whether the cell was never evaluated, or something that it depends on has changed since."""
        return self._seen.get(name) != self.state(name)

    def result(self, name: str) -> DataFrame | explain.Analysis:
        """The cell's plan under the notebook's filters; of an explanation, its outcome."""
        cell = self.cells[name]
        made = {
            "measure": lambda: evaluate(self.model, {"value": cell.content}, self.filters), "visual": lambda: visuals.run(self.model, cell.content, self.filters),
            "explain": lambda: explain.analyse(self.model, cell.content, self.filters), "query": lambda: self.workspace.query_set("lazy").table(cell.content),
        }[cell.kind]()
        self._seen[name] = self.state(name)
        return made
