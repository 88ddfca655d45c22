"""Queries: a source, then steps; queries may read each other. All of a query's steps are one lazy plan."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from ..diagnostics import Diagnostic, EngineError
from ..operators.frame import Frame
from ..operators.steps import AppendQueries, Context, MergeQueries, Step


@dataclass(frozen=True)
class Query:
    name: str
    source: str  # a table or another query
    steps: list[Step] = field(default_factory=list)
    load: bool = True  # whether models see the output; other queries always do

    def reads(self) -> list[str]:
        names = [self.source]
        for s in self.steps:
            names += [s.right] if isinstance(s, MergeQueries) else s.sources if isinstance(s, AppendQueries) else []
        return list(dict.fromkeys(names))

    # Edited definitions; a query itself never changes.
    def added(self, step: Step, at: int | None = None) -> Query:
        at = len(self.steps) if at is None else at
        return dataclasses.replace(self, steps=[*self.steps[:at], step, *self.steps[at:]])

    def removed(self, at: int) -> Query:
        return dataclasses.replace(self, steps=[*self.steps[:at], *self.steps[at + 1 :]])

    def updated(self, at: int, step: Step) -> Query:
        return self.removed(at).added(step, at)

    def moved(self, at: int, to: int) -> Query:
        return self.removed(at).added(self.steps[at], to)

    def renamed(self, name: str) -> Query:
        return dataclasses.replace(self, name=name)


@dataclass
class StepResult:
    step: Step
    status: str  # success, error, skipped
    diagnostics: list[Diagnostic] = field(default_factory=list)


@dataclass
class Evaluation:
    """The plan of a query, or of its steps up to the first that fails; then `status` is error."""

    query: Query
    status: str
    frame: Frame | None
    steps: list[StepResult]
    diagnostics: list[Diagnostic]
    fingerprint: str

    def df(self) -> DataFrame:
        if self.frame is None:
            raise EngineError(*self.diagnostics)
        return self.frame.out()

    def row_counts(self) -> int:
        """An action: how many rows the output has."""
        return self.df().count()


def fnv1a(text: str) -> str:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, in hex."""
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 % 2**32
    return f"{h:08x}"


def described(value: Any) -> Any:
    if dataclasses.is_dataclass(value):
        return {"kind": type(value).__name__, **{f.name: described(getattr(value, f.name)) for f in dataclasses.fields(value)}}
    if isinstance(value, dict):
        return [[k, described(v)] for k, v in value.items()]
    if isinstance(value, (list, tuple)):
        return [described(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def run_steps(frame: Frame, steps: list[Step], ctx: Context, upto: int | None = None) -> tuple[Frame, list[StepResult]]:
    """Folds the steps over a frame; a step that fails ends it, and the frame before it is what there is."""
    if any(s.needs_order for s in steps):
        frame = frame.ordered()
    results: list[StepResult] = []
    for s in steps[: None if upto is None else upto + 1]:
        if results and results[-1].status != "success":
            results.append(StepResult(s, "skipped"))
            continue
        try:
            frame = s.apply(frame, ctx)
            results.append(StepResult(s, "success"))
        except EngineError as e:
            results.append(StepResult(s, "error", e.diagnostics))
        except PySparkException as e:
            results.append(StepResult(s, "error", [Diagnostic("QUERY_STEP_FAILED", str(e).splitlines()[0])]))
    return frame, results


class QuerySet:
    """Named queries over named tables."""

    def __init__(self, tables: dict[str, DataFrame], queries: list[Query], check: str = "eager"):
        self.tables, self.check = tables, check
        self.queries = {q.name: q for q in queries}
        self._done: dict[str, Evaluation] = {}

    def order(self) -> list[str]:
        """Queries after what they read. Missing sources and cycles leave their queries out: see `problems`."""
        return [n for n in self._walk()[0]]

    def problems(self) -> dict[str, Diagnostic]:
        return self._walk()[1]

    def _walk(self) -> tuple[list[str], dict[str, Diagnostic]]:
        done: list[str] = []
        bad: dict[str, Diagnostic] = {}

        def visit(name: str, path: tuple[str, ...]) -> None:
            if name in done or name in bad or name in self.tables and name not in self.queries:
                return
            if name in path:
                for n in path[path.index(name) :]:
                    bad[n] = Diagnostic("QUERY_DEPENDENCY_CYCLE", "queries read each other: " + " -> ".join([*path[path.index(name) :], name]))
                return
            for r in self.queries[name].reads():
                if r not in self.queries and r not in self.tables:
                    code = "QUERY_SOURCE_NOT_FOUND" if r == self.queries[name].source else "QUERY_DEPENDENCY_NOT_FOUND"
                    bad[name] = Diagnostic(code, f"query {name!r} reads {r!r}, which isn't there")
                elif r in self.queries:
                    visit(r, (*path, name))
                    if r in bad and name not in bad:
                        bad[name] = Diagnostic("QUERY_DEPENDENCY_NOT_FOUND", f"query {name!r} reads {r!r}, which can't be evaluated")
            if name not in bad:
                done.append(name)

        for q in self.queries:
            visit(q, ())
        return done, bad

    def _needs_order(self, name: str) -> bool:
        """Whether this query's output must come with its row order."""
        if any(s.needs_order for s in self.queries[name].steps) if name in self.queries else False:
            return True
        return any(name in q.reads() and self._needs_order(q.name) for q in self.queries.values() if q.name != name)

    def frame(self, name: str) -> Frame:
        if name in self.queries:
            e = self.evaluate(name)
            if e.frame is None:
                raise EngineError(*e.diagnostics)
            return e.frame
        return Frame.of(self.tables[name], self._needs_order(name))

    def evaluate(self, name: str, upto: int | None = None) -> Evaluation:
        """A query's plan, or the plan of its steps up to number `upto`."""
        if upto is None and name in self._done:
            return self._done[name]
        q = self.queries[name]
        problem = self.problems().get(name)
        if problem:
            return Evaluation(q, "error", None, [StepResult(s, "skipped") for s in q.steps], [problem], "")
        ctx = Context({r: self.frame(r) for r in q.reads()}, self.check)
        frame, steps = run_steps(self.frame(q.source), q.steps, ctx, upto)
        found = [d for s in steps for d in s.diagnostics]
        out = Evaluation(q, "error" if found else "success", frame, steps, found, self.fingerprint(name))
        if upto is None:
            self._done[name] = out
        return out

    def fingerprint(self, name: str) -> str:
        """Changes just when the query's meaning does: its steps, its source's shape, what it reads; names don't count."""
        if name not in self.queries:
            return fnv1a(self.tables[name].schema.json()) if name in self.tables else ""
        q = self.queries[name]
        reads = [self.fingerprint(r) for r in q.reads() if r != name]
        return fnv1a(json.dumps([described(s) for s in q.steps] + reads, sort_keys=True, default=str))

    def table(self, name: str) -> DataFrame:
        """What a model gets under a name; an error for a query that isn't loaded."""
        if name in self.queries and not self.queries[name].load:
            raise EngineError(Diagnostic("QUERY_NOT_LOADED", f"query {name!r} isn't loaded"))
        if name not in self.queries and name not in self.tables:
            raise EngineError(Diagnostic("QUERY_SOURCE_NOT_FOUND", f"there is no query or table {name!r}"))
        return self.evaluate(name).df() if name in self.queries else self.tables[name]

    def loaded(self) -> dict[str, DataFrame]:
        """The tables that a model may use: outputs of the queries that are loaded, and the plain tables."""
        return {**self.tables, **{n: self.evaluate(n).df() for n in self.order() if self.queries[n].load}}
