"""Validation: rules about a model, its measures and its queries, each passed or not, with a score.

Rules name things as authors do (table and column names), not by internal ids: a table by its name, whatever the case, or by
{"name": ..., "source_key": ...}. A table that isn't there yet fails the rule; a name that fits several tables, or
a column that its table lacks, is an error of the rule's configuration. All cases of one measure rule
are evaluated together, as columns of one plan where their filters allow.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types as ty
from ..diagnostics import Diagnostic, EngineError, fail
from . import dax
from .context import Context
from .measures import Plan, calculated_column, checked
from .model import ONE_MANY, Model
from .pipeline import QuerySet, described, fnv1a


@dataclass(frozen=True)
class Tolerance:
    """Numbers are close if either bound that is set holds. The default values are fixed."""

    absolute: float | None = 0.01
    relative: float | None = 0.000001

    def close(self, expected: Any, got: Any) -> bool:
        number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
        if expected is None or got is None:
            return expected is None and got is None
        if number(expected) and number(got):
            off = abs(expected - got)
            return self.absolute is not None and off <= self.absolute or self.relative is not None and off <= self.relative * abs(expected)
        return type(expected) is type(got) and expected == got or str(expected) == str(got) and not number(got) and not isinstance(got, bool)


@dataclass(frozen=True)
class Rule:
    kind: str
    config: dict
    points: float = 1
    required: bool = False


@dataclass(frozen=True)
class Outcome:
    rule: Rule
    share: float  # of the points, 0 to 1
    message: str = ""
    config_error: bool = False

    @property
    def passed(self) -> bool:
        return self.share >= 1


@dataclass
class Subject:
    """What is validated."""

    model: Model | None = None
    queries: QuerySet | None = None


@dataclass
class Report:
    outcomes: list[Outcome] = field(default_factory=list)

    @property
    def score(self) -> float:
        return round(sum(o.rule.points * o.share for o in self.outcomes), 2)

    @property
    def possible(self) -> float:
        return round(sum(o.rule.points for o in self.outcomes), 2)

    @property
    def passed(self) -> bool:
        """All required rules; without any, all rules."""
        needed = [o for o in self.outcomes if o.rule.required] or self.outcomes
        return all(o.passed for o in needed)


def validate(subject: Subject, rules: list[Rule]) -> Report:
    out = Report()
    for r in rules:
        try:
            got = RULES[r.kind](subject, r.config) if r.kind in RULES else None
            if got is None:
                out.outcomes.append(Outcome(r, 0, f"there is no rule {r.kind}", True))
                continue
            share, message = got
            out.outcomes.append(Outcome(r, share, message))
        except ConfigError as e:
            out.outcomes.append(Outcome(r, 0, str(e), True))
        except (KeyError, TypeError) as e:
            out.outcomes.append(Outcome(r, 0, f"the rule's configuration lacks {e}", True))
        except EngineError as e:
            out.outcomes.append(Outcome(r, 0, str(e)))
    return out


def _yes(ok: bool, message: str) -> tuple[float, str]:
    return (1.0, "") if ok else (0.0, message)


class ConfigError(EngineError):
    """What a rule names can't be told."""


def target_table(m: Model, selector: str | dict) -> str:
    """The one table that a selector names."""
    name, key = (selector, None) if isinstance(selector, str) else (selector["name"], selector.get("source_key"))
    found = [t for t in m.tables if t.lower() == name.lower() and (key is None or m.source_keys.get(t) == key)]
    if not found:
        fail("VALIDATION_TARGET_NOT_FOUND", f"there is no table {name}" + (f" from {key}" if key else ""))
    if len(found) > 1:
        raise ConfigError(Diagnostic("VALIDATION_TARGET_AMBIGUOUS", f"several tables are named {name}: {', '.join(found)}"))
    return found[0]


def target_column(m: Model, end) -> tuple[str, str]:
    """The physical column that (table selector, name) stands for."""
    selector, name = end
    t = target_table(m, selector)
    found = [c for c in m.columns(t) if c.lower() == name.lower()]
    if len(found) != 1:
        code = "VALIDATION_TARGET_AMBIGUOUS" if found else "VALIDATION_TARGET_NOT_FOUND"
        raise ConfigError(Diagnostic(code, f"{t} has {len(found) or 'no'} columns named {name}"))
    return t, found[0]


def _relationship(s: Subject, c: dict):
    """A one-to-many relationship from its one side to its many side, active unless the rule says otherwise."""
    one, many = target_column(s.model, c["from"]), target_column(s.model, c["to"])
    kinds = [r for r in s.model.relationships if r.cardinality == c.get("cardinality", ONE_MANY)]
    found = [r for r in kinds if (r.left, r.right) == (one, many)]
    if found:
        want = c.get("active", True)
        return _yes(found[0].active == want, f"the relationship should be {'active' if want else 'inactive'}")
    if any((r.left, r.right) == (many, one) for r in kinds):
        return 0.0, "the relationship runs the wrong way"
    return 0.0, "the tables aren't related by these columns"


def _relationship_config(s: Subject, c: dict):
    want = {target_column(s.model, c["from"]), target_column(s.model, c["to"])}
    for r in s.model.relationships:
        if {r.left, r.right} == want:
            asked = {k: c[k] for k in ("cardinality", "direction", "active") if k in c}
            right = sum(getattr(r, k) == v for k, v in asked.items())
            return right / len(asked) if asked else 1.0, "" if right == len(asked) else "the relationship's settings differ"
    return 0.0, "the tables aren't related by these columns"


def _model_health(s: Subject, c: dict):
    bad = [d.code for d in s.model.findings() if d.severity == "error" or d.code in c.get("forbidden", [])]
    return _yes(not bad, "the model has findings: " + ", ".join(bad))


def _table_present(s: Subject, c: dict):
    return _yes(bool(target_table(s.model, c["table"])), "")


def _calculated(s: Subject, c: dict):
    """Cases: [{key: {column: value}, expected}], each found by its key; one job."""
    t, name = s.model.column(target_table(s.model, c["table"]), c["name"])
    if not s.model.is_calculated((t, name)):
        return 0.0, f"{t}[{name}] isn't calculated"
    df = calculated_column(s.model, t, s.model.calculated[t, name], "__value")
    tests = [functools.reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in case["key"].items()]) for case in c["cases"]]
    got = df.agg(*[F.first(F.when(x, F.struct("__value")), True).alias(f"v{i}") for i, x in enumerate(tests)]).first()
    return _cases(c["cases"], [None if got[f"v{i}"] is None else got[f"v{i}"][0] for i in range(len(tests))], c)


def _cases(cases: list[dict], got: list, c: dict) -> tuple[float, str]:
    near = c.get("tolerance", Tolerance())
    weights = [case.get("weight", 1) for case in cases]
    right = [near.close(case["expected"], g) for case, g in zip(cases, got, strict=True)]
    share = sum(w for w, ok in zip(weights, right, strict=True) if ok) / sum(weights)
    wrong = next((f"expected {case['expected']!r}, found {g!r}" for case, g, ok in zip(cases, got, right, strict=True) if not ok), "")
    constant = len(cases) > 1 and len({str(g) for g in got}) == 1 and len({str(case["expected"]) for case in cases}) > 1
    return round(share, 4), wrong + ("; the measure doesn't react to filters" if constant else "")


def _measure_result(s: Subject, c: dict):
    """Cases: [{filters: {(table, column): values}, expected, weight}]; one plan for all."""
    found = s.model.measure(c["measure"])
    if not found:
        return 0.0, f"there is no measure [{c['measure']}]"
    s.model.require_valid_graph()
    plan = Plan(s.model)
    values = {f"v{i}": plan.named(found[0], Context.of(checked(s.model, case.get("filters")))) for i, case in enumerate(c["cases"])}
    row = plan.result(None, values).df.first()
    return _cases(c["cases"], [row[f"v{i}"] for i in range(len(c["cases"]))], c)


def _semantics(s: Subject, c: dict):
    """All of: uses_function, references_measure, references_column, not_constant_only."""
    if "measure" in c:
        found = s.model.measure(c["measure"])
        text = found and found[1]
    else:
        text = s.model.calculated.get(s.model.column(c["table"], c["column"]))
    if not text:
        return 0.0, "there is no such expression"
    tree = dax.parse(text)
    refs = {((t or "").lower(), x.lower()) for t, x in dax.references(tree)}
    checks = []
    if "uses_function" in c:
        checks.append(c["uses_function"].upper() in dax.calls(tree))
    if "references_measure" in c:
        checks.append(("", c["references_measure"].lower()) in refs)
    if "references_column" in c:
        t, x = c["references_column"]
        checks.append((t.lower(), x.lower()) in refs or ("table" in c and ("", x.lower()) in refs))
    if c.get("not_constant_only"):
        checks.append(bool(refs) or any(isinstance(n, dax.Call) and n.name not in ("BLANK",) for n in dax.walk(tree)))
    return sum(checks) / len(checks) if checks else 1.0, "" if all(checks) else "the expression isn't written as asked"


def _date_table(s: Subject, c: dict):
    t, x = target_column(s.model, (c["table"], c["column"]))
    if s.model.date_tables.get(t) != x:
        return 0.0, f"{t} isn't marked as a date table by {x}"
    bad = s.model.check_date_table(t, x)
    return _yes(not bad, "; ".join(d.message for d in bad))


def _query_present(s: Subject, c: dict):
    return _yes(c["query"] in s.queries.queries, f"there is no query {c['query']}")


def _output(s: Subject, c: dict) -> DataFrame:
    return s.queries.evaluate(c["query"]).df()


def _with_query(rule: Callable) -> Callable:
    def run(s: Subject, c: dict):
        return rule(s, c) if c["query"] in s.queries.queries else (0.0, f"there is no query {c['query']}")

    return run


def _query_health(s: Subject, c: dict):
    e = s.queries.evaluate(c["query"])
    return _yes(e.status == "success", "; ".join(d.message for d in e.diagnostics))


def _query_schema(s: Subject, c: dict):
    """columns: {name: type}; exact: no others; ordered: in this order."""
    have = {f.name: ty.logical_type(f.dataType) for f in _output(s, c).schema.fields}
    want = c["columns"]
    right = [n in have and (t is None or have[n] == t) for n, t in want.items()]
    extra = c.get("exact") and set(have) != set(want) or c.get("ordered") and [n for n in have if n in want] != list(want)
    return sum(right) / len(right) * (not extra), "" if all(right) and not extra else f"the output has {have}"


def _query_rows(s: Subject, c: dict):
    n = _output(s, c).count()
    ok = n == c["equals"] if "equals" in c else c.get("min", 0) <= n <= c.get("max", n)
    return _yes(ok, f"the output has {n} rows")


def _query_value(s: Subject, c: dict):
    df = _output(s, c)
    test = functools.reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in c["key"].items()])
    row = df.filter(test).select(f"`{c['column']}`").first()
    if row is None:
        return 0.0, "no row has this key"
    return _yes(c.get("tolerance", Tolerance()).close(c["expected"], row[0]), f"expected {c['expected']!r}, found {row[0]!r}")


def _query_steps(s: Subject, c: dict):
    """uses: step classes' names that must occur, in this order if `ordered`."""
    have = [type(x).__name__ for x in s.queries.queries[c["query"]].steps]
    if c.get("ordered"):
        rest = iter(have)
        return _yes(all(any(h == w for h in rest) for w in c["uses"]), f"the steps are {have}")
    right = [w in have for w in c["uses"]]
    return sum(right) / len(right), "" if all(right) else f"the steps are {have}"


RULES: dict[str, Callable[[Subject, dict], tuple[float, str]]] = {
    "relationship": _relationship, "relationship-config": _relationship_config, "model-health": _model_health, "table-present": _table_present,
    "calculated-column-result": _calculated, "measure-result": _measure_result, "expression-semantics": _semantics, "date-table": _date_table,
    "query-present": _query_present, "query-health": _with_query(_query_health), "query-output-schema": _with_query(_query_schema),
    "query-output-row-count": _with_query(_query_rows), "query-output-value": _with_query(_query_value), "query-step-semantics": _with_query(_query_steps),
}


def fingerprint(subject: Subject, rules: list[Rule]) -> str:
    """Changes when a result could: schemas, relationships, expressions, queries, rules; not layout or data."""
    m = subject.model
    parts: list = [described(rules)]
    if m:
        parts += [[t, df.schema.json()] for t, df in m.tables.items()] + [described(m.relationships), sorted(m.measures.items()), sorted((list(k), v) for k, v in m.calculated.items()), sorted(m.date_tables.items())]
    if subject.queries:
        parts += [[n, subject.queries.fingerprint(n)] for n in sorted(subject.queries.queries)]
    return fnv1a(json.dumps(parts, sort_keys=True, default=str))
