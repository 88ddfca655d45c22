"""A workspace: tables, queries and models together, what a change would break, its definition as JSON, and a bundle of
the definition and the raw tables."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..diagnostics import fail
from ..operators import steps as st
from . import dax
from .model import Model, Relationship
from .pipeline import Query, QuerySet

FORMAT, VERSION = "loomquery-workspace", 1
#: How a definition of an older version becomes one of the next: {version: function}.
MIGRATIONS: dict = {}


@dataclass(frozen=True)
class Impact:
    """What deleting something does: `cascade` takes its dependents along, `restrict` refuses while it has any."""

    policy: str
    dependents: list[str]

    @property
    def allowed(self) -> bool:
        return self.policy == "cascade" or not self.dependents


@dataclass
class Workspace:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    queries: dict[str, Query] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    #: Where tables come from, for the definition: {table: {"format": ..., "path": ...}}.
    sources: dict[str, dict] = field(default_factory=dict)

    def query_set(self, check: str = "eager") -> QuerySet:
        return QuerySet(self.tables, list(self.queries.values()), check)

    # What would break.
    def impact(self, kind: str, name: str, model: str | None = None) -> Impact:
        """Of deleting a dataset, query, model, model-table, measure or calculated-column, or of disable-load of a query."""
        if kind in ("dataset", "query", "disable-load"):
            readers = [q.name for q in self.queries.values() if name in q.reads() and q.name != name] if kind != "disable-load" else []
            users = [m for m, x in self.models.items() if name in x.tables]
            return Impact("restrict", [f"query {q}" for q in readers] + [f"model {m}" for m in users])
        if kind == "model":
            return Impact("cascade", [f"measure {m}" for m in self.models[name].measures])
        m = self.models[model]
        if kind == "model-table":
            found = [f"relationship {r.id}" for r in m.relationships if name in (r.left[0], r.right[0])]
            return Impact("cascade", found + [f"measure {x}" for x, text in m.measures.items() if self._reads_table(text, name)])
        if kind == "measure":
            return Impact("restrict", [f"measure {x}" for x, text in m.measures.items() if x != name and (None, name.lower()) in {(t, c.lower()) for t, c in dax.references(dax.parse(text))}])
        if kind == "calculated-column":
            return Impact("restrict", column_dependents(m, *name.split(".", 1)))
        return fail("INVALID_FUNCTION_ARGUMENT", f"nothing is known of deleting a {kind}")

    @staticmethod
    def _reads_table(text: str, table: str) -> bool:
        return any(isinstance(n, dax.Ref) and n.table and n.table.lower() == table.lower() for n in dax.walk(dax.parse(text)))

    def delete(self, kind: str, name: str, model: str | None = None) -> Impact:
        """Deletes if the policy allows it; else an error names the dependents."""
        i = self.impact(kind, name, model)
        if not i.allowed:
            fail("MISSING_REFERENCE", f"{name} is used by " + ", ".join(i.dependents), dependents=i.dependents)
        if kind == "dataset":
            self.tables.pop(name)
        elif kind == "query":
            self.queries.pop(name)
        elif kind == "disable-load":
            self.queries[name] = dataclasses.replace(self.queries[name], load=False)
        elif kind == "model":
            self.models.pop(name)
        elif kind == "measure":
            self.models[model].measures.pop(name)
        elif kind == "calculated-column":
            t, c = name.split(".", 1)
            self.models[model].calculated.pop((t, c))
        else:
            m = self.models[model]
            m.tables.pop(name)
            m.relationships[:] = [r for r in m.relationships if name not in (r.left[0], r.right[0])]
            for x in [x for x, text in m.measures.items() if self._reads_table(text, name)]:
                m.measures.pop(x)
            m.date_tables.pop(name, None)
            for k in [k for k in m.calculated if k[0] == name]:
                m.calculated.pop(k)
            m.__post_init__()
        return i

    def dangling(self) -> list[str]:
        """References to things that aren't there."""
        out = [f"query {n}: {d.message}" for n, d in self.query_set().problems().items()]
        for name, m in self.models.items():
            for r in m.relationships:
                out += [f"model {name}: relationship {r.id} names {t}[{c}]" for t, c in (r.left, r.right) if t not in m.tables or c not in m.columns(t)]
            for x, text in m.measures.items():
                for t, c in dax.references(dax.parse(text)):
                    known = m.measure(c) if t is None else any(k.lower() == t.lower() and (c.lower() in {y.lower() for y in m.columns(k)} or any(ct == k and cc.lower() == c.lower() for ct, cc in m.calculated)) for k in m.tables)
                    if not known:
                        out.append(f"model {name}: measure {x} names {t or ''}[{c}]")
        return out

    # Definitions.
    def export(self) -> str:
        """The workspace as JSON: definitions and where tables come from; query outputs are derived again."""
        model = lambda m: {"tables": list(m.tables), "relationships": [dataclasses.asdict(r) for r in m.relationships], "measures": m.measures, "calculated": [[*k, v] for k, v in m.calculated.items()], "date_tables": m.date_tables, "keys": m.keys, "source_keys": m.source_keys}
        query = lambda q: {"source": q.source, "load": q.load, "steps": [{"kind": kind_of(s), **dataclasses.asdict(s)} for s in q.steps]}
        return json.dumps({"format": FORMAT, "version": VERSION, "sources": self.sources, "queries": {n: query(q) for n, q in self.queries.items()}, "models": {n: model(m) for n, m in self.models.items()}}, default=str)

    @staticmethod
    def load(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> Workspace:
        """A workspace from its JSON; tables come from `tables` or from their sources."""
        data = definition_of(text)
        ws = Workspace(dict(tables or {}), sources=data["sources"])
        for n, s in data["sources"].items():
            if n not in ws.tables:
                ws.tables[n] = spark.read.format(s["format"]).options(**s.get("options", {})).load(s["path"])
        for n, q in data["queries"].items():
            ws.queries[n] = Query(n, q["source"], [step_of(s) for s in q["steps"]], q["load"])
        loaded = ws.query_set("lazy")
        for n, m in data["models"].items():
            frames = {t: loaded.table(t) for t in m["tables"]}
            relations = [Relationship(**{**r, "left": tuple(r["left"]), "right": tuple(r["right"])}) for r in m["relationships"]]
            ws.models[n] = Model(frames, relations, m["measures"], {(t, c): v for t, c, v in m["calculated"]}, m["date_tables"], m["keys"], m["source_keys"])
        broken = ws.dangling()
        if broken:
            fail("integrity-violation", "; ".join(broken), issues=broken)
        return ws

    # Bundles.
    def export_bundle(self, path: str) -> None:
        """The definition and the raw tables, as Parquet, at a path that driver and executors share; queries' outputs are left
        out and derived again when the bundle is opened."""
        path = path.rstrip("/")
        raw = {n: df for n, df in self.tables.items() if n not in self.queries}
        for i, df in enumerate(raw.values()):
            df.write.parquet(f"{path}/data/{i}")
        own = dataclasses.replace(self, sources={n: {"format": "parquet", "path": f"data/{i}"} for i, n in enumerate(raw)})
        spark = next(iter(raw.values())).sparkSession if raw else SparkSession.active()
        spark.createDataFrame([(own.export(),)], "value string").coalesce(1).write.text(f"{path}/definition")

    @staticmethod
    def open_bundle(spark: SparkSession, path: str) -> Workspace:
        path = path.rstrip("/")
        text = spark.read.option("wholetext", True).text(f"{path}/definition").first()[0]
        data = definition_of(text)
        tables = {n: spark.read.format(s["format"]).load(f"{path}/{s['path']}") for n, s in data["sources"].items()}
        return Workspace.load(spark, text, tables)


def definition_of(text: str) -> dict:
    """A workspace's JSON, checked and brought to this version."""
    try:
        data = json.loads(text)
    except ValueError:
        return fail("invalid-json", "this is no JSON")
    if not isinstance(data, dict) or data.get("format") != FORMAT:
        fail("not-a-project", "this is no workspace")
    if not isinstance(data.get("version"), int) or not all(isinstance(data.get(k), dict) for k in ("sources", "queries", "models")):
        fail("structurally-invalid", "the workspace is damaged or incomplete")
    while data["version"] in MIGRATIONS:
        data = MIGRATIONS[data["version"]](data)
    if data["version"] != VERSION:
        fail("unsupported-schema-version", f"version {data['version']} can't be read, only {VERSION}", found=data["version"])
    return data


def column_dependents(m: Model, table: str, column: str) -> list[str]:
    """The measures and calculated columns whose expressions read a column."""
    reads = lambda text, home: any((t or home or "").lower() == table.lower() and c.lower() == column.lower() for t, c in dax.references(dax.parse(text)))
    return [f"measure {x}" for x, text in m.measures.items() if reads(text, None)] + [f"calculated column {t}[{c}]" for (t, c), text in m.calculated.items() if (t, c) != (table, column) and reads(text, t)]


def kind_of(step: st.Step) -> str:
    return next(k for k, cls in st.KINDS.items() if type(step) is cls)


def step_of(data: dict) -> st.Step:
    """A step from its JSON form."""
    data = dict(data)
    cls = st.KINDS[data.pop("kind")]
    condition = lambda c: st.Condition(**c)
    if cls is st.FilterRows:
        data["conditions"] = [condition(c) for c in data["conditions"]]
    if cls is st.ConditionalColumn:
        data["clauses"] = [(condition(c), v) for c, v in data["clauses"]]
    if cls is st.GroupBy:
        data["aggregations"] = [st.Aggregation(**a) for a in data["aggregations"]]
    for k in ("names", "ids", "attribute", "value"):
        if isinstance(data.get(k), list):
            data[k] = tuple(data[k])
    for k in ("replacements", "keys", "expand"):
        if k in data:
            data[k] = [tuple(x) for x in data[k]]
    return cls(**data)
