"""Sources, profiles, visuals, the explainer, validation, workspaces and streams."""

from __future__ import annotations

import pytest

from helpers import SHEET, workbook_bytes
from loomquery import sources
from loomquery.sources import samples
from loomquery.diagnostics import EngineError
from loomquery.operators import steps as s
from loomquery.plans import explain, visuals
from loomquery.plans.model import Model, Relationship
from loomquery.plans.notebook import Cell, Notebook
from loomquery.plans.pipeline import Query
from loomquery.plans.validation import Rule, Subject, Tolerance, fingerprint, validate
from loomquery.plans.workspace import Workspace
from loomquery.streaming import stream_steps


@pytest.fixture
def model(spark):
    c = spark.createDataFrame([(1, "Spain"), (2, "France"), (3, None)], "id long, land string")
    o = spark.createDataFrame([(1, 10.0), (1, 5.0), (2, 1.0), (9, 4.0)], "id long, v double")
    return Model({"c": c, "o": o}, [Relationship(("c", "id"), ("o", "id"))], {"Total": "SUM(o[v])", "Rows": "COUNTROWS(o)", "Kind": '"x"'})


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('name, n ,n,when,,mixed\n"a ""q"", b",1,2.5,2024-01-05,true,1\n,,,,,\nx,2,3,2024-01-06,false,z\n')
    got = sources.read_csv(spark, str(path))
    assert got.types == {"name": "string", "n": "integer", "n_2": "decimal", "when": "date", "Column5": "boolean", "mixed": "string"}
    rows = [tuple(map(str, r)) for r in got.df.collect()]
    assert rows == [('a "q", b', "1", "2.5", "2024-01-05", "True", "1"), ("x", "2", "3.0", "2024-01-06", "False", "z")]


def test_a_late_misfit_keeps_text(spark):
    data = [(str(i),) for i in range(500)] + [("oops",)]
    got = sources.from_rows(spark, ["n"], data)
    assert got.types == {"n": "string"} and got.diagnostics[0].details["count"] == 1
    with pytest.raises(EngineError, match="QUERY_ROW_LIMIT_EXCEEDED"):
        sources.typed(spark.createDataFrame(data, "n string"), max_rows=10)


def test_types_come_from_all_rows(spark):
    rows = [(str(i), "2024-01-05", "x" if i % 3 else "1", None, "9" * 30) for i in range(900)] + [("2.5", "2024-02-31", "2", "null", "1.5")]
    got = sources.typed(spark.createDataFrame(rows, "n string, d string, m string, e string, w string").repartition(7))
    assert got.types == {"n": "decimal", "d": "string", "m": "string", "e": "null", "w": "decimal"}
    assert [(x.details["column"], x.details["type"], x.details["count"]) for x in got.diagnostics] == [("d", "date", 1)]


def test_only_files_with_quoted_line_feeds_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""q"" y"\n2,z\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"two\nlines"\n2,z\n')
    found = [sources.has_quoted_line_feeds(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv")]
    assert found == [False, True]
    assert [r["b"] for r in sources.read_csv(spark, str(tmp_path / "b.csv")).df.collect()] == ["two\nlines", "z"]


def test_a_pivot_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(s, "MOST_PIVOTED", 2)
    from loomquery.plans.pipeline import QuerySet

    rows = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0)], "k long, p string, v double")
    found = QuerySet({"t": rows}, [Query("q", "t", [s.PivotColumn("p", "p", "v", "sum")])]).evaluate("q")
    assert [d.code for d in found.diagnostics] == ["QUERY_COLUMN_LIMIT_EXCEEDED"]


def test_headers():
    assert sources.header(["a", " a ", "", None, "A"]) == ["a", "a_2", "Column3", "Column4", "A_3"]


def test_spreadsheets(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    path.write_bytes(workbook_bytes({"People": SHEET, "Empty": []}))
    assert sources.sheets(spark, str(path)) == ["People", "Empty"]
    got = sources.read_sheet(spark, str(path), "People")
    assert got.types == {"Name": "string", "Count": "integer", "Column3": "null", "Day": "date", "At": "datetime", "Yes": "boolean", "Share": "decimal"}
    assert [tuple(map(str, r)) for r in got.df.collect()] == [("Anna", "12", "None", "2024-01-05", "2024-01-05 12:00:00", "True", "0.5"), ('Bo, "B"', "1000", "None", "2024-01-06", "2024-01-06 06:00:00", "False", "None")]
    for sheet, code in (("Nope", "QUERY_SOURCE_NOT_FOUND"), ("Empty", "QUERY_NO_COLUMNS")):
        with pytest.raises(EngineError, match=code):
            sources.read_sheet(spark, str(path), sheet)
    path.write_text("no workbook")
    with pytest.raises(EngineError, match="unsupported-file-type"):
        sources.sheets(spark, str(path))


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 1.5), (3, "ccc", 1.5)], "k long, t string, d double")
    rows = {r["column"]: r for r in sources.profile(df).collect()}
    assert rows["k"]["is_potential_key"] and not rows["d"]["is_potential_key"]
    assert (rows["t"]["null_percent"], rows["t"]["distinct_count"], rows["t"]["min_length"], rows["t"]["max_length"]) == (33.33, 2, 1, 3)
    assert (rows["d"]["mean"], rows["k"]["min"], rows["k"]["max"]) == (1.17, "1", "3")
    assert sources.profile(df.limit(0)).filter("column = 'k'").first()["null_percent"] == 0.0


def test_visuals(model):
    rows = lambda v, f=None: [tuple(r) for r in visuals.run(model, v, f).collect()]
    assert rows(visuals.Visual("bar", ("Total",), ("c", "land"))) == [("Spain", 15.0), ("France", 1.0), (None, None)]
    assert rows(visuals.Visual("bar", ("Total",), ("c", "land"), "value-asc", 2)) == [("France", 1.0), ("Spain", 15.0)]
    assert rows(visuals.Visual("bar", ("Total",), ("c", "land"), "category-desc")) == [("Spain", 15.0), ("France", 1.0), (None, None)]
    assert rows(visuals.Visual("table", ("Total", "Rows"), ("c", "land"))) == [("Spain", 15.0, 2), ("France", 1.0, 1), (None, None, 0)]
    assert rows(visuals.Visual("kpi", ("Total",)), {("c", "land"): "France"}) == [(1.0,)]
    assert rows(visuals.Visual("table", ("Total", "Kind"))) == [("Total", 20.0, "20.0"), ("Kind", None, "x")]
    assert rows(visuals.Visual("slicer", (), ("c", "land"))) == [("France",), ("Spain",), (None,)]
    assert [d.code for d in visuals.preflight(model, visuals.Visual("bar", ("Kind",), ("c", "land")))] == ["TYPE_MISMATCH"]
    assert [d.code for d in visuals.preflight(model, visuals.Visual("kpi", ("Nope",)))] == ["UNKNOWN_MEASURE"]
    assert visuals.truncated(model, visuals.Visual("table", ("Total",), ("c", "land"), limit=2)).details == {"members": 3, "shown": 2}
    assert visuals.slicer_filter(("c", "land"), []) == {}


def test_explainer(model):
    a = explain.analyse(model, "[Total]", {("c", "land"): "France"})
    assert (a.comparison.baseline, a.comparison.value, a.comparison.absolute, a.comparison.relative) == (20, 1, -19, -0.95)
    assert [(t.table, t.total, t.visible, t.state) for t in a.tables] == [("c", 3, 1, "direct"), ("o", 4, 1, "propagated")]
    assert a.relationships == {"c[id]-o[id]": "carries"}
    assert a.narrative()[-1] == "The measure goes from 20 to 1: -19 (-95.0 %)."
    assert explain.Comparison(0, 5).relative is None
    assert explain.tree("1 + SUM(o[v])")["operands"][1] == {"call": "SUM", "arguments": [{"reference": "o[v]"}]}


def test_validation(spark, model):
    model.add_column("o", "Double", "o[v] * 2")
    from loomquery.plans.pipeline import QuerySet

    queries = QuerySet({"o": model.tables["o"]}, [Query("big", "o", [s.FilterRows([s.Condition("v", "greater-than", 3)]), s.RemoveDuplicates()])])
    rules = [
        Rule("relationship", {"from": ("c", "id"), "to": ("o", "id")}, required=True), Rule("relationship-config", {"from": ("o", "id"), "to": ("c", "id"), "direction": "both", "active": True}, 2), Rule("model-health", {}), Rule("table-present", {"table": "C"}),
        Rule("calculated-column-result", {"table": "o", "name": "Double", "cases": [{"key": {"v": 5.0}, "expected": 10}, {"key": {"v": 1.0}, "expected": 3}]}),
        Rule("measure-result", {"measure": "total", "cases": [{"expected": 20}, {"filters": {("c", "land"): "Spain"}, "expected": 15.001, "weight": 3}, {"filters": {("c", "land"): None}, "expected": None}]}),
        Rule("expression-semantics", {"measure": "Total", "uses_function": "sum", "references_column": ("o", "v"), "not_constant_only": True}), Rule("expression-semantics", {"measure": "Kind", "not_constant_only": True}), Rule("date-table", {"table": "c", "column": "land"}),
        Rule("query-present", {"query": "big"}), Rule("query-health", {"query": "big"}), Rule("query-output-schema", {"query": "big", "columns": {"id": "integer", "v": "decimal"}, "exact": True}), Rule("query-output-row-count", {"query": "big", "min": 3, "max": 3}),
        Rule("query-output-value", {"query": "big", "key": {"id": 9}, "column": "v", "expected": 4}), Rule("query-step-semantics", {"query": "big", "uses": ["FilterRows", "RemoveDuplicates"], "ordered": True}), Rule("nothing", {}), Rule("query-health", {}),
    ]
    report = validate(Subject(model, queries), rules)
    assert [o.share for o in report.outcomes] == [1, 0.5, 1, 1, 0.5, 1, 1, 0, 0, 1, 1, 1, 1, 1, 1, 0, 0]
    assert [o.config_error for o in report.outcomes][-2:] == [True, True]
    assert report.passed and report.score == 12.5 and report.possible == 18
    before = fingerprint(Subject(model, queries), rules)
    model.add_measure("More", "[Total] + 1")
    assert fingerprint(Subject(model, queries), rules) != before
    assert Tolerance().close(None, None) and not Tolerance().close(None, 0) and Tolerance(None, 0.1).close(100, 109) and not Tolerance(0.1, None).close(1, 1.2)


def test_notebook(spark, model):
    ws = Workspace({"o": model.tables["o"]}, {"q": Query("q", "o", [s.FilterRows([s.Condition("v", "greater-than", 3)])]), "hidden": Query("hidden", "o", load=False)}, {"m": model})
    book = Notebook(ws, "m")
    for n, cell in {"total": Cell("measure", "[Total]"), "bar": Cell("visual", visuals.Visual("bar", ("Total",), ("c", "land"))), "why": Cell("explain", "[Total]"), "rows": Cell("query", "q"), "bad": Cell("measure", "[Nope]"), "gone": Cell("query", "hidden")}.items():
        book.add(n, cell)
    assert book.stale("total") and book.result("total").first()["value"] == 20 and not book.stale("total")
    book.choose(("C", "LAND"), ["France"])
    assert book.stale("total") and book.result("total").first()["value"] == 1 and book.result("why").comparison.value == 1
    assert [tuple(r) for r in book.result("bar").collect()] == [("France", 1.0), ("Spain", None), (None, None)] and book.result("rows").count() == 3
    assert [d.code for n in ("total", "bar", "bad", "gone") for d in book.problems(n)] == ["UNKNOWN_MEASURE", "QUERY_NOT_LOADED"]
    book.choose(("c", "land"), [])
    assert book.filters == {} and book.stale("total")
    book.result("total")
    model.add_measure("Other", "1")
    assert book.stale("total")
    book.move("rows", 0)
    book.remove("bad")
    assert list(book.cells) == ["rows", "total", "bar", "why", "gone"]
    for cell in (("total", Cell("measure", "1")), ("x", Cell("nothing", 1))):
        with pytest.raises(EngineError):
            book.add(*cell)


def test_workspace(spark, model, tmp_path):
    path = str(tmp_path / "o")
    sources.write(model.tables["o"], path)
    steps = [s.FilterRows([s.Condition("v", "greater-than", 3)]), s.GroupBy(["id"], [s.Aggregation("n", "n", "count-rows")]), s.SplitColumn("id", "-", ("a", "b"), ("a", "b")), s.ConditionalColumn("x", "x", [(s.Condition("n", "equals", 1), "one")], "more")]
    ws = Workspace({"o": spark.read.parquet(path)}, {"q": Query("q", "o", steps)}, {}, {"o": {"format": "parquet", "path": path}})
    ws.models["m"] = Model({"o": ws.tables["o"], "q": ws.query_set().evaluate("q").df()}, [], {"Total": "SUM(o[v])", "Twice": "[Total] * 2", "N": "SUM(q[n])"})
    again = Workspace.load(spark, ws.export())
    assert [tuple(r) for r in again.query_set().evaluate("q").df().orderBy("id").collect()] == [(1, 2, "1", None, "more"), (9, 1, "9", None, "one")]
    assert again.models["m"].measures == ws.models["m"].measures and again.dangling() == []
    assert ws.impact("dataset", "o").dependents == ["query q", "model m"] and not ws.impact("query", "q").allowed
    with pytest.raises(EngineError):
        ws.delete("measure", "Total", "m")
    ws.delete("measure", "Twice", "m")
    ws.delete("measure", "Total", "m")
    ws.delete("model-table", "q", "m")
    assert ws.models["m"].measures == {}
    ws.delete("query", "q")
    ws.delete("model", "m")
    ws.delete("dataset", "o")
    assert not ws.tables and not ws.queries


def test_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "k long, t string").write.parquet(source)
    stream = spark.readStream.schema("k long, t string").parquet(source)
    chain = [s.FilterRows([s.Condition("t", "equals", "a")]), s.CustomColumn("x", "x", "[k] * 10")]
    query = stream_steps(stream, chain).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(sink).collect()) == [(1, "a", 10), (3, "a", 30)]
    with pytest.raises(EngineError):
        stream_steps(stream, [s.SortRows([("k", "asc")])])


def test_samples(spark):
    t = samples.retail(spark, 2000)
    model = Model(t, [], {"Revenue": "SUM(Sales[Revenue])"})
    for r in (Relationship(("Customers", "CustomerID"), ("Sales", "CustomerID")), Relationship(("Products", "ProductID"), ("Sales", "ProductID")), Relationship(("Calendar", "Date"), ("Sales", "Date"))):
        assert model.add_relationship(r) == []
    model.mark_date_table("Calendar", "Date")
    assert t["Sales"].count() == 2000 and model.roles()["Sales"] == "fact"
    lab = samples.relationship_lab(spark)
    assert Model(lab).check_relationship(Relationship(("Customers", "CustomerID"), ("CustomerProfile", "CustomerID"), "one-to-one", "both"))[0].code == "ONE_TO_ONE_COVERAGE"
    assert lab["Targets"].count() == 12 and lab["Targets"].distinct().count() == 12


def test_preparation_of_untidy_tables(spark):
    """Trim, drop repeated rows and blank keys, append two months, join, group, unpivot."""
    from loomquery.plans.pipeline import QuerySet

    clean = Query("clean", "Customers_Dirty", [s.RemoveColumns(["LegacyNotes"]), s.FilterRows([s.Condition("customer_id", "is-not-blank")]), s.RemoveDuplicates(), s.ChangeType({"customer_id": "integer"}), s.CustomColumn("land", "Land", "Text.Trim([Country])")])
    months = Query("months", "Sales_Jan", [s.AppendQueries(["Sales_Feb"])])
    joined = Query("joined", "months").added(s.MergeQueries("clean", "inner", ["CustomerID"], ["customer_id"], [("land", "land", "Land")])).added(s.GroupBy(["land"], [s.Aggregation("n", "n", "count-rows"), s.Aggregation("r", "r", "sum", "Revenue")]))
    q = QuerySet(samples.preparation_lab(spark), [clean, months, joined])
    assert q.evaluate("clean").df().count() == 100 and q.evaluate("months").df().count() == 300
    out = {r["Land"]: r["n"] for r in q.evaluate("joined").df().collect()}
    assert set(out) == {"ES", "FR", "DE"} and 250 < sum(out.values()) <= 300
    wide = QuerySet({"t": samples.monthly_targets(spark)}, [Query("long", "t", [s.UnpivotColumns(["Product"], "other-columns")])])
    assert wide.evaluate("long").df().count() == 12
    assert [type(x).__name__ for x in clean.moved(0, 2).removed(4).updated(0, s.RemoveDuplicates()).steps] == ["RemoveDuplicates", "RemoveDuplicates", "RemoveColumns", "ChangeType"]
    assert clean.renamed("x").name == "x"
