"""Data-preparation steps over small tables, order and blanks included."""

from __future__ import annotations

import pytest

from loomquery.diagnostics import EngineError
from loomquery.operators import steps as s
from loomquery.operators.frame import Frame
from loomquery.plans.pipeline import Query, QuerySet, run_steps

CTX = s.Context()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "a-b", None, 2.5, True), (2, "ab", 1, None, False), (3, None, None, -2.5, None), (4, "", 0, 1.0, True), (5, "X-y-z", None, 3.0, False)]
    return Frame.of(spark.createDataFrame(data, "k long, t string, n long, d double, b boolean"), True)


def got(frame: Frame) -> list[tuple]:
    return [tuple(r) for r in frame.sorted_out().collect()]


def column(frame: Frame, name: str) -> list:
    return [r[name] for r in frame.sorted_out().collect()]


def code(step: s.Step, frame: Frame, ctx: s.Context = CTX) -> str:
    with pytest.raises(EngineError) as e:
        step.apply(frame, ctx)
    return e.value.code


def test_columns(rows):
    f = s.ReorderColumns(["d", "t"]).apply(s.RenameColumns({"t": "Text", "n": "t"}).apply(rows, CTX), CTX)
    assert [c.name for c in f.cols] == ["d", "Text", "k", "t", "b"]
    assert got(s.FilterRows([s.Condition("t", "equals", "ab")]).apply(f, CTX)) == [(None, "ab", 2, 1, False)]  # ids stay
    assert code(s.RenameColumns({"t": "K"}), rows) == "QUERY_DUPLICATE_COLUMN_NAME"
    assert code(s.RenameColumns({"t": " "}), rows) == "QUERY_INVALID_STEP_CONFIG"
    assert code(s.RemoveColumns(["k", "t", "n", "d", "b"]), rows) == "QUERY_NO_COLUMNS"
    assert code(s.RemoveColumns(["nope"]), rows) == "QUERY_COLUMN_NOT_FOUND"


@pytest.mark.parametrize(
    "column_id, operator, value, keys",
    [
        ("t", "equals", "ab", [2]), ("t", "not-equals", "ab", [1, 5]), ("t", "contains", "B", [1, 2]), ("t", "starts-with", "x", [5]), ("t", "ends-with", "Z", [5]), ("t", "is-blank", None, [3, 4]), ("t", "is-not-blank", None, [1, 2, 5]),
        ("n", "is-blank", None, [1, 3, 5]), ("n", "equals", 0, [4]), ("d", "greater-than", 1, [1, 5]), ("d", "greater-than-or-equal", 1, [1, 4, 5]), ("d", "less-than", 1, [3]), ("d", "less-than-or-equal", 1, [3, 4]), ("n", "not-equals", 0, [2]), ("k", "equals", "5", [5]),
        ("b", "equals", True, [1, 4]), ("k", "contains", "4", [4]), ("t", "equals", None, []),
    ],
)
def test_conditions(rows, column_id, operator, value, keys):
    assert column(s.FilterRows([s.Condition(column_id, operator, value)]).apply(rows, CTX), "k") == keys


def test_filter_logic(rows):
    two = [s.Condition("t", "is-blank"), s.Condition("n", "not-equals", 1)]
    assert column(s.FilterRows(two, "or").apply(rows, CTX), "k") == [3, 4]
    assert column(s.FilterRows(two, "and").apply(rows, CTX), "k") == [4]
    assert code(s.FilterRows([]), rows) == "QUERY_INVALID_FILTER"
    assert code(s.FilterRows([s.Condition("t", "like", "a")]), rows) == "QUERY_INVALID_FILTER"


def test_fill(rows):
    assert column(s.Fill(["n"]).apply(rows, CTX), "n") == [None, 1, 1, 0, 0]
    assert column(s.Fill(["n", "t"], "up").apply(rows, CTX), "n") == [1, 1, 0, 0, None]
    assert column(s.Fill(["t", "b"]).apply(rows, CTX), "t") == ["a-b", "ab", "ab", "", "X-y-z"]  # an empty text is a value


def test_fill_over_many_partitions(spark):
    data = [(i, i if i % 97 == 0 else None) for i in range(1, 2000)]
    f = Frame.of(spark.createDataFrame(data, "k long, v long").repartition(7))
    f = s.Fill(["v"]).apply(s.SortRows([("k", "asc")]).apply(f, CTX), CTX)
    assert column(f, "v") == [k // 97 * 97 or None for k in range(1, 2000)]


def test_index_over_many_partitions(spark):
    f = Frame.of(spark.createDataFrame([(i * 7 % 1999,) for i in range(1999)], "k long").repartition(5))
    f = s.IndexColumn("i", "i", 3, 2).apply(s.SortRows([("k", "desc")]).apply(f, CTX), CTX)
    assert column(f, "i") == [3 + 2 * n for n in range(1999)]
    assert column(f, "k") == list(range(1998, -1, -1))
    assert code(s.IndexColumn("i", "i", 1, 0), f) == "QUERY_INDEX_INVALID_CONFIG"


def test_sort_and_first(rows):
    down = s.SortRows([("d", "desc")]).apply(rows, CTX)
    assert column(down, "k") == [5, 1, 4, 3, 2]  # blanks last
    assert column(s.SortRows([("d", "asc")]).apply(rows, CTX), "k") == [2, 3, 4, 1, 5]
    assert column(s.RemoveDuplicates(["b"]).apply(down, CTX), "k") == [5, 1, 3]
    text = s.SortRows([("t", "desc")]).apply(rows, CTX)
    assert column(s.RemoveDuplicates(["b"]).apply(text, CTX), "k") == [2, 1, 3]
    assert column(s.SortRows([("b", "asc")]).apply(rows, CTX), "k") == [3, 2, 5, 1, 4]  # ties keep their order


def test_duplicates(spark):
    f = Frame.of(spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 3)], "x string, y long"), True)
    assert got(s.RemoveDuplicates(["x"]).apply(f, CTX)) == [(None, 1), ("a", 3)]
    assert got(s.RemoveDuplicates().apply(f, CTX)) == [(None, 1), (None, 2), ("a", 3)]


def test_split_merge(rows):
    f = s.SplitColumn("t", "-", ("l", "r"), ("l", "r"), True).apply(rows, CTX)
    assert list(zip(column(f, "l"), column(f, "r"), strict=True)) == [("a", "b"), ("ab", None), (None, None), ("", None), ("X", "y-z")]
    assert column(s.MergeColumns(["k", "t", "b", "d"], "|", "m", "m").apply(rows, CTX), "m") == ["1|a-b|true|2.5", "2|ab|false|", "3|||-2.5", "4||true|1", "5|X-y-z|false|3"]
    assert code(s.SplitColumn("t", "", ("l", "r"), ("l", "r")), rows) == "QUERY_INVALID_STEP_CONFIG"
    assert code(s.MergeColumns(["k"], "|", "m", "m"), rows) == "QUERY_INVALID_STEP_CONFIG"


def test_change_type(rows):
    f = s.ChangeType({"k": "string", "b": "string", "n": "decimal"}).apply(rows, CTX)
    assert (column(f, "k"), column(f, "b"), column(f, "n")) == (list("12345"), ["true", "false", None, "true", "false"], [None, 1.0, None, 0.0, None])
    with pytest.raises(EngineError) as e:
        s.ChangeType({"t": "integer"}).apply(rows, CTX)
    assert e.value.code == "QUERY_TYPE_CONVERSION_FAILED" and e.value.diagnostics[0].details["count"] == 4
    assert code(s.ChangeType({"d": "integer"}), rows) == "QUERY_TYPE_CONVERSION_FAILED"  # 2.5 would lose its half
    with pytest.raises(Exception, match="QUERY_TYPE_CONVERSION_FAILED"):
        s.ChangeType({"t": "integer"}).apply(rows, s.Context(check="lazy")).out().collect()


def test_replace(rows):
    assert column(s.ReplaceValues([("n", None, 7), ("n", 7, 8)]).apply(rows, CTX), "n") == [8, 1, 8, 0, 8]
    assert column(s.ReplaceValues([("t", "", "empty"), ("t", 5, "x")]).apply(rows, CTX), "t") == ["a-b", "ab", None, "empty", "X-y-z"]
    assert code(s.ReplaceValues([("n", 1, "one")]), rows) == "QUERY_INVALID_STEP_CONFIG"


def test_group(rows):
    aggs = [s.Aggregation("c", "c", "count-rows"), s.Aggregation("s", "s", "sum", "n"), s.Aggregation("a", "a", "average", "d")]
    assert got(s.GroupBy(["b"], aggs).apply(rows, CTX)) == [(True, 2, 0, 1.75), (False, 2, 1, 3.0), (None, 1, None, -2.5)]
    none = s.FilterRows([s.Condition("k", "greater-than", 9)]).apply(rows, CTX)
    assert got(s.GroupBy([], aggs).apply(none, CTX)) == []
    assert code(s.GroupBy([], [s.Aggregation("s", "s", "sum", "t")]), rows) == "QUERY_INVALID_STEP_CONFIG"


def test_joins(spark, rows):
    g = Frame.of(spark.createDataFrame([(1, "one"), (1, "uno"), (None, "none"), (9, "nine")], "id long, w string"), True)
    ctx = s.Context({"g": g})
    run = lambda kind: [(r["k"], r["W"]) for r in s.MergeQueries("g", kind, ["n"], ["id"], [("w", "w", "W")]).apply(rows, ctx).sorted_out().collect()]
    assert run("left-outer") == [(1, None), (2, "one"), (2, "uno"), (3, None), (4, None), (5, None)]
    assert run("inner") == [(2, "one"), (2, "uno")]
    assert run("right-outer") == [(2, "one"), (2, "uno"), (None, "none"), (None, "nine")]
    assert run("full-outer") == [(1, None), (2, "one"), (2, "uno"), (3, None), (4, None), (5, None), (None, "none"), (None, "nine")]
    assert run("left-anti") == [(1, None), (3, None), (4, None), (5, None)]  # blank keys never match
    assert run("right-anti") == [(None, "none"), (None, "nine")]
    assert code(s.MergeQueries("g", "inner", ["t"], ["id"], []), rows, ctx) == "QUERY_JOIN_KEY_TYPE_MISMATCH"
    assert code(s.MergeQueries("g", "inner", ["n"], ["id"], [("w", "w", "K")]), rows, ctx) == "QUERY_MERGE_COLUMN_COLLISION"
    assert code(s.MergeQueries("h", "inner", ["n"], ["id"], []), rows, ctx) == "QUERY_DEPENDENCY_NOT_FOUND"


def test_append(spark, rows):
    g = Frame.of(spark.createDataFrame([(9.5, "new")], "n double, extra string"))
    f = s.AppendQueries(["g"]).apply(rows, s.Context({"g": g}))
    assert [c.name for c in f.cols] == ["k", "t", "n", "d", "b", "extra"]
    assert got(f)[-1] == (None, None, 9.5, None, None, "new") and column(f, "n") == [None, 1.0, None, 0.0, None, 9.5]
    bad = Frame.of(spark.createDataFrame([("x",)], "n string"))
    assert code(s.AppendQueries(["g"]), rows, s.Context({"g": bad})) == "QUERY_INVALID_STEP_CONFIG"


def test_pivot(spark):
    data = [("x", "a", 1), ("x", None, 2), ("x", "", 3), ("y", "a", None), ("y", "a", 5)]
    f = Frame.of(spark.createDataFrame(data, "g string, p string, v long"), True)
    table = lambda agg: ([c.name for c in s.PivotColumn("s", "p", "v", agg).apply(f, CTX).cols], sorted(got(s.PivotColumn("s", "p", "v", agg).apply(f, CTX))))
    assert table("sum") == (["g", "(blank)", "a"], [("x", 5, 1), ("y", None, 5)])
    assert table("count")[1] == [("x", 2, 1), ("y", None, 2)]
    assert table("first")[1] == [("x", 2, 1), ("y", None, None)]
    assert s.PivotColumn("s", "p", "v", "sum").apply(f, CTX).cols[1].id == s.pivot_id("s", "(blank)")
    assert code(s.PivotColumn("s", "v", "p", "sum"), f) == "QUERY_PIVOT_VALUE_TYPE_INVALID"
    assert code(s.PivotColumn("s", "p", "v", "median"), f) == "QUERY_PIVOT_AGGREGATION_INVALID"
    clash = Frame.of(spark.createDataFrame([("x", "G", 1)], "g string, p string, v long"))
    assert code(s.PivotColumn("s", "p", "v", "sum"), clash) == "QUERY_PIVOT_SCHEMA_COLLISION"


def test_unpivot(rows):
    f = s.UnpivotColumns(["n", "d"]).apply(rows, CTX)
    assert got(f)[:4] == [(1, "a-b", True, "n", None), (1, "a-b", True, "d", 2.5), (2, "ab", False, "n", 1.0), (2, "ab", False, "d", None)]
    mixed = s.UnpivotColumns(["k"], "other-columns").apply(rows, CTX)
    assert [r[2] for r in got(mixed)[:4]] == ["a-b", None, "2.5", "true"]
    assert code(s.UnpivotColumns(["zz"]), rows) == "QUERY_UNPIVOT_COLUMN_NOT_FOUND"


def test_conditional(rows):
    f = s.ConditionalColumn("q", "q", [(s.Condition("t", "contains", "A"), 1), (s.Condition("n", "is-blank"), 2.5)], None).apply(rows, CTX)
    assert column(f, "q") == [1.0, 1.0, 2.5, None, 2.5]
    assert code(s.ConditionalColumn("q", "q", [(s.Condition("t", "is-blank"), 1)], "x"), rows) == "QUERY_CONDITIONAL_INVALID_RESULT_TYPE"


@pytest.mark.parametrize(
    "text, want",
    [
        ("[k] * 2 - 1", [1, 3, 5, 7, 9]), ("-[k] + 10 / 4", [1.5, 0.5, -0.5, -1.5, -2.5]), ('[t] & "!"', ["a-b!", "ab!", "!", "!", "X-y-z!"]), ("[n] = null", [True, False, True, False, True]), ('[t] <> "ab"', [True, False, True, True, True]),
        ("if [k] > 2 then Number.Round([k] / 2) else 0", [0, 0, 2, 2, 3]), ("Number.Round(-[k] / 2)", [0, -1, -1, -2, -2]), ("Number.Round([k] / 3, 2)", [0.33, 0.67, 1.0, 1.33, 1.67]), ("Number.Abs(0 - [k])", [1, 2, 3, 4, 5]), ("Text.Length([t])", [3, 2, 0, 0, 5]), ("Text.Upper(Text.Trim(\"  a \") & [t])", ["AA-B", "AAB", "A", "A", "AX-Y-Z"]),
        ('Date.Year("2024-02-29") + Date.Day("2024-02-29") + [k]', [2054, 2055, 2056, 2057, 2058]), ('[k] = "1"', [True, False, False, False, False]), ("(1 + 2) * [k] >= 9", [False, False, True, True, True]), ('if [b] = null then "none" else [t]', ["a-b", "ab", "none", "", "X-y-z"]),
    ],
)
def test_formulas(rows, text, want):
    assert column(s.CustomColumn("x", "x", text).apply(rows, CTX), "x") == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("[k] +", "QUERY_CUSTOM_PARSE_ERROR"), ("[zz]", "QUERY_CUSTOM_COLUMN_NOT_FOUND"), ("Foo(1)", "QUERY_CUSTOM_PARSE_ERROR"), ("[n] + 1", "QUERY_CUSTOM_TYPE_ERROR"), ("1 / ([k] - 3)", "QUERY_CUSTOM_DIVIDE_BY_ZERO"), ("[t] > \"a\"", "QUERY_CUSTOM_TYPE_ERROR"),
        ("if [b] then 1 else 2", "QUERY_CUSTOM_TYPE_ERROR"), ("Text.Upper([k])", "QUERY_CUSTOM_TYPE_ERROR"), ('"a" * 2', "QUERY_CUSTOM_TYPE_ERROR"), ('if true then 1 else "x"', "QUERY_CUSTOM_TYPE_ERROR"),
    ],
)
def test_formula_errors(rows, text, want):
    assert code(s.CustomColumn("x", "x", text), rows) == want


def test_errors_count_only_where_a_branch_is_taken(rows):
    assert column(s.CustomColumn("x", "x", "if [k] = 3 then 0 else 6 / ([k] - 3)").apply(rows, CTX), "x") == [-3.0, -6.0, 0.0, 6.0, 3.0]


def test_pipeline_stops_at_the_first_error(rows):
    frame, results = run_steps(rows, [s.RemoveColumns(["t"]), s.RemoveColumns(["t"]), s.RemoveColumns(["n"])], CTX)
    assert [r.status for r in results] == ["success", "error", "skipped"]
    assert [c.name for c in frame.cols] == ["k", "n", "d", "b"]  # the last good frame


def test_queries_read_queries(spark, rows):
    base = rows.out()
    q = QuerySet({"base": base}, [Query("b", "a", [s.RemoveColumns(["n"])]), Query("a", "base", [s.FilterRows([s.Condition("k", "less-than", 3)])], load=False), Query("x", "y"), Query("y", "x"), Query("z", "nothing")])
    assert [tuple(r) for r in q.evaluate("b").df().collect()] == [(1, "a-b", 2.5, True), (2, "ab", None, False)]
    assert q.order() == ["a", "b"] and set(q.loaded()) == {"base", "b"}
    assert {n: d.code for n, d in q.problems().items()} == {"x": "QUERY_DEPENDENCY_CYCLE", "y": "QUERY_DEPENDENCY_CYCLE", "z": "QUERY_SOURCE_NOT_FOUND"}
    assert q.evaluate("z").status == "error"
    other = QuerySet({"base": base}, [Query("c", "base", [s.FilterRows([s.Condition("k", "less-than", 3)])]), Query("d", "base", [s.FilterRows([s.Condition("k", "less-than", 4)])])])
    assert other.fingerprint("c") == q.fingerprint("a") != other.fingerprint("d")
