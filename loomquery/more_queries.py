"""Queries of what surrounds the data: imports, checks, explanations, validation, workspaces, errors; each beside its SQL.

What is computed from data has SQL over the data. What a definition alone decides, such as the code of an error, is listed
by hand in the SQL, case by case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .diagnostics import EngineError
from .operators.frame import Frame
from .operators.steps import AppendQueries, ChangeType, CustomColumn, FilterRows, GroupBy, MergeQueries, RemoveColumns, RemoveDuplicates, RenameColumns, SortRows
from .plans import explain, visuals
from .plans.context import Context
from .plans.measures import calculated_value, checked, evaluate
from .plans.model import Model, Relationship
from .plans.notebook import Cell, Notebook
from .plans.pipeline import Query, QuerySet
from .plans.validation import RULES, Rule, Subject, Tolerance, fingerprint, validate
from .plans.workspace import Workspace, column_dependents, definition_of
from .queries import FOUND, Aggregation, C, by, calendar, one, r2, seg, shaped, star, tables
from .shared import scratch_path
from .sources import samples, workbooks


def quoted(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def listed(names: str, rows: list[tuple]) -> str:
    """SQL of rows that are known."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


def told(name: str, schema: str, sql: str):
    """A query whose rows are made on the driver: findings, codes, definitions."""

    def add(run: Callable[[SparkSession, str], list[tuple]]):
        FOUND[name] = (lambda spark, d: spark.createDataFrame(run(spark, d), schema), sql)
        return run

    return add


def code_of(run: Callable) -> str:
    """The code of the error that `run` raises, or of the first finding that it returns."""
    try:
        found = run()
    except EngineError as e:
        return e.code
    return found[0].code if isinstance(found, list) and found else "none"


def codes(name: str, cases: list[tuple[str, str]], run: Callable):
    """Rows (text, code): what is wrong with each of some expressions."""
    told(name, "text string, code string", listed("text, code", cases))(lambda spark, d: [(text, code_of(lambda text=text: run(spark, d, text))) for text, _ in cases])


# Sources.
def as_csv(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.options(header=True, quote='"', escape='"', emptyValue="", nullValue="").csv(path)
    return path


@shaped("csv_import", f"SELECT o_orderkey, o_custkey, {r2('o_totalprice')} AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 5 <> 0 THEN 'says \"' || o_orderstatus || '\", twice' END AS note FROM orders")
def csv_import(spark, d):
    """Orders written as delimited text, with quotes, delimiters and blanks in it, and read back with inferred types."""
    o = tables(spark, d)["orders"]
    note = F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit('says "'), "o_orderstatus", F.lit('", twice')))
    text = o.select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even"), note.alias("note"))
    return sources.read_csv(spark, as_csv(text, "orders-csv")).df


@told("csv_types", "name string, type string", listed("name, type", [("o_orderkey", "integer"), ("o_totalprice", "decimal"), ("day", "date"), ("at", "datetime"), ("even", "boolean"), ("o_orderstatus", "string"), ("mostly", "string"), ("mixed", "decimal"), ("Column9", "null"), ("o_orderstatus_2", "string")]))
def csv_types(spark, d):
    o = tables(spark, d)["orders"]
    t = F.to_timestamp("o_orderdate")
    text = o.select("o_orderkey", "o_totalprice", F.date_format(t, "yyyy-MM-dd").alias("day"), F.date_format(t, "yyyy-MM-dd'T'HH:mm").alias("at"), (F.col("o_orderkey") % 2 == 0).alias("even"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 1, "n/a").otherwise(F.col("o_orderkey").cast("string")).alias("mostly"), F.when(F.col("o_orderkey") % 7 == 1, "0.5").otherwise(F.col("o_orderkey").cast("string")).alias("mixed"), F.lit(None).cast("string").alias(" "), F.col("o_orderstatus").alias(" O_ORDERSTATUS "))
    text = text.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in text.columns]).toDF(*text.columns[:-1], "o_orderstatus ")
    return list(sources.typed(text).types.items())


@shaped("type_misfits", "SELECT 'day' AS \"column\", 'date' AS type, count(*) AS misfits FROM orders WHERE o_orderkey % 50 = 7 UNION ALL SELECT 'n', 'integer', count(*) FROM orders WHERE o_orderkey % 11 = 3")
def type_misfits(spark, d):
    """Columns that look like dates and whole numbers but for some rows: they stay text, and the rows are counted."""
    k = F.col("o_orderkey")
    text = tables(spark, d)["orders"].select(F.when(k % 50 == 7, "2024-02-31").otherwise("2024-02-01").alias("day"), F.when(k % 11 == 3, "none").otherwise(k.cast("string")).alias("n"))
    got = sources.typed(text)
    return spark.createDataFrame([(x.details["column"], x.details["type"], x.details["count"]) for x in got.diagnostics], "column string, type string, misfits long")


TEXTS = [" 12 ", "12.50", "x", "TRUE", "2024-01-05", "2024-01-05T10:30", "null", ""]
COERCED = [
    (" 12 ", 12, 12.0, None, None), ("12.50", None, 12.5, None, None), ("x", None, None, None, None), ("TRUE", None, None, True, None), ("2024-01-05", None, None, None, "2024-01-05"), ("2024-01-05T10:30", None, None, None, "2024-01-05"), ("null", None, None, None, None), ("", None, None, None, None),
]


@shaped("type_coercion", "SELECT text, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(b AS BOOLEAN) AS b, CAST(day AS VARCHAR) AS day FROM (" + listed("text, i, x, b, day", COERCED) + ")")
def type_coercion(spark, d):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    return rows.select("text", *[sources.coerced(F.col("text"), k).alias(n) for n, k in (("i", "integer"), ("x", "decimal"), ("b", "boolean"), ("day", "date"))])


told("import_headers", "given string, name string", listed("given, name", [("a", "a"), (" a ", "a_2"), ("", "Column3"), ("A", "A_3"), ("b", "b")]))(lambda spark, d: list(zip(given := ["a", " a ", "", "A", "b"], sources.header(given), strict=True)))
SAMPLE_ROWS = [("retail", "Customers", 120), ("retail", "Products", 20), ("retail", "Calendar", 731), ("retail", "Sales", 1500), ("relationships", "Calendar", 731), ("relationships", "Customers", 30), ("relationships", "CustomerProfile", 30), ("relationships", "Products", 20), ("relationships", "Targets", 12), ("relationships", "Sales", 500), ("preparation", "Customers_Dirty", 108), ("preparation", "Sales_Jan", 150), ("preparation", "Sales_Feb", 150), ("preparation", "Products", 12), ("targets", "Monthly", 3)]


@told("sample_tables", "sample string, name string, n long", listed("sample, name, n", SAMPLE_ROWS))
def sample_tables(spark, d):
    kinds = {"retail": samples.retail(spark), "relationships": samples.relationship_lab(spark), "preparation": samples.preparation_lab(spark), "targets": {"Monthly": samples.monthly_targets(spark)}}
    return [(kind, n, df.count()) for kind, found in kinds.items() for n, df in found.items()]


@shaped("sample_keys_meet", "SELECT 1500::BIGINT AS sales, 1500::BIGINT AS met")
def sample_keys_meet(spark, d):
    t = samples.retail(spark)
    met = t["Sales"].join(t["Customers"], "CustomerID", "left_semi").join(t["Products"], "ProductID", "left_semi").join(t["Calendar"], "Date", "left_semi")
    return t["Sales"].agg(F.count("*").alias("sales")).crossJoin(met.agg(F.count("*").alias("met")))  # one row each


def nations_sheet(spark, d) -> str:
    """The nations as a workbook, with a blank row, a blank cell and text that needs care."""
    rows = [[r["n_nationkey"], r["n_name"], None if r["n_nationkey"] % 4 == 0 else r["n_nationkey"] / 4, f'<{r["n_regionkey"]}> & "more"', r["n_regionkey"] == 1] for r in tables(spark, d)["nation"].orderBy("n_nationkey").collect()]
    path = scratch_path(spark, "nations") + ".xlsx"
    workbooks.save(spark, path, {"Nations": [["key", "name", "quarter", "note", "first"], [None] * 5, *rows], "Notes": [["text"], ["x"]]})
    return path


@shaped("sheet_import", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, " + r2("CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey / 4 END") + " AS quarter, '<' || n_regionkey || '> & \"more\"' AS note, n_regionkey = 1 AS first FROM nation")
def sheet_import(spark, d):
    return sources.read_sheet(spark, nations_sheet(spark, d), "Nations").df


told("sheet_names", "place int, name string", listed("place, name", [(0, "Nations"), (1, "Notes")]))(lambda spark, d: list(enumerate(sources.sheets(spark, nations_sheet(spark, d)))))


# Pipelines.
@shaped("pq_sort_order", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, row_number() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END NULLS FIRST, n_name DESC) - 1 AS place FROM nation")
def pq_sort_order(spark, d):
    """Rows as they come out of a sort with a blank first: their order itself is the result."""
    steps = [CustomColumn("k", "k", "if [n_nationkey] / 3 = Number.Round([n_nationkey] / 3) then null else [n_regionkey]"), SortRows([("k", "asc"), ("n_name", "desc")])]
    e = QuerySet(tables(spark, d), [Query("q", "nation", steps)], check="lazy").evaluate("q")
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"], i) for i, r in enumerate(e.frame.sorted_out().collect())], "n_nationkey long, n_name string, place long")


def broken(spark, d) -> QuerySet:
    t = dict(tables(spark, d).items())
    return QuerySet(t, [Query("a", "b"), Query("b", "a"), Query("c", "nowhere"), Query("d", "orders", [AppendQueries(["c"])]), Query("e", "region"), Query("f", "e")])


@told("query_graph", "query string, code string, place int", listed("query, code, place", [("a", "QUERY_DEPENDENCY_CYCLE", None), ("b", "QUERY_DEPENDENCY_CYCLE", None), ("c", "QUERY_SOURCE_NOT_FOUND", None), ("d", "QUERY_DEPENDENCY_NOT_FOUND", None), ("e", None, 0), ("f", None, 1)]))
def query_graph(spark, d):
    q = broken(spark, d)
    bad, order = q.problems(), q.order()
    return [(n, bad[n].code if n in bad else None, order.index(n) if n in order else None) for n in q.queries]


@shaped("query_last_good_frame", "SELECT o_orderkey, o_orderstatus AS Status FROM orders WHERE o_orderstatus = 'F'")
def query_last_good_frame(spark, d):
    """A step that fails: what the steps before it made is still there."""
    steps = [FilterRows([C("o_orderstatus", "equals", "F")]), RenameColumns({"o_orderstatus": "Status"}), RemoveColumns(["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]), RemoveColumns(["nothing"]), RemoveDuplicates()]
    e = QuerySet(tables(spark, d), [Query("q", "orders", steps)]).evaluate("q")
    assert [s.status for s in e.steps] == ["success", "success", "success", "error", "skipped"]
    return e.df()


def step_codes(chain):
    return lambda spark, d: code_of(lambda: QuerySet(tables(spark, d), [Query("q", "orders", chain)]).evaluate("q").diagnostics)


STEP_ERRORS = {
    "rename to a name that is there": ([RenameColumns({"o_orderkey": "o_custkey"})], "QUERY_DUPLICATE_COLUMN_NAME"),
    "remove a missing column": ([RemoveColumns(["x"])], "QUERY_COLUMN_NOT_FOUND"),
    "text as whole numbers": ([ChangeType({"o_orderstatus": "integer"})], "QUERY_TYPE_CONVERSION_FAILED"),
    "join key of another type": ([MergeQueries("customer", "inner", ["o_custkey"], ["c_name"], [])], "QUERY_JOIN_KEY_TYPE_MISMATCH"),
    "join key that is gone": ([MergeQueries("customer", "inner", ["o_custkey"], ["gone"], [])], "QUERY_DEPENDENCY_SCHEMA_CHANGED"),
    "expanded name that is there": ([MergeQueries("customer", "inner", ["o_custkey"], ["c_custkey"], [("c_name", "x", "o_orderkey")])], "QUERY_MERGE_COLUMN_COLLISION"),
    "group sum of text": ([GroupBy([], [Aggregation("s", "s", "sum", "o_orderstatus")])], "QUERY_INVALID_STEP_CONFIG"),
    "division by zero in a row": ([CustomColumn("x", "x", "[o_totalprice] / ([o_orderkey] - [o_orderkey])")], "QUERY_CUSTOM_DIVIDE_BY_ZERO"),
}
told("step_errors", "what string, code string", listed("what, code", [(k, c) for k, (_, c) in STEP_ERRORS.items()]))(lambda spark, d: [(k, step_codes(chain)(spark, d)) for k, (chain, _) in STEP_ERRORS.items()])


@told("query_fingerprints", "change string, same boolean", listed("change, same", [("another name", True), ("another step", False), ("a step in another order", False), ("another source", False), ("a change in a query that is read", False)]))
def query_fingerprints(spark, d):
    t, steps = tables(spark, d), [FilterRows([C("o_totalprice", "greater-than", 5)]), RemoveDuplicates(["o_custkey"])]
    of = lambda q, *more: QuerySet(t, [q, *more]).fingerprint(q.name)
    q, inner = Query("q", "orders", steps), Query("inner", "orders", steps[:1])
    outer = Query("outer", "inner", steps[1:])
    return [("another name", of(q) == of(q.renamed("z"))), ("another step", of(q) == of(q.removed(1))), ("a step in another order", of(q) == of(q.moved(0, 1))), ("another source", of(q) == of(Query("q", "customer", steps))), ("a change in a query that is read", of(outer, inner) == of(outer, inner.added(steps[1])))]


@told("query_edits", "edit string, steps string", listed("edit, steps", [("added", "FilterRows RemoveDuplicates SortRows"), ("inserted", "SortRows FilterRows RemoveDuplicates"), ("removed", "RemoveDuplicates"), ("updated", "SortRows RemoveDuplicates"), ("moved", "RemoveDuplicates FilterRows")]))
def query_edits(spark, d):
    q, sort = Query("q", "orders", [FilterRows([C("o_totalprice", "greater-than", 5)]), RemoveDuplicates()]), SortRows([("o_orderkey", "asc")])
    edits = {"added": q.added(sort), "inserted": q.added(sort, 0), "removed": q.removed(0), "updated": q.updated(0, sort), "moved": q.moved(0, 1)}
    return [(n, " ".join(type(s).__name__ for s in x.steps)) for n, x in edits.items()]


def formula_code(spark, d, text):
    from .functions.formula import compiled

    compiled(text, Frame.of(tables(spark, d)["orders"]))


codes("formula_errors", [("[o_custkey] + 1", "none"), ("[nope] + 1", "QUERY_CUSTOM_COLUMN_NOT_FOUND"), ("Text.Nope([o_orderstatus])", "QUERY_CUSTOM_PARSE_ERROR"), ("Text.Upper()", "QUERY_CUSTOM_PARSE_ERROR"), ("Number.Round(1, 2, 3)", "QUERY_CUSTOM_PARSE_ERROR"), ("1 +", "QUERY_CUSTOM_PARSE_ERROR"), ("if [o_custkey] > 1 then 1 else \"a\"", "QUERY_CUSTOM_TYPE_ERROR")], formula_code)

# The language and the model.
MEASURE_CODES = [
    ("1 +", "SYNTAX_ERROR"), ("SUM(orders[o_totalprice]", "SYNTAX_ERROR"), ("1 2", "SYNTAX_ERROR"), ("#", "SYNTAX_ERROR"), ("VAR 1 = 2 RETURN 3", "INVALID_VARIABLE_NAME"), ("VAR a = 1", "SYNTAX_ERROR"),
    ("SUM(nope[x])", "UNKNOWN_TABLE"), ("SUM(orders[nope])", "UNKNOWN_COLUMN"), ("[nope]", "UNKNOWN_MEASURE"), ("orders[o_custkey]", "COLUMN_REQUIRES_AGGREGATION"), ("orders", "BARE_TABLE_REFERENCE"), ("SUM(customer[c_name])", "NON_NUMERIC_AGGREGATION"),
    ("IF(1, 2)", "IF_CONDITION_NOT_BOOLEAN"), ('"a" + 1', "TYPE_MISMATCH"), ("VAR x = 1 VAR x = 2 RETURN x", "DUPLICATE_VARIABLE"), ("VAR a = b VAR b = 1 RETURN a", "FORWARD_VARIABLE_REFERENCE"),
]
REJECTED = [
    ("ALLEXCEPT(orders, orders[o_custkey])", "UNSUPPORTED_FUNCTION"), ("ALLSELECTED(orders)", "UNSUPPORTED_FUNCTION"), ("CALCULATETABLE(orders)", "UNSUPPORTED_FUNCTION"), ("KEEPFILTERS(orders[o_custkey] = 1)", "CALCULATE_INVALID_FILTER_ARGUMENT"), ("REMOVEFILTERS(orders)", "INVALID_REMOVEFILTERS_ARGUMENT"), ("ALL(orders)", "INVALID_ALL_ARGUMENT"),
    ("USERELATIONSHIP(orders[o_custkey], customer[c_custkey])", "USERELATIONSHIP_INVALID_CONTEXT"), ("CROSSFILTER(orders[o_custkey], customer[c_custkey], NONE)", "CROSSFILTER_INVALID_CONTEXT"), ("VALUES(orders[o_custkey])", "INVALID_TABLE_EXPRESSION_ARGUMENT"), ("DATESYTD(calendar[Date])", "INVALID_TABLE_EXPRESSION_ARGUMENT"),
    ("VAR t = SUMMARIZE(orders, orders[o_custkey]) RETURN 1", "TABLE_VARIABLE_NOT_SUPPORTED"), ("VAR t = ADDCOLUMNS(orders, 1) RETURN 1", "TABLE_VARIABLE_NOT_SUPPORTED"), ("CALCULATE([Revenue], orders[o_totalprice] + 1 > 2)", "CALCULATE_INVALID_FILTER_ARGUMENT"), ("CALCULATE([Revenue], [Orders] > 5)", "BOOLEAN_FILTER_MEASURE_REFERENCE"),
    ("RANKX(orders, 1)", "UNSUPPORTED_FUNCTION"), ("TOPN(1, orders)", "UNSUPPORTED_FUNCTION"), ("SUMX(orders, CALCULATE([Revenue]))", "ITERATOR_CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED"), ("RELATED(customer[c_name])", "RELATED_REQUIRES_ROW_CONTEXT"),
]
TIME_CODES = [
    ("CALCULATE([Revenue], DATESYTD(orders[o_orderdate]))", "DATE_TABLE_REQUIRED"), ("CALCULATE([Revenue], SAMEPERIODLASTYEAR(calendar[Year]))", "DATE_TABLE_REQUIRED"), ("CALCULATE([Revenue], DATESYTD(1))", "TIME_INTELLIGENCE_INVALID_ARGUMENT"), ("CALCULATE([Revenue], DATEADD(calendar[Date], 1))", "TIME_INTELLIGENCE_INVALID_ARGUMENT"),
    ("CALCULATE([Revenue], DATEADD(calendar[Date], 1.5, DAY))", "DATEADD_INTERVAL_COUNT_INVALID"), ("CALCULATE([Revenue], DATEADD(calendar[Date], 1, WEEK))", "DATEADD_INVALID_INTERVAL"), ("TOTALYTD([Revenue])", "TOTALYTD_INVALID_ARGUMENT"), ("TOTALYTD([Revenue], orders[o_orderdate])", "DATE_TABLE_REQUIRED"), ("COUNTROWS(PREVIOUSYEAR(calendar[Date]))", "none"),
]
for rows_name, found in (("measure_errors", MEASURE_CODES), ("rejected_functions", REJECTED), ("time_bind_errors", TIME_CODES)):
    codes(rows_name, found, lambda spark, d, text: evaluate(star(spark, d), {"v": text}) and None)
COLUMN_CODES = [("CALCULATE(1)", "CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED"), ("customer[c_name]", "COLUMN_OUTSIDE_ROW_CONTEXT"), ("SUM(orders[o_totalprice])", "UNSUPPORTED_FUNCTION"), ("RELATED(customer[nope])", "UNKNOWN_COLUMN"), ("RELATED(lineitem[l_tax])", "RELATED_WRONG_DIRECTION"), ("RELATED(part[p_name])", "RELATED_NO_RELATIONSHIP"), ("orders[o_totalprice] * 2", "none")]
codes("calculated_column_errors", COLUMN_CODES, lambda spark, d, text: calculated_value(star(spark, d), "orders", text) and None)
ONEWAY = "CALCULATE({}, CROSSFILTER(customer[c_custkey], orders[o_custkey], {}))"
by("calc_crossfilter_oneway", "customer.c_mktsegment", ONEWAY.format("[Orders]", "ONEWAY"), seg("count(*)", count=True), customer="both")
by("calc_crossfilter_left_to_right", "orders.o_orderpriority", ONEWAY.format("COUNTROWS(customer)", "ONEWAY_LEFTFILTERSRIGHT"), "SELECT DISTINCT o_orderpriority AS member, (SELECT count(*) FROM customer) AS value FROM orders", customer="both")
codes("crossfilter_errors", [(ONEWAY.format("[Orders]", "ONEWAY_RIGHTFILTERSLEFT"), "CROSSFILTER_DIRECTION_INVALID_FOR_CARDINALITY"), (ONEWAY.format("[Orders]", "SIDEWAYS"), "CROSSFILTER_INVALID_DIRECTION"), ("CALCULATE(1, CROSSFILTER(customer[c_custkey], part[p_partkey], BOTH))", "CROSSFILTER_RELATIONSHIP_NOT_FOUND"), ("CALCULATE(1, CROSSFILTER(customer[c_custkey], BOTH))", "CROSSFILTER_INVALID_ARITY")], lambda spark, d, text: evaluate(star(spark, d), {"v": text}) and None)


@shaped("calc_crossfilter_right_to_left", "SELECT p_type AS member, (SELECT sum(p_size) FROM part) AS value FROM part GROUP BY 1")
def calc_crossfilter_right_to_left(spark, d):
    """A many-to-many relationship that filters from right to left only: the left side's members filter nothing."""
    from .plans.measures import grouped
    from .plans.model import MANY_MANY

    p = tables(spark, d)["part"]
    m = Model({"part": p.select("p_partkey", "p_type"), "targets": p.select("p_type", F.col("p_size").cast("bigint").alias("size"))}, [Relationship(("part", "p_type"), ("targets", "p_type"), MANY_MANY, "left-to-right")])
    return grouped(m, ("part", "p_type"), {"value": "CALCULATE(SUM(targets[size]), CROSSFILTER(part[p_type], targets[p_type], ONEWAY_RIGHTFILTERSLEFT))"})


for call in ("SAMEPERIODLASTYEAR(calendar[Date])", "PREVIOUSMONTH(calendar[Date])", "PREVIOUSYEAR(calendar[Date])", "DATESYTD(calendar[Date])", "DATEADD(calendar[Date], -1, MONTH)"):
    one("ti_empty_" + call.split("(")[0].lower(), f"COUNTROWS({call})", "0::BIGINT", {("calendar", "Year"): 1900})


@told("graph_gate", "model string, code string", listed("model, code", [("as it is", "none"), ("nation also filters supplier", "FILTER_GRAPH_INVALID"), ("orders and customer both ways, and region to orders", "FILTER_GRAPH_INVALID")]))
def graph_gate(spark, d):
    plain, second, third = star(spark, d), star(spark, d), star(spark, d, customer="both")
    second.relationships[:] = [Relationship(r.left, r.right, r.cardinality, r.direction, True) for r in second.relationships]
    third.relationships.append(Relationship(("region", "r_regionkey"), ("orders", "o_orderkey")))
    names = ["as it is", "nation also filters supplier", "orders and customer both ways, and region to orders"]
    return [(n, code_of(lambda m=m: m.require_valid_graph())) for n, m in zip(names, (plain, second, third), strict=True)]


@told("date_table_findings", "calendar string, code string", listed("calendar, code", [("without a week", "DATE_TABLE_NOT_CONTIGUOUS"), ("with a day twice", "DATE_TABLE_DATE_NOT_UNIQUE"), ("with a blank", "DATE_TABLE_DATE_HAS_BLANKS"), ("with times of day", "DATE_TABLE_INCONSISTENT_TIME"), ("by its year", "DATE_TABLE_INVALID_TYPE"), ("by a missing column", "DATE_COLUMN_NOT_FOUND")]))
def date_table_findings(spark, d):
    """What is wrong with broken calendars; the whole one has no row."""
    days = calendar(spark)
    day = F.col("Date")
    made = {"whole": days, "without a week": days.filter("Date NOT BETWEEN DATE'1998-03-01' AND DATE'1998-03-07'"), "with a day twice": days.union(days.limit(1)), "with a blank": days.union(days.limit(1).withColumn("Date", F.lit(None).cast("date"))), "with times of day": days.withColumn("Date", F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + F.when(F.dayofmonth(day) == 5, 3600).otherwise(0)))}
    m = Model(made)
    found = [(n, x.code) for n in made for x in m.check_date_table(n, "Date")]
    return [*found, *[("by its year", x.code) for x in m.check_date_table("whole", "Year")], *[("by a missing column", x.code) for x in m.check_date_table("whole", "x")]]


@shaped("relationship_findings", "SELECT 'customer to orders' AS relationship, 'UNMATCHED_FOREIGN_KEYS' AS code, count(*) AS n FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey UNION ALL SELECT 'segments', 'ONE_SIDE_NOT_UNIQUE', NULL UNION ALL SELECT 'names to keys', 'COLUMN_TYPE_MISMATCH', NULL UNION ALL SELECT 'itself', 'SELF_RELATIONSHIP', NULL")
def relationship_findings(spark, d):
    t = tables(spark, d)
    m = Model({"customer": t["customer"].filter("c_acctbal > 0"), "orders": t["orders"]})
    cases = {"customer to orders": (("customer", "c_custkey"), ("orders", "o_custkey")), "segments": (("customer", "c_mktsegment"), ("orders", "o_orderpriority")), "names to keys": (("customer", "c_name"), ("orders", "o_custkey")), "itself": (("orders", "o_orderkey"), ("orders", "o_custkey"))}
    rows = [(n, f[0].code, f[0].details.get("unmatched")) for n, (a, b) in cases.items() for f in [m.check_relationship(Relationship(a, b))]]
    return spark.createDataFrame(rows, "relationship string, code string, n long")


# Visuals and the explainer.
CHARTS = {
    "a measure that is missing": (visuals.Visual("kpi", ("Nope",)), "UNKNOWN_MEASURE"), "a bar of text": (visuals.Visual("bar", ("Kind",), ("customer", "c_mktsegment")), "TYPE_MISMATCH"), "a bar without a column": (visuals.Visual("bar", ("Revenue",)), "UNKNOWN_COLUMN"),
    "a line over text": (visuals.Visual("line", ("Revenue",), ("customer", "c_mktsegment")), "TYPE_MISMATCH"), "a line over months": (visuals.Visual("line", ("Revenue",), ("calendar", "Month")), "none"), "a column that is missing": (visuals.Visual("table", ("Revenue",), ("customer", "nope")), "UNKNOWN_COLUMN"),
}


@told("vis_preflight", "visual string, code string", listed("visual, code", [(n, c) for n, (_, c) in CHARTS.items()]))
def vis_preflight(spark, d):
    m = star(spark, d)
    m.measures["Kind"] = '"x"'
    return [(n, code_of(lambda v=v: visuals.preflight(m, v))) for n, (v, _) in CHARTS.items()]


@shaped("vis_truncation", "SELECT 'nations' AS visual, 'VISUAL_HIGH_CARDINALITY' AS code, count(*) AS members, 10::BIGINT AS shown FROM nation UNION ALL SELECT 'customers', 'VISUAL_HIGH_CARDINALITY', count(DISTINCT c_name), 100 FROM customer UNION ALL SELECT 'regions', NULL, NULL, NULL")
def vis_truncation(spark, d):
    m = star(spark, d)
    found = {"nations": visuals.Visual("bar", ("Revenue",), ("nation", "n_name"), limit=10), "customers": visuals.Visual("table", ("Revenue",), ("customer", "c_name")), "regions": visuals.Visual("bar", ("Revenue",), ("region", "r_name"))}
    rows = [(n, x and x.code, x and x.details["members"], x and x.details["shown"]) for n, v in found.items() for x in [visuals.truncated(m, v)]]
    return spark.createDataFrame(rows, "visual string, code string, members long, shown long")


ASIA = {("region", "r_name"): "ASIA"}
ASIA_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"


@shaped("explain_delta", f"SELECT {r2('a')} AS baseline, {r2('b')} AS value, {r2('b - a')} AS absolute, round(b / a - 1, 2) + 0.0 AS relative FROM (SELECT sum(o_totalprice) AS a FROM orders), (SELECT sum(o_totalprice) AS b {ASIA_SQL})")
def explain_delta(spark, d):
    c = explain.analyse(star(spark, d), "[Revenue]", ASIA).comparison
    return spark.createDataFrame([(c.baseline, c.value, c.absolute, c.relative)], "baseline double, value double, absolute double, relative double")


STATES = [("region[r_regionkey]-nation[n_regionkey]", "carries"), ("nation[n_nationkey]-customer[c_nationkey]", "carries"), ("customer[c_custkey]-orders[o_custkey]", "carries"), ("orders[o_orderkey]-lineitem[l_orderkey]", "carries"), ("part[p_partkey]-lineitem[l_partkey]", "idle"), ("supplier[s_suppkey]-lineitem[l_suppkey]", "idle"), ("nation[n_nationkey]-supplier[s_nationkey]", "inactive"), ("calendar[Date]-orders[o_orderdate]", "idle")]
KINDS = [("region", "direct"), ("nation", "propagated"), ("customer", "propagated"), ("supplier", "unfiltered"), ("part", "unfiltered"), ("orders", "propagated"), ("lineitem", "propagated"), ("events", "unfiltered"), ("calendar", "unfiltered")]
told("explain_relationship_states", "relationship string, state string", listed("relationship, state", STATES))(lambda spark, d: list(explain.relationship_states(m := star(spark, d), Context.of(checked(m, ASIA))).items()))
told("explain_table_states", "name string, state string", listed("name, state", KINDS))(lambda spark, d: [(t, explain.state_of(m, t, Context.of(checked(m, ASIA)))) for m in [star(spark, d)] for t in m.tables])


@shaped("explain_narrative", "SELECT 'nation is filtered through its relationships: ' || (SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') || ' of 25 rows (20.0 %) are visible.' AS said")
def explain_narrative(spark, d):
    said = explain.analyse(star(spark, d), "[Orders]", ASIA).narrative()
    return spark.createDataFrame([(x,) for x in said if x.startswith("nation ")], "said string")


# Validation.
def subject(spark, d) -> Subject:
    m = star(spark, d)
    m.add_column("orders", "Twice", "orders[o_totalprice] * 2")
    m.source_keys.update(orders="orders.parquet", region="region.parquet")
    small = [FilterRows([C("r_regionkey", "less-than", 3)]), RemoveDuplicates()]
    return Subject(m, QuerySet(tables(spark, d), [Query("few", "region", small), Query("bad", "region", [RemoveColumns(["x"])])]))


LINK = {"from": ("customer", "c_custkey"), "to": ("orders", "o_custkey")}
BACK = {"from": ("orders", "o_custkey"), "to": ("customer", "c_custkey")}
NAMES = {"table": "region", "column": "r_name"}
CASES = [
    ("relationship, as it is", Rule("relationship", LINK), 1.0, False), ("relationship, the wrong way", Rule("relationship", BACK), 0.0, False), ("relationship, inactive", Rule("relationship", {"from": ("nation", "n_nationkey"), "to": ("supplier", "s_nationkey")}), 0.0, False),
    ("relationship, inactive as asked", Rule("relationship", {"from": ("nation", "n_nationkey"), "to": ("supplier", "s_nationkey"), "active": False}), 1.0, False), ("relationship, a missing column", Rule("relationship", {**LINK, "to": ("orders", "nope")}), 0.0, True), ("relationship, a missing table", Rule("relationship", {**LINK, "to": ("nope", "x")}), 0.0, False),
    ("relationship-config, either order", Rule("relationship-config", {**BACK, "direction": "left-to-right", "active": True}), 1.0, False), ("relationship-config, in part", Rule("relationship-config", {**LINK, "direction": "both", "active": True}), 0.5, False),
    ("model-health", Rule("model-health", {}), 1.0, False), ("model-health, what is forbidden", Rule("model-health", {"forbidden": ["INACTIVE_RELATIONSHIP"]}), 0.0, False),
    ("table-present", Rule("table-present", {"table": "REGION"}), 1.0, False), ("table-present, by its source", Rule("table-present", {"table": {"name": "orders", "source_key": "orders.parquet"}}), 1.0, False), ("table-present, from elsewhere", Rule("table-present", {"table": {"name": "orders", "source_key": "x.csv"}}), 0.0, False),
    ("calculated-column-result", Rule("calculated-column-result", {"table": "orders", "name": "Twice", "cases": [{"key": {"o_orderkey": -1}, "expected": None}]}), 1.0, False), ("calculated-column-result, physical", Rule("calculated-column-result", {"table": "orders", "name": "o_custkey", "cases": []}), 0.0, False),
    ("measure-result", Rule("measure-result", {"measure": "Orders", "cases": [{"filters": {("region", "r_name"): "nowhere"}, "expected": 0, "weight": 3}, {"filters": {("region", "r_name"): "nowhere"}, "expected": 1}]}), 0.75, False), ("measure-result, missing", Rule("measure-result", {"measure": "Nope", "cases": []}), 0.0, False),
    ("expression-semantics", Rule("expression-semantics", {"measure": "Average order", "uses_function": "divide", "references_measure": "Orders", "not_constant_only": True}), 1.0, False), ("expression-semantics, in part", Rule("expression-semantics", {"measure": "Revenue", "uses_function": "SUM", "references_column": ("orders", "o_custkey")}), 0.5, False),
    ("date-table", Rule("date-table", {"table": "calendar", "column": "Date"}), 1.0, False), ("date-table, not marked", Rule("date-table", NAMES), 0.0, False),
    ("query-present", Rule("query-present", {"query": "few"}), 1.0, False), ("query-present, missing", Rule("query-present", {"query": "none"}), 0.0, False), ("query-health", Rule("query-health", {"query": "few"}), 1.0, False), ("query-health, a bad step", Rule("query-health", {"query": "bad"}), 0.0, False),
    ("query-output-schema", Rule("query-output-schema", {"query": "few", "columns": {"r_regionkey": "integer", "r_name": "string"}, "exact": True, "ordered": True}), 1.0, False), ("query-output-schema, in part", Rule("query-output-schema", {"query": "few", "columns": {"r_regionkey": "integer", "x": "string"}}), 0.5, False),
    ("query-output-row-count", Rule("query-output-row-count", {"query": "few", "equals": 3}), 1.0, False), ("query-output-row-count, a range", Rule("query-output-row-count", {"query": "few", "min": 4, "max": 9}), 0.0, False),
    ("query-output-value", Rule("query-output-value", {"query": "few", "key": {"r_regionkey": 2}, "column": "r_regionkey", "expected": 2.001}), 1.0, False), ("query-output-value, no such row", Rule("query-output-value", {"query": "few", "key": {"r_regionkey": 4}, "column": "r_regionkey", "expected": 4}), 0.0, False),
    ("query-step-semantics", Rule("query-step-semantics", {"query": "few", "uses": ["FilterRows", "RemoveDuplicates"], "ordered": True}), 1.0, False), ("query-step-semantics, in another order", Rule("query-step-semantics", {"query": "few", "uses": ["RemoveDuplicates", "FilterRows"], "ordered": True}), 0.0, False),
    ("no such rule", Rule("nothing", {}), 0.0, True), ("a rule without its settings", Rule("query-health", {}), 0.0, True),
]
assert {r.kind for _, r, _, _ in CASES} > set(RULES)


@told("validation_rules", "rule string, share double, config_error boolean", listed("rule, share, config_error", [(n, share, bad) for n, _, share, bad in CASES]))
def validation_rules(spark, d):
    report = validate(subject(spark, d), [r for _, r, _, _ in CASES])
    return [(n, float(o.share), o.config_error) for (n, _, _, _), o in zip(CASES, report.outcomes, strict=True)]


@told("validation_report", "required string, score double, possible double, passed boolean", listed("required, score, possible, passed", [("none", 2.5, 4.0, False), ("one that passes", 2.5, 4.0, True), ("one that fails", 2.5, 4.0, False)]))
def validation_report(spark, d):
    s, rows = subject(spark, d), []
    for n, (first, second) in {"none": (False, False), "one that passes": (True, False), "one that fails": (False, True)}.items():
        r = validate(s, [Rule("table-present", {"table": "region"}, 2, first), Rule("query-output-schema", {"query": "few", "columns": {"r_regionkey": "integer", "x": None, "y": None, "z": None}}, 2, second)])
        rows.append((n, float(r.score), float(r.possible), r.passed))
    return rows


NEAR = [("default", 100.0, 100.005, True), ("default", 100.0, 100.02, False), ("default", 1e9, 1e9 + 900, True), ("absolute 1", 5.0, 6.0, True), ("absolute 1", 5.0, 6.5, False), ("relative 0.1", 100.0, 109.0, True), ("relative 0.1", 100.0, 111.0, False), ("default", None, None, True), ("default", None, 0.0, False)]
told("validation_tolerance", "tolerance string, expected double, found double, close boolean", listed("tolerance, expected, found, close", NEAR))(lambda spark, d: [(n, a, b, {"default": Tolerance(), "absolute 1": Tolerance(1, None), "relative 0.1": Tolerance(None, 0.1)}[n].close(a, b)) for n, a, b, _ in NEAR])


@told("validation_fingerprint", "change string, same boolean", listed("change, same", [("nothing", True), ("a measure", False), ("a rule", False), ("a relationship", False), ("a query's step", False)]))
def validation_fingerprint(spark, d):
    rules, make = [Rule("model-health", {})], lambda: subject(spark, d)
    first, measure, relation, query = fingerprint(make(), rules), make(), make(), make()
    measure.model.add_measure("More", "[Revenue] + 1")
    relation.model.relationships.pop()
    query.queries.queries["few"] = query.queries.queries["few"].removed(1)
    return [("nothing", fingerprint(make(), rules) == first), ("a measure", fingerprint(measure, rules) == first), ("a rule", fingerprint(make(), [*rules, rules[0]]) == first), ("a relationship", fingerprint(relation, rules) == first), ("a query's step", fingerprint(query, rules) == first)]


@told("validation_selectors", "selector string, outcome string", listed("selector, outcome", [("Orders", "orders"), ("orders from orders.parquet", "orders"), ("orders from elsewhere", "VALIDATION_TARGET_NOT_FOUND"), ("twins", "VALIDATION_TARGET_AMBIGUOUS"), ("a twin from a.csv", "Twins"), ("a missing column", "VALIDATION_TARGET_NOT_FOUND")]))
def validation_selectors(spark, d):
    from .plans.validation import target_column, target_table

    t = tables(spark, d)
    m = Model({"orders": t["orders"], "twins": t["region"], "Twins": t["nation"]}, source_keys={"orders": "orders.parquet", "twins": "b.csv", "Twins": "a.csv"})
    cases = {"Orders": "Orders", "orders from orders.parquet": {"name": "orders", "source_key": "orders.parquet"}, "orders from elsewhere": {"name": "orders", "source_key": "x"}, "twins": "TWINS", "a twin from a.csv": {"name": "twins", "source_key": "a.csv"}}

    def outcome(run):
        try:
            return run()
        except EngineError as e:
            return e.code

    return [*[(n, outcome(lambda s=s: target_table(m, s))) for n, s in cases.items()], ("a missing column", outcome(lambda: target_column(m, ("orders", "x"))))]


# Workspaces.
def workspace(spark, d) -> Workspace:
    t = tables(spark, d)
    few = Query("few", "orders", [FilterRows([C("o_totalprice", "greater-than", 100000)]), GroupBy(["o_orderpriority"], [Aggregation("n", "n", "count-rows")])])
    ws = Workspace({n: t[n] for n in ("orders", "customer")}, {"few": few, "again": Query("again", "few")}, {})
    m = Model({n: t[n] for n in ("orders", "customer")}, [Relationship(("customer", "c_custkey"), ("orders", "o_custkey"))], {"Total": "SUM(orders[o_totalprice])", "Twice": "[Total] * 2", "People": "COUNTROWS(customer)"}, {("orders", "Net"): "orders[o_totalprice] * 0.9"}, {}, {}, {"orders": "orders.parquet"})
    ws.models["m"] = m
    return ws


IMPACTS = [
    ("dataset", "orders", "restrict", "model m, query few", False), ("query", "few", "restrict", "query again", False), ("query", "again", "restrict", "", True), ("disable-load", "few", "restrict", "", True), ("model", "m", "cascade", "measure People, measure Total, measure Twice", True),
    ("model-table", "orders", "cascade", "measure Total, relationship customer[c_custkey]-orders[o_custkey]", True), ("measure", "Total", "restrict", "measure Twice", False), ("measure", "People", "restrict", "", True), ("calculated-column", "orders.Net", "restrict", "", True),
]


@told("workspace_impact", "kind string, name string, policy string, dependents string, allowed boolean", listed("kind, name, policy, dependents, allowed", IMPACTS))
def workspace_impact(spark, d):
    ws, rows = workspace(spark, d), []
    for kind, name, *_ in IMPACTS:
        i = ws.impact(kind, name, "m")
        rows.append((kind, name, i.policy, ", ".join(sorted(i.dependents)), i.allowed))
    return rows


@shaped("notebook_cells", "SELECT 'all' AS filters, " + r2("sum(o_totalprice)") + " AS total, count(DISTINCT o_custkey) AS people FROM orders UNION ALL SELECT 'urgent', " + r2("sum(o_totalprice)") + ", count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT 'cleared', " + r2("sum(o_totalprice)") + ", count(DISTINCT o_custkey) FROM orders")
def notebook_cells(spark, d):
    """Two cells under a notebook's filters: none, a slicer's selection, none again."""
    book = Notebook(workspace(spark, d), "m", {"total": Cell("measure", "[Total]"), "people": Cell("measure", "DISTINCTCOUNT(orders[o_custkey])")})
    urgent = [r[0] for r in tables(spark, d)["orders"].filter("o_orderpriority LIKE '1%'").select("o_orderpriority").distinct().collect()]
    parts = []
    for name, chosen in (("all", []), ("urgent", urgent), ("cleared", [])):
        book.choose(("orders", "o_orderpriority"), chosen)
        total, people = (book.result(n).withColumnRenamed("value", n) for n in ("total", "people"))
        parts.append(total.crossJoin(people).select(F.lit(name).alias("filters"), "total", "people"))  # one row each
    return parts[0].union(parts[1]).union(parts[2])


@told("workspace_dependents", "name string, dependent string", listed("name, dependent", [("o_totalprice", "measure Total"), ("o_totalprice", "calculated column orders[Net]")]))
def workspace_dependents(spark, d):
    m = workspace(spark, d).models["m"]
    return [(c, x) for c in ("o_totalprice", "o_custkey") for x in column_dependents(m, "orders", c)]


@told("workspace_dangling", "broken string, n int", listed("broken, n", [("nothing", 0), ("a table of a query", 2), ("a measure's column", 1), ("a relationship's column", 1)]))
def workspace_dangling(spark, d):
    made = [workspace(spark, d) for _ in range(4)]
    made[1].tables.pop("orders")
    made[2].models["m"].measures["Total"] = "SUM(orders[nope])"
    made[3].models["m"].relationships[0] = Relationship(("customer", "nope"), ("orders", "o_custkey"))
    return list(zip(("nothing", "a table of a query", "a measure's column", "a relationship's column"), [len(w.dangling()) for w in made], strict=True))


@shaped("bundle_round_trip", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def bundle_round_trip(spark, d):
    """A workspace with its raw tables, written, opened again, and its query evaluated there."""
    path = scratch_path(spark, "bundle")
    workspace(spark, d).export_bundle(path)
    again = Workspace.open_bundle(spark, path)
    assert again.models["m"].source_keys == {"orders": "orders.parquet"} and again.dangling() == []
    return again.query_set().evaluate("again").df()


BUNDLES = {"no JSON": ("{", "invalid-json"), "another file": ("{}", "not-a-project"), "no queries": ('{"format": "loomquery-workspace", "version": 1, "sources": {}, "models": {}}', "structurally-invalid"), "a later version": ('{"format": "loomquery-workspace", "version": 99, "sources": {}, "queries": {}, "models": {}}', "unsupported-schema-version"), "empty": ('{"format": "loomquery-workspace", "version": 1, "sources": {}, "queries": {}, "models": {}}', "none")}
told("bundle_errors", "bundle string, code string", listed("bundle, code", [(n, c) for n, (_, c) in BUNDLES.items()]))(lambda spark, d: [(n, code_of(lambda text=text: definition_of(text) and None)) for n, (text, _) in BUNDLES.items()])


@told("query_loading", "query string, code string", listed("query, code", [("loaded", "none"), ("not loaded", "QUERY_NOT_LOADED"), ("missing", "QUERY_SOURCE_NOT_FOUND")]))
def query_loading(spark, d):
    q = QuerySet(tables(spark, d), [Query("loaded", "region"), Query("not loaded", "region", load=False)])
    return [(n, code_of(lambda n=n: q.table(n) and None)) for n in ("loaded", "not loaded", "missing")]
