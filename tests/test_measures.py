"""Measures over small tables with hand-computed values."""

from __future__ import annotations

import datetime as dt

import pytest

from loomquery.diagnostics import EngineError
from loomquery.plans import measures as m
from loomquery.plans.model import MANY_MANY, ONE_ONE, Model, Relationship

SPAIN, FRANCE = {("Customers", "Country"): "Spain"}, {("Customers", "Country"): "France"}


@pytest.fixture(scope="module")
def retail(spark):
    customers = spark.createDataFrame([(1, "Spain", "Premium"), (2, "France", "Standard"), (3, "Spain", "Standard")], "CustomerID long, Country string, Segment string")
    products = spark.createDataFrame([(1, "Furniture", 100.0), (2, "Electronics", 50.0)], "ProductID long, Category string, UnitPrice double")
    rows = [(1, 1, 1, 100.0, 60.0, 1), (2, 2, 2, 200.0, 150.0, 2), (3, 3, 1, 50.0, 40.0, 1), (4, 1, 2, None, None, None)]
    sales = spark.createDataFrame(rows, "OrderID long, CustomerID long, ProductID long, Revenue double, Cost double, Quantity long")
    model = Model({"Customers": customers, "Products": products, "Sales": sales}, [Relationship(("Customers", "CustomerID"), ("Sales", "CustomerID")), Relationship(("Products", "ProductID"), ("Sales", "ProductID"))])
    model.add_measure("Total Revenue", "SUM(Sales[Revenue])")
    return model


CASES = [
    ("2 + 3 * 4", None, 14), ("(2 + 3) * 4", None, 20), ("-2 + 5", None, 3), ("10 / 4", None, 2.5), ("5 = 5", None, True), ("5 > 10", None, False), ('"Spain" = "Spain"', None, True), ("(1 = 1) && (2 = 3)", None, False),
    ("1 / 0", None, None), ("BLANK() + 5", None, None), ("BLANK() = BLANK()", None, True), ("BLANK() < 1", None, False), ('"1" = 1', None, False),
    ("SUM(Sales[Revenue])", None, 350), ("SUM(Sales[Cost])", None, 250), ("AVERAGE(Sales[Revenue])", None, 350 / 3), ("AVERAGE(Sales[Cost])", None, 250 / 3), ("MIN(Sales[Revenue])", None, 50), ("MAX(Sales[Revenue])", None, 200),
    ("COUNT(Sales[Revenue])", None, 3), ("DISTINCTCOUNT(Sales[CustomerID])", None, 3), ("DISTINCTCOUNT(Sales[ProductID])", None, 2), ("DISTINCTCOUNT(Sales[Quantity])", None, 2),
    ("DIVIDE(10, 0)", None, None), ("DIVIDE(10, 0, -1)", None, -1), ("DIVIDE(BLANK(), 5)", None, None), ("ISBLANK(BLANK())", None, True), ("ISBLANK(1)", None, False),
    ("VAR r = SUM(Sales[Revenue]) RETURN r", None, 350), ('VAR r = SUM(Sales[Revenue]) RETURN CALCULATE(r, Customers[Country] = "Spain")', None, 350), ("VAR a = SUM(Sales[Revenue]) VAR b = SUM(Sales[Cost]) RETURN DIVIDE(A - B, A)", None, 100 / 350),
    ("SUM(Sales[Revenue])", SPAIN, 150), ("SUM(Sales[Revenue])", FRANCE, 200), ("SUM(Sales[Cost])", SPAIN, 100), ("SUM(Sales[Revenue])", {("Customers", "Country"): ["Spain", "France"]}, 350), ("COUNTROWS(Sales)", SPAIN, 3),
    ("SUM(Sales[Revenue])", {("Customers", "Country"): []}, None), ("COUNTROWS(Sales)", {("Customers", "Country"): "Nowhere"}, 0), ("COUNTROWS(Customers)", {("Sales", "OrderID"): 1}, 3),
    ('SELECTEDVALUE(Customers[Country], "Multiple")', None, "Multiple"), ('SELECTEDVALUE(Customers[Country], "Multiple")', SPAIN, "Spain"), ("SELECTEDVALUE(Customers[Country])", None, None), ("HASONEVALUE(Customers[Country])", None, False), ("HASONEVALUE(Customers[Country])", SPAIN, True),
    ("HASONEVALUE(Sales[Revenue])", {("Sales", "OrderID"): 4}, True),
    ('CALCULATE(SUM(Sales[Revenue]), Customers[Country] = "France")', SPAIN, 200), ("CALCULATE(SUM(Sales[Revenue]), REMOVEFILTERS(Customers))", SPAIN, 350), ("CALCULATE(SUM(Sales[Revenue]), ALL(Customers[Country]))", SPAIN, 350), ("CALCULATE(SUM(Sales[Revenue]), REMOVEFILTERS())", SPAIN, 350),
    ("CALCULATE(SUM(Sales[Revenue]), FILTER(Sales, Sales[Revenue] > 60))", None, 300), ("CALCULATE(SUM(Sales[Revenue]), FILTER(Products, Products[UnitPrice] > 60))", None, 150), ("CALCULATE(SUM(Sales[Revenue]), FILTER(FILTER(Sales, Sales[Revenue] > 60), Sales[Cost] < 100))", None, 100),
    ('CALCULATE(SUM(Sales[Revenue]), KEEPFILTERS(Customers[Country] = "Spain"))', SPAIN, 150), ('CALCULATE(SUM(Sales[Revenue]), KEEPFILTERS(Customers[Country] = "Spain"))', FRANCE, None), ('CALCULATE([Total Revenue], Customers[Country] = "Germany")', None, None),
    ("CALCULATE([Total Revenue], REMOVEFILTERS(Customers), Sales[Quantity] > 0)", SPAIN, 150), ("CALCULATE(CALCULATE([Total Revenue], Sales[Quantity] = 2), Sales[Quantity] > 1)", None, 200), ("CALCULATE(CALCULATE([Total Revenue], Sales[Quantity] = 1), Sales[Quantity] > 1)", None, 150),
    ("CALCULATE([Total Revenue], Sales[Quantity] > 0, Sales[Quantity] < 2)", None, 150), ("CALCULATE(COUNTROWS(Sales), Sales[Revenue] = BLANK())", None, 1),
    ('IF([Total Revenue] > 100, "High", "Low")', None, "High"), ("IF(1 > 2, 5)", None, None), ('SWITCH(TRUE(), [Total Revenue] > 300, "Big", "Small")', None, "Big"), ("SWITCH(2, 1, 10, 2, 20, 30)", None, 20), ("SWITCH(BLANK(), BLANK(), 1, 2)", None, 1),
    ("SUMX(Sales, Sales[Revenue] - Sales[Cost])", None, 100), ("AVERAGEX(Sales, Sales[Revenue] - Sales[Cost])", None, 100 / 3), ("MINX(Sales, Sales[Revenue] - Sales[Cost])", None, 10), ("MAXX(Sales, Sales[Revenue] - Sales[Cost])", None, 50), ("COUNTX(Sales, Sales[Revenue])", None, 3),
    ("SUMX(Products, [Total Revenue])", None, 350), ("SUMX(VALUES(Customers[Country]), [Total Revenue])", None, 350), ("MAXX(Customers, [Total Revenue])", SPAIN, 100), ("SUMX(Sales, Sales[Quantity] * RELATED(Products[UnitPrice]))", None, 300), ("SUMX(FILTER(Sales, Sales[Revenue] > 60), [Total Revenue])", None, 300),
    ("COUNTROWS(VALUES(Customers[Country]))", None, 2), ("COUNTROWS(DISTINCT(Sales[Revenue]))", None, 4), ("COUNTROWS(FILTER(Sales, Sales[Revenue] >= 100))", None, 2), ("MINX(Customers, Customers[Country])", None, "France"),
]


def test_values(retail):
    """All cases as columns of a plan each, so that the session's overhead is paid once a filter."""
    by_filter = {}
    for n, (text, filters, want) in enumerate(CASES):
        by_filter.setdefault(str(filters), (filters, []))[1].append((f"v{n}", text, want))
    for filters, cases in by_filter.values():
        row = m.evaluate(retail, {n: text for n, text, _ in cases}, filters).first()
        for n, text, want in cases:
            got = row[n]
            assert got == want or isinstance(want, (int, float)) and not isinstance(want, bool) and got is not None and abs(got - want) < 1e-9, (text, filters, got, want)


ERRORS = [
    ("1 +", "SYNTAX_ERROR"), ("SUM(Nope[x])", "UNKNOWN_TABLE"), ("SUM(Sales[Nope])", "UNKNOWN_COLUMN"), ("[Nope]", "UNKNOWN_MEASURE"), ("Sales[Revenue]", "COLUMN_REQUIRES_AGGREGATION"), ("Sales", "BARE_TABLE_REFERENCE"),
    ("SUM(Customers[Country])", "NON_NUMERIC_AGGREGATION"), ("MAX(Customers[Country])", "NON_NUMERIC_AGGREGATION"), ("SUM(1)", "INVALID_AGGREGATION_ARGUMENT"), ("RANKX(Sales, 1)", "UNSUPPORTED_FUNCTION"), ("ALLEXCEPT(Sales)", "UNSUPPORTED_FUNCTION"),
    ("RELATED(Products[Category])", "RELATED_REQUIRES_ROW_CONTEXT"), ('"a" + 1', "TYPE_MISMATCH"), ("IF(1, 2)", "IF_CONDITION_NOT_BOOLEAN"), ("IF(1 = 1)", "IF_INVALID_ARITY"), ("SWITCH(1)", "INVALID_SWITCH_ARGUMENT"),
    ("CALCULATE()", "INVALID_CALCULATE_ARITY"), ("CALCULATE(1, 5)", "CALCULATE_INVALID_FILTER_ARGUMENT"), ("CALCULATE(1, TRUE)", "CALCULATE_INVALID_FILTER_ARGUMENT"), ("CALCULATE(1, Sales[Quantity] > Products[UnitPrice])", "BOOLEAN_FILTER_MULTIPLE_TABLES"),
    ("CALCULATE(1, [Total Revenue] > 5)", "BOOLEAN_FILTER_MEASURE_REFERENCE"), ("CALCULATE(1, KEEPFILTERS(Sales[Quantity] > 5))", "UNSUPPORTED_KEEPFILTERS_SHAPE"), ("ALL(Sales)", "INVALID_ALL_ARGUMENT"), ("VALUES(Sales[Quantity])", "INVALID_TABLE_EXPRESSION_ARGUMENT"),
    ("USERELATIONSHIP(Sales[Quantity], Sales[Cost])", "USERELATIONSHIP_INVALID_CONTEXT"), ("CALCULATE(1, USERELATIONSHIP(Sales[Quantity], Products[ProductID]))", "USERELATIONSHIP_RELATIONSHIP_NOT_FOUND"), ("CALCULATE(1, CROSSFILTER(Products[ProductID], Sales[ProductID], SIDEWAYS))", "CROSSFILTER_INVALID_DIRECTION"),
    ("SUMX(5, 1)", "ITERATOR_TABLE_REQUIRED"), ("SUMX(Sales)", "INVALID_ITERATOR_ARGUMENT"), ("SUMX(Sales, Products[UnitPrice])", "ITERATOR_ROW_SCOPE_VIOLATION"), ('SUMX(Sales, "x")', "ITERATOR_EXPRESSION_TYPE_ERROR"), ("SUMX(Sales, VAR x = 1 RETURN x)", "ITERATOR_ROW_SCOPE_VIOLATION"),
    ("SUMX(Sales, CALCULATE(1))", "ITERATOR_CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED"), ("VAR x = 1 VAR x = 2 RETURN x", "DUPLICATE_VARIABLE"), ("VAR a = b VAR b = 1 RETURN a", "FORWARD_VARIABLE_REFERENCE"), ("VAR t = VALUES(Sales[Quantity]) RETURN 1", "TABLE_VARIABLE_NOT_SUPPORTED"), ("nothing", "UNKNOWN_VARIABLE"),
    ("CALCULATE(1, DATESYTD(Sales[OrderID]))", "DATE_TABLE_REQUIRED"), ("SELECTEDVALUE(1)", "SELECTEDVALUE_INVALID_ARGUMENT"), ("COUNTROWS(1)", "INVALID_TABLE_EXPRESSION_ARGUMENT"),
]


@pytest.mark.parametrize("text, code", ERRORS)
def test_errors(retail, text, code):
    with pytest.raises(EngineError) as e:
        m.evaluate(retail, {"v": text})
    assert e.value.code == code


def test_row_errors_are_data(retail):
    row = m.evaluate(retail, {"v": "SUMX(Sales, 1 / (Sales[Quantity] - 1))"}).first()
    assert row["v"] is None and row["v__error"] == "DIVISION_ERROR"


def test_measure_cycle(spark, retail):
    model = Model(retail.tables, [], {"a": "[b]", "b": "VAR x = [a] RETURN x"})
    with pytest.raises(EngineError, match="MEASURE_DEPENDENCY_CYCLE"):
        m.check_measure(model, "a")


def test_grouping_lists_every_member(retail):
    rows = {r["member"]: r for r in m.grouped(retail, ("Customers", "Country"), {"rev": "[Total Revenue]", "share": "DIVIDE([Total Revenue], CALCULATE([Total Revenue], ALL(Customers)))", "n": "COUNTROWS(Sales)"}, SPAIN).collect()}
    assert rows["Spain"]["rev"] == 150 and rows["France"]["rev"] is None and rows["France"]["n"] == 0
    assert abs(rows["Spain"]["share"] - 150 / 350) < 1e-9


@pytest.mark.parametrize("text", ["[Total Revenue]", "COUNTROWS(Sales)", "CALCULATE([Total Revenue], Sales[Quantity] > 1)", "CALCULATE([Total Revenue], FILTER(Customers, Customers[CustomerID] < 3))", "MAXX(Customers, [Total Revenue])", "CALCULATE(MAXX(Products, [Total Revenue]), Sales[Quantity] < 2)", "SUMX(VALUES(Products[Category]), [Total Revenue])"])
def test_grouping_equals_member_by_member(retail, text):
    """The one plan for all members gives what a plan for each member gives."""
    for dimension in (("Customers", "Country"), ("Products", "Category"), ("Sales", "Quantity")):
        for r in m.grouped(retail, dimension, {"v": text}).collect():
            assert m.evaluate(retail, {"v": text}, {dimension: r["member"]}).first()["v"] == r["v"], (text, dimension, r)


@pytest.mark.parametrize(("text", "crossed"), [("SUMX(Customers, [Total Revenue])", False), ("AVERAGEX(Products, Products[UnitPrice] * [Total Revenue] - 1)", False), ("COUNTX(Customers, -[Total Revenue])", False), ("SUMX(Customers, [Rows])", True), ("SUMX(Customers, IF([Total Revenue] > 60, 1, 2))", True), ("MAXX(Customers, [Total Revenue] + [Most])", False)])
def test_members_that_do_not_filter_the_rows(retail, text, crossed):
    """Rows meet a member by the measure's own rows, unless a row counts without any."""
    model = Model(retail.tables, retail.relationships, {**retail.measures, "Rows": "COUNTROWS(Sales)", "Most": "MAX(Sales[Cost])"})
    df = m.grouped(model, ("Sales", "Quantity"), {"v": text})
    assert ("Join Cross" in df._jdf.queryExecution().analyzed().toString()) == crossed
    for r in df.collect():
        assert m.evaluate(model, {"v": text}, {("Sales", "Quantity"): r["member"]}).first()["v"] == r["v"], (text, r)


@pytest.mark.parametrize("inner", ["CALCULATE([Total Revenue], REMOVEFILTERS(Customers[CustomerID]))", "CALCULATE([Total Revenue], Customers[CustomerID] = 1)", "CALCULATE([Total Revenue], ALL(Customers[Segment]))", "CALCULATE([Total Revenue], Customers[CustomerID] < 3)", "CALCULATE([Total Revenue], ALL(Customers))", "[Total Revenue] + 1"])
def test_a_key_stands_for_all_columns(retail, inner):
    """A row's filters are those of all its columns, whether or not the model knows a key."""
    plain = Model(retail.tables, retail.relationships, {**retail.measures, "Inner": inner, "Outer": "[Inner] * 2"})
    keyed = Model(retail.tables, retail.relationships, dict(plain.measures), keys={"Customers": "CustomerID"})
    for text in ("SUMX(Customers, [Outer])", "COUNTX(Customers, [Inner])"):
        assert m.evaluate(keyed, {"v": text}).first()["v"] == m.evaluate(plain, {"v": text}).first()["v"], text


def test_calculated_columns(retail):
    rows = m.calculated_column(retail, "Sales", 'IF(RELATED(Products[Category]) = "Furniture", Sales[Revenue] - [Cost], 1 / 0)', "x").orderBy("OrderID").collect()
    assert [(r["x"], r["x__error"]) for r in rows] == [(40, None), (None, "DIVISION_ERROR"), (10, None), (None, "DIVISION_ERROR")]
    for text, code in (("Products[Category]", "COLUMN_OUTSIDE_ROW_CONTEXT"), ("CALCULATE(1)", "CALCULATE_CONTEXT_TRANSITION_NOT_SUPPORTED"), ("RELATED(Customers[Nope])", "UNKNOWN_COLUMN"), ("SUM(Sales[Revenue])", "UNSUPPORTED_FUNCTION")):
        with pytest.raises(EngineError) as e:
            m.calculated_value(retail, "Sales", text)
        assert e.value.code == code
    with pytest.raises(EngineError) as e:
        m.calculated_value(retail, "Products", "RELATED(Sales[Revenue])")
    assert e.value.code == "RELATED_WRONG_DIRECTION"


# Dates.
@pytest.fixture(scope="module")
def dated(spark):
    first = dt.date(2024, 1, 1)
    days = [(first + dt.timedelta(i), (first + dt.timedelta(i)).year, (first + dt.timedelta(i)).month) for i in range(731)]
    calendar = spark.createDataFrame(days, "Date date, Year int, MonthNumber int")
    rows = [("2024-03-05", 100), ("2024-03-20", 200), ("2025-03-05", 150), ("2025-03-20", 250), ("2025-02-10", 80), ("2025-02-15", 90), ("2025-01-05", 60), ("2025-04-01", 70), ("2024-01-10", 40)]
    sales = spark.createDataFrame([(dt.date.fromisoformat(d), float(v)) for d, v in rows], "Date date, Revenue double")
    return Model({"Calendar": calendar, "Sales": sales}, [Relationship(("Calendar", "Date"), ("Sales", "Date"))], {"Rev": "SUM(Sales[Revenue])"}, {}, {"Calendar": "Date"})


YEAR, MARCH = {("Calendar", "Year"): 2025}, {("Calendar", "Year"): 2025, ("Calendar", "MonthNumber"): 3}


@pytest.mark.parametrize(
    "text, filters, want",
    [
        ("CALCULATE([Rev], SAMEPERIODLASTYEAR(Calendar[Date]))", YEAR, 340), ("CALCULATE([Rev], SAMEPERIODLASTYEAR(Calendar[Date]))", MARCH, 300), ("CALCULATE([Rev], PREVIOUSYEAR(Calendar[Date]))", YEAR, 340), ("CALCULATE([Rev], PREVIOUSMONTH(Calendar[Date]))", MARCH, 170),
        ("CALCULATE([Rev], DATESYTD(Calendar[Date]))", {("Calendar", "Date"): "2025-04-01"}, 700), ("TOTALYTD([Rev], Calendar[Date])", {("Calendar", "Date"): "2025-04-01"}, 700), ("CALCULATE([Rev], DATEADD(Calendar[Date], -1, MONTH))", MARCH, 170), ("CALCULATE([Rev], DATEADD(Calendar[Date], -1, QUARTER))", {("Calendar", "Year"): 2025, ("Calendar", "MonthNumber"): 4}, 60),
        ("CALCULATE([Rev], DATEADD(Calendar[Date], -1, YEAR))", YEAR, 340), ("CALCULATE([Rev], DATEADD(Calendar[Date], 1, DAY))", {("Calendar", "Date"): "2025-03-04"}, 150), ("CALCULATE([Rev], PREVIOUSMONTH(Calendar[Date]))", {("Calendar", "Year"): 1999}, None), ("COUNTROWS(DATESYTD(Calendar[Date]))", {("Calendar", "Date"): "2025-02-01"}, 32),
        ("CALCULATE([Rev], DATEADD(Calendar[Date], 1, MONTH))", {("Calendar", "Date"): ["2025-01-01", "2025-01-03"]}, None),
    ],
)
def test_dates(dated, text, filters, want):
    row = m.evaluate(dated, {"v": text}, filters).first()
    assert row["v"] == want
    if "2025-01-03" in str(filters):
        assert row["v__error"] == "DATEADD_NON_CONTIGUOUS_CONTEXT"


def test_date_errors(dated):
    for text, code in (("CALCULATE([Rev], DATEADD(Calendar[Date], 1.5, DAY))", "DATEADD_INTERVAL_COUNT_INVALID"), ("CALCULATE([Rev], DATEADD(Calendar[Date], 1, WEEK))", "DATEADD_INVALID_INTERVAL"), ("TOTALYTD([Rev])", "TOTALYTD_INVALID_ARGUMENT"), ("SUMX(DATESYTD(Calendar[Date]), 1)", "ITERATOR_UNSUPPORTED_TABLE_EXPRESSION")):
        with pytest.raises(EngineError) as e:
            m.evaluate(dated, {"v": text})
        assert e.value.code == code


def test_date_table_checks(spark, dated):
    assert dated.check_date_table("Calendar", "Date") == []
    odd = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 1),), (dt.date(2024, 1, 4),), (None,)], "d date")
    model = Model({"odd": odd})
    assert {d.code for d in model.check_date_table("odd", "d")} == {"DATE_TABLE_DATE_NOT_UNIQUE", "DATE_TABLE_DATE_HAS_BLANKS", "DATE_TABLE_NOT_CONTIGUOUS"}


# Relationships.
def test_one_to_one_both_ways(spark):
    a = spark.createDataFrame([(1,), (2,)], "EmployeeID long")
    b = spark.createDataFrame([(1, 10), (2, 20)], "EmployeeID long, AccessCount long")
    model = Model({"Employees": a, "Badges": b}, [Relationship(("Employees", "EmployeeID"), ("Badges", "EmployeeID"), ONE_ONE, "both")])
    assert m.evaluate(model, {"v": "SUM(Badges[AccessCount])"}, {("Employees", "EmployeeID"): 1}).first()["v"] == 10
    assert m.evaluate(model, {"v": "COUNTROWS(Employees)"}, {("Badges", "AccessCount"): 20}).first()["v"] == 1


def test_many_to_many(spark):
    p = spark.createDataFrame([(1, "Electronics"), (2, "Electronics"), (3, "Furniture")], "ProductID long, Category string")
    t = spark.createDataFrame([("North", "Electronics", 500), ("South", "Electronics", 300), ("North", "Furniture", 200), ("East", "Office", 999)], "Region string, Category string, Amount long")
    model = Model({"Products": p, "Targets": t}, [Relationship(("Products", "Category"), ("Targets", "Category"), MANY_MANY, "left-to-right")])
    assert m.evaluate(model, {"v": "SUM(Targets[Amount])"}, {("Products", "Category"): "Electronics"}).first()["v"] == 800
    got = {r["member"]: r["v"] for r in m.grouped(model, ("Products", "Category"), {"v": "SUM(Targets[Amount])"}).collect()}
    assert got == {"Electronics": 800, "Furniture": 200}
    assert m.evaluate(model, {"v": "SUM(Targets[Amount])"}).first()["v"] == 1999  # nothing filters: orphans stay


def test_roles_and_overrides(spark):
    regions = spark.createDataFrame([(1,), (2,)], "RegionID long")
    sales = spark.createDataFrame([(1, 1, 2, 100), (2, 2, 1, 200)], "OrderID long, Bill long, Ship long, Revenue long")
    model = Model({"Regions": regions, "Sales": sales}, [Relationship(("Regions", "RegionID"), ("Sales", "Bill")), Relationship(("Regions", "RegionID"), ("Sales", "Ship"), active=False)])
    one = {("Regions", "RegionID"): 1}
    for text, want in (("SUM(Sales[Revenue])", 100), ("CALCULATE(SUM(Sales[Revenue]), USERELATIONSHIP(Sales[Ship], Regions[RegionID]))", 200), ("CALCULATE(SUM(Sales[Revenue]), CROSSFILTER(Regions[RegionID], Sales[Bill], NONE))", 300), ("SUM(Sales[Revenue]) + CALCULATE(SUM(Sales[Revenue]), USERELATIONSHIP(Sales[Ship], Regions[RegionID]))", 300)):
        assert m.evaluate(model, {"v": text}, one).first()["v"] == want, text
    assert m.evaluate(model, {"v": "COUNTROWS(Regions)"}, {("Sales", "OrderID"): 1}).first()["v"] == 2
    assert m.evaluate(model, {"v": "CALCULATE(COUNTROWS(Regions), CROSSFILTER(Regions[RegionID], Sales[Bill], BOTH))"}, {("Sales", "OrderID"): 1}).first()["v"] == 1


def test_two_hops_both_ways(spark):
    """A filter goes up one arm of a bidirectional chain and down another."""
    a = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    b = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, k long")
    c = spark.createDataFrame([(1, 1, 5), (2, 2, 7), (3, 3, 9), (4, None, 1)], "n long, id long, v long")
    model = Model({"a": a, "b": b, "c": c}, [Relationship(("a", "k"), ("b", "k"), direction="both"), Relationship(("b", "id"), ("c", "id"), direction="both")])
    assert m.evaluate(model, {"v": "COUNTROWS(a)"}, {("c", "n"): [1, 2]}).first()["v"] == 1
    assert m.evaluate(model, {"v": "SUM(c[v])"}, {("a", "k"): 1}).first()["v"] == 12
    assert m.evaluate(model, {"v": "COUNTROWS(b)"}, {("c", "n"): 1, ("a", "k"): 1}).first()["v"] == 1
    got = {r["member"]: r["v"] for r in m.grouped(model, ("c", "n"), {"v": "COUNTROWS(a)"}).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_ambiguous_model_fails(spark):
    t = spark.createDataFrame([(1,)], "k long")
    model = Model({"a": t, "b": t, "c": t}, [Relationship(("a", "k"), ("b", "k")), Relationship(("b", "k"), ("c", "k")), Relationship(("a", "k"), ("c", "k"))])
    assert model.ambiguous() == ("a", "c")
    with pytest.raises(EngineError, match="FILTER_GRAPH_INVALID"):
        m.evaluate(model, {"v": "COUNTROWS(c)"})


def test_relationship_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, s string")
    b = spark.createDataFrame([(1,), (9,), (None,)], "k long")
    model = Model({"a": a, "b": b})
    codes = lambda r: {d.code for d in model.check_relationship(r)}
    assert "ONE_SIDE_NOT_UNIQUE" in codes(Relationship(("a", "k"), ("b", "k")))
    assert codes(Relationship(("b", "k"), ("a", "k"))) == {"UNMATCHED_FOREIGN_KEYS"}
    assert "COLUMN_TYPE_MISMATCH" in codes(Relationship(("a", "s"), ("b", "k")))
    assert "SELF_RELATIONSHIP" in codes(Relationship(("a", "k"), ("a", "k")))
    assert "ONE_TO_ONE_REQUIRES_BOTH" in codes(Relationship(("b", "k"), ("a", "k"), ONE_ONE))
    assert "INVALID_CROSS_FILTER_DIRECTION" in codes(Relationship(("b", "k"), ("a", "k"), direction="right-to-left"))
    assert "MISSING_REFERENCE" in codes(Relationship(("b", "nope"), ("a", "k")))
    model.add_relationship(Relationship(("b", "k"), ("a", "k")))
    assert "DUPLICATE_RELATIONSHIP" in codes(Relationship(("b", "k"), ("a", "k")))
    assert {d.code for d in model.findings()} == {"STAR_SCHEMA_VALID"}
