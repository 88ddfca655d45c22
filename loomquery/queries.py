"""The engine's operators as queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, MutableMapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sources
from .operators.steps import (
    Aggregation,
    AppendQueries,
    ChangeType,
    Condition,
    ConditionalColumn,
    CustomColumn,
    Fill,
    FilterRows,
    GroupBy,
    IndexColumn,
    MergeColumns,
    MergeQueries,
    PivotColumn,
    RemoveColumns,
    RemoveDuplicates,
    RenameColumns,
    ReorderColumns,
    ReplaceValues,
    SortRows,
    SplitColumn,
    Step,
    UnpivotColumns,
)
from .plans import explain, visuals
from .plans.measures import calculated_column, evaluate, grouped
from .plans.model import MANY_MANY, ONE_ONE, Model, Relationship
from .plans.pipeline import Query, QuerySet
from .streaming import stream_steps

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that doesn't change its schema: it is inferred, which takes a job, the first time only."""
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


class Lazy(MutableMapping):
    """Tables that are made when they are first asked for: a query builds the plans of those it reads."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self.makers, self.made = dict(makers), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name]()
        return self.made[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.makers[name] = lambda: df
        self.made.pop(name, None)

    def __delitem__(self, name: str) -> None:
        del self.makers[name]
        self.made.pop(name, None)

    def __iter__(self):
        return iter(self.makers)

    def __len__(self) -> int:
        return len(self.makers)


def tables(spark: SparkSession, d: str) -> Lazy:
    return Lazy({t: (lambda t=t: read(spark, f"{d}/{t}.parquet")) for t in TABLES})


def tidy(df: DataFrame, digits: int = 2) -> DataFrame:
    """Fractions rounded, so that the order of a sum doesn't show; times to dates as text."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    shape = {"double": lambda c: F.round(c, digits) + 0.0, "timestamp_ntz": day, "timestamp": day, "date": day, "int": lambda c: c.cast("bigint")}
    return df.select(*[shape[k](F.col(f"`{c}`")).alias(c) if k in shape else F.col(f"`{c}`") for c, k in df.dtypes if not c.endswith("__error")])


def r2(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 2) + 0.0"


# Data preparation.
def steps(name: str, source: str, chain: list[Step], sql: str | None, others: list[Query] | None = None, digits: int = 2) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        queries = [*(others or []), Query(name, source, chain)]
        e = QuerySet(tables(spark, d), queries, check="lazy").evaluate(name)
        return tidy(e.df(), digits)

    FOUND[name] = (run, sql)


def gappy(divisor: int, column: str) -> CustomColumn:
    """A column with blanks: the driver's tables have none."""
    return CustomColumn("gap", "gap", f"if [{column}] / {divisor} = Number.Round([{column}] / {divisor}) then null else [{column}]")


GAP = "CASE WHEN {0} % {1} = 0 THEN NULL ELSE {0} END"
C = Condition
steps("pq_rename_remove_reorder", "customer", [RenameColumns({"c_name": "Customer", "c_acctbal": "Balance"}), RemoveColumns(["c_nationkey"]), ReorderColumns(["c_mktsegment", "c_acctbal"])], f"SELECT c_mktsegment, {r2('c_acctbal')} AS Balance, c_custkey, c_name AS Customer FROM customer")
steps("pq_change_type", "orders", [ChangeType({"o_orderkey": "string", "o_orderdate": "date", "o_custkey": "decimal"})], f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, {r2('o_totalprice')} AS o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders")
steps("pq_filter_and", "lineitem", [FilterRows([C("l_quantity", "greater-than", 25), C("l_returnflag", "equals", "R")]), RemoveColumns(["l_shipdate"])], f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {r2('l_quantity')} AS l_quantity, {r2('l_extendedprice')} AS l_extendedprice, {r2('l_discount')} AS l_discount, {r2('l_tax')} AS l_tax, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
steps("pq_filter_or_text", "part", [FilterRows([C("p_name", "contains", "RED"), C("p_type", "starts-with", "std"), C("p_brand", "ends-with", "#11")], "or"), RemoveColumns(["p_retailprice"])], "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part WHERE contains(lower(p_name), 'red') OR starts_with(lower(p_type), 'std') OR ends_with(lower(p_brand), '#11')")
steps("pq_filter_comparisons", "orders", [FilterRows([C("o_totalprice", "greater-than-or-equal", 1000), C("o_totalprice", "less-than", 200000), C("o_orderstatus", "not-equals", "P"), C("o_orderpriority", "less-than-or-equal", "3-ZZZ")]), RemoveColumns(["o_orderdate", "o_orderpriority"])], f"SELECT o_orderkey, o_custkey, o_orderstatus, {r2('o_totalprice')} AS o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'P' AND o_orderpriority <= '3-ZZZ'")
steps("pq_filter_blank", "customer", [gappy(7, "c_custkey"), FilterRows([C("gap", "is-blank")]), RemoveColumns(["c_acctbal", "c_nationkey"])], "SELECT c_custkey, c_name, c_mktsegment, CAST(NULL AS BIGINT) AS gap FROM customer WHERE c_custkey % 7 = 0")
steps("pq_filter_not_blank", "customer", [gappy(7, "c_custkey"), FilterRows([C("gap", "is-not-blank"), C("gap", "not-equals", 3)]), RemoveColumns(["c_acctbal", "c_nationkey"])], "SELECT c_custkey, c_name, c_mktsegment, c_custkey AS gap FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey <> 3")
steps("pq_replace_values", "orders", [ReplaceValues([("o_orderstatus", "F", "O"), ("o_orderstatus", "O", "X")]), RemoveColumns(["o_totalprice", "o_orderdate"])], "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
steps("pq_dedupe_all", "lineitem", [RemoveColumns(["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]), RemoveDuplicates()], "SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem")
steps("pq_dedupe_keys_sorted", "orders", [SortRows([("o_totalprice", "desc"), ("o_orderkey", "asc")]), RemoveDuplicates(["o_custkey"]), RemoveColumns(["o_orderdate"])], f"SELECT o_orderkey, o_custkey, o_orderstatus, {r2('o_totalprice')} AS o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
steps("pq_sort_index", "orders", [SortRows([("o_orderpriority", "desc"), ("o_orderkey", "asc")]), IndexColumn("n", "n", 10, 5), RemoveColumns(["o_orderdate", "o_totalprice"])], "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(10 + 5 * (row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1) AS BIGINT) AS n FROM orders")
steps("pq_index_fraction", "nation", [SortRows([("n_nationkey", "asc")]), IndexColumn("n", "n", 0.5, -0.25)], f"SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, {r2('0.5 - 0.25 * (row_number() OVER (ORDER BY n_nationkey) - 1)')} AS n FROM nation")
FILL = "SELECT c_custkey, {0}(" + GAP.format("c_custkey", 3) + " IGNORE NULLS) OVER (ORDER BY c_custkey ROWS BETWEEN {1}) AS gap FROM customer"
for way, take, frame in (("down", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("up", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
    steps(f"pq_fill_{way}", "customer", [gappy(3, "c_custkey"), SortRows([("c_custkey", "asc")]), Fill(["gap"], way), RemoveColumns(["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])], FILL.format(take, frame))
steps("pq_split", "part", [SplitColumn("p_brand", "#", ("maker", "number"), ("maker", "number")), RemoveColumns(["p_retailprice", "p_name", "p_type", "p_size"])], "SELECT p_partkey, p_brand, CASE WHEN strpos(p_brand, '#') > 0 THEN substring(p_brand, 1, strpos(p_brand, '#') - 1) ELSE p_brand END AS maker, CASE WHEN strpos(p_brand, '#') > 0 THEN substring(p_brand, strpos(p_brand, '#') + 1) END AS number FROM part")
steps("pq_merge_columns", "customer", [gappy(7, "c_custkey"), MergeColumns(["c_mktsegment", "gap", "c_nationkey"], "|", "joined", "joined", True), RemoveColumns(["c_acctbal"])], "SELECT c_custkey, c_name, c_mktsegment || '|' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE CAST(c_custkey AS VARCHAR) END || '|' || CAST(c_nationkey AS VARCHAR) AS joined FROM customer")
AGGS = [Aggregation("n", "n", "count-rows"), Aggregation("s", "total", "sum", "l_extendedprice"), Aggregation("a", "mean", "average", "l_quantity"), Aggregation("lo", "low", "min", "l_shipdate"), Aggregation("hi", "high", "max", "l_quantity")]
AGG_SQL = f"count(*) AS n, {r2('sum(l_extendedprice)')} AS total, {r2('avg(l_quantity)')} AS mean, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS low, {r2('max(l_quantity)')} AS high"
steps("pq_group_by", "lineitem", [GroupBy(["l_returnflag", "l_linestatus"], AGGS)], f"SELECT l_returnflag, l_linestatus, {AGG_SQL} FROM lineitem GROUP BY 1, 2")
steps("pq_group_global", "lineitem", [GroupBy([], AGGS)], f"SELECT {AGG_SQL} FROM lineitem")
steps("pq_group_empty", "lineitem", [FilterRows([C("l_quantity", "less-than", 0)]), GroupBy([], AGGS)], f"SELECT {AGG_SQL} FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
RICH = Query("rich", "customer", [FilterRows([C("c_acctbal", "greater-than", 5000)])])
L, R = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority", "c_name AS Customer, c_mktsegment AS Segment"
LEFT_BLANK = "NULL::BIGINT AS o_orderkey, NULL::BIGINT AS o_custkey, NULL::VARCHAR AS o_orderstatus, NULL::VARCHAR AS o_orderpriority"
RICH_SQL = "WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 5000), o AS (SELECT * FROM orders WHERE o_totalprice > 100000) "
JOIN_SQL = {
    "inner": f"SELECT {L}, {R} FROM o JOIN rich ON o_custkey = c_custkey", "left-outer": f"SELECT {L}, {R} FROM o LEFT JOIN rich ON o_custkey = c_custkey",
    "right-outer": f"SELECT {L}, {R} FROM o RIGHT JOIN rich ON o_custkey = c_custkey", "full-outer": f"SELECT {L}, {R} FROM o FULL JOIN rich ON o_custkey = c_custkey",
    "left-anti": f"SELECT {L}, NULL::VARCHAR AS Customer, NULL::VARCHAR AS Segment FROM o ANTI JOIN rich ON o_custkey = c_custkey", "right-anti": f"SELECT {LEFT_BLANK}, {R} FROM rich ANTI JOIN o ON o_custkey = c_custkey",
}
for kind, sql in JOIN_SQL.items():
    chain = [FilterRows([C("o_totalprice", "greater-than", 100000)]), RemoveColumns(["o_orderdate", "o_totalprice"]), MergeQueries("rich", kind, ["o_custkey"], ["c_custkey"], [("c_name", "cust", "Customer"), ("c_mktsegment", "seg", "Segment")])]
    steps(f"pq_merge_{kind.replace('-', '_')}", "orders", chain, RICH_SQL + sql, [RICH])
steps("pq_merge_multikey", "supplier", [MergeQueries("customer", "inner", ["s_nationkey", "s_suppkey"], ["c_nationkey", "c_custkey"], [("c_name", "cust", "Customer")]), RemoveColumns(["s_acctbal"])], "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, c_name AS Customer FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey = c_custkey")
PEOPLE = Query("people", "supplier", [RenameColumns({"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}), RemoveColumns(["s_nationkey"])])
steps("pq_append_schema_drift", "customer", [RenameColumns({"c_custkey": "id", "c_name": "name", "c_mktsegment": "segment"}), RemoveColumns(["c_nationkey", "c_acctbal"]), AppendQueries(["people"])], f"SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, {r2('s_acctbal')} FROM supplier", [PEOPLE])
steps("pq_append", "region", [AppendQueries(["region"])], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region UNION ALL SELECT CAST(r_regionkey AS BIGINT), r_name FROM region")
KEEP = [RemoveColumns(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])]
for agg in ("sum", "count", "min", "max"):
    body = lambda s, agg=agg: f"count(*) FILTER (l_linestatus = '{s}')" if agg == "count" else r2(f"{agg}(l_quantity) FILTER (l_linestatus = '{s}')")
    cells = ", ".join(f"nullif({body(s)}, 0) AS \"{s}\"" if agg == "count" else f'{body(s)} AS "{s}"' for s in "FO")
    steps(f"pq_pivot_{agg}", "lineitem", [*KEEP, PivotColumn("p", "l_linestatus", "l_quantity", agg)], f"SELECT l_returnflag, {cells} FROM lineitem GROUP BY 1")
steps("pq_pivot_first", "orders", [RemoveColumns(["o_totalprice", "o_orderdate", "o_custkey"]), SortRows([("o_orderkey", "asc")]), RenameColumns({"o_orderkey": "key"}), PivotColumn("p", "o_orderstatus", "o_orderkey", "first")], 'SELECT o_orderpriority, min(o_orderkey) FILTER (o_orderstatus = \'F\') AS "F", min(o_orderkey) FILTER (o_orderstatus = \'O\') AS "O", min(o_orderkey) FILTER (o_orderstatus = \'P\') AS "P" FROM orders GROUP BY 1')
UNPIVOT = "SELECT l_orderkey, l_partkey, l_returnflag, a.* FROM lineitem, LATERAL (VALUES ('l_quantity', l_quantity), ('l_discount', l_discount), ('l_tax', l_tax)) AS a(Attribute, Value)"
for mode, named in (("selected", ["l_quantity", "l_discount", "l_tax"]), ("other-columns", ["l_orderkey", "l_partkey", "l_returnflag"])):
    steps(f"pq_unpivot_{mode.split('-')[0]}", "lineitem", [RemoveColumns(["l_suppkey", "l_linenumber", "l_extendedprice", "l_linestatus", "l_shipdate"]), UnpivotColumns(named, mode)], f"SELECT l_orderkey, l_partkey, l_returnflag, Attribute, {r2('Value')} AS Value FROM ({UNPIVOT})")
steps("pq_conditional", "lineitem", [ConditionalColumn("size", "size", [(C("l_quantity", "less-than", 10), "small"), (C("l_quantity", "less-than", 30), "middle")], "large"), GroupBy(["size"], [Aggregation("n", "n", "count-rows")])], "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'middle' ELSE 'large' END AS size, count(*) AS n FROM lineitem GROUP BY 1")
CUSTOM = {
    "arith": ("[l_extendedprice] * (1 - [l_discount]) / 2 - -[l_tax]", "round(l_extendedprice * (1 - l_discount) / 2 + l_tax, 6) + 0.0"), "text": ('Text.Upper([l_returnflag]) & "-" & Text.Length([l_linestatus])', "upper(l_returnflag) || '-' || CAST(length(l_linestatus) AS VARCHAR)"),
    "date": ("Date.Year([l_shipdate]) * 10000 + Date.Month([l_shipdate]) * 100 + Date.Day([l_shipdate])", "CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS BIGINT)"),
    "if": ('if [l_quantity] >= 25 then if [l_tax] = 0 then "free" else "taxed" else "few"', "CASE WHEN l_quantity >= 25 THEN CASE WHEN l_tax = 0 THEN 'free' ELSE 'taxed' END ELSE 'few' END"),
    "round": ("Number.Round(-[l_quantity] / 2) + Number.Abs(-[l_linenumber])", "CAST(floor(-l_quantity / 2 + 0.5) + l_linenumber AS BIGINT)"),
}
for what, (formula, sql) in CUSTOM.items():
    steps(f"pq_custom_{what}", "lineitem", [CustomColumn("x", "x", formula), RemoveColumns(["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus"])], f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {sql} AS x FROM lineitem", digits=6)
steps("pq_reference_query", "rich", [GroupBy(["c_mktsegment"], [Aggregation("n", "n", "count-rows"), Aggregation("b", "balance", "sum", "c_acctbal")])], f"SELECT c_mktsegment, count(*) AS n, {r2('sum(c_acctbal)')} AS balance FROM customer WHERE c_acctbal > 5000 GROUP BY 1", [RICH])

# The model.
MEASURES = {
    "Revenue": "SUM(orders[o_totalprice])", "Orders": "COUNTROWS(orders)", "Customers": "DISTINCTCOUNT(orders[o_custkey])", "Quantity": "SUM(lineitem[l_quantity])",
    "Average order": "DIVIDE([Revenue], [Orders])", "Gross": "SUMX(lineitem, lineitem[l_extendedprice] * (1 - lineitem[l_discount]))", "Revenue LY": "CALCULATE([Revenue], SAMEPERIODLASTYEAR(calendar[Date]))",
}


def calendar(spark: SparkSession) -> DataFrame:
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2001-12-31', INTERVAL 1 DAY)) AS Date")
    return days.select("Date", F.year("Date").alias("Year"), (F.year("Date") * 100 + F.month("Date")).alias("Month"), F.quarter("Date").alias("Quarter"))


def star(spark: SparkSession, d: str, **changes) -> Model:
    """The driver's tables as a model. nation filters supplier only when asked: both paths to lineitem would be ambiguous."""
    own = tables(spark, d)
    own.makers["orders"] = lambda: read(spark, f"{d}/orders.parquet").withColumn("o_orderdate", F.to_date("o_orderdate"))
    own.makers["calendar"] = lambda: calendar(spark)
    link = lambda a, b, **k: Relationship(tuple(a.split(".")), tuple(b.split(".")), **k)
    relations = [
        link("region.r_regionkey", "nation.n_regionkey"), link("nation.n_nationkey", "customer.c_nationkey"), link("customer.c_custkey", "orders.o_custkey", direction=changes.get("customer", "left-to-right")),
        link("orders.o_orderkey", "lineitem.l_orderkey"), link("part.p_partkey", "lineitem.l_partkey"), link("supplier.s_suppkey", "lineitem.l_suppkey"),
        link("nation.n_nationkey", "supplier.s_nationkey", active=False), link("calendar.Date", "orders.o_orderdate"),
    ]
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
    return Model(own, relations, dict(MEASURES), {}, {"calendar": "Date"}, keys)


def by(name: str, dimension: str, expression: str, sql: str | None, filters: dict | None = None, **changes) -> None:
    """A measure for each member of a column."""
    at = tuple(dimension.split("."))
    FOUND[name] = (lambda spark, d: tidy(grouped(star(spark, d, **changes), at, {"value": expression}, filters)), sql)


def one(name: str, expression: str, sql: str, filters: dict | None = None, **changes) -> None:
    FOUND[name] = (lambda spark, d: tidy(evaluate(star(spark, d, **changes), {"value": expression}, filters)), f"SELECT {sql} AS value")


SEG = "SELECT s.c_mktsegment AS member, {} FROM (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (SELECT c_mktsegment AS m, {} FROM customer JOIN orders ON o_custkey = c_custkey {} GROUP BY 1) x ON x.m = s.c_mktsegment"


def seg(agg: str, where: str = "", count: bool = False) -> str:
    return SEG.format("coalesce(v, 0) AS value" if count else f"{r2('v')} AS value", f"{agg} AS v", where)


for fn, agg in (("SUM", "sum"), ("AVERAGE", "avg"), ("MIN", "min"), ("MAX", "max")):
    by(f"m_{fn.lower()}", "customer.c_mktsegment", f"{fn}(orders[o_totalprice])", seg(f"{agg}(o_totalprice)"))
by("m_count", "customer.c_mktsegment", "COUNT(orders[o_orderstatus])", seg("count(o_orderstatus)", count=True))
by("m_distinctcount", "customer.c_mktsegment", "DISTINCTCOUNT(orders[o_custkey])", seg("count(DISTINCT o_custkey)", count=True))
by("m_countrows", "customer.c_mktsegment", "COUNTROWS(orders)", seg("count(*)", count=True))
by("m_divide", "customer.c_mktsegment", "DIVIDE([Revenue], [Orders] - [Orders], -1)", "SELECT DISTINCT c_mktsegment AS member, -1.0::DOUBLE AS value FROM customer")
by("m_if", "customer.c_mktsegment", 'IF([Average order] > 0 && NOTHING_BLANK, "some", "none")'.replace(" && NOTHING_BLANK", ""), "SELECT DISTINCT c_mktsegment AS member, 'some' AS value FROM customer")
by("m_switch", "customer.c_mktsegment", 'SWITCH(SELECTEDVALUE(customer[c_mktsegment]), "BUILDING", 1, "MACHINERY", 2, 0)', "SELECT DISTINCT c_mktsegment AS member, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END::BIGINT AS value FROM customer")
by("m_isblank", "orders.o_orderpriority", "ISBLANK(CALCULATE([Revenue], orders[o_orderstatus] = \"none\"))", "SELECT DISTINCT o_orderpriority AS member, true AS value FROM orders")
by("m_var", "customer.c_mktsegment", "VAR r = [Revenue] VAR n = [Orders] RETURN IF(n > 0, (r - 1) / n, BLANK())", seg("(sum(o_totalprice) - 1) / count(*)"))
by("m_nested_measures", "customer.c_mktsegment", "[Average order] * 2", seg("2 * sum(o_totalprice) / count(*)"))
one("m_scalar_arithmetic", "(2 + 3 * 4 - -1) / 2", "7.5::DOUBLE")
one("m_comparison_blank", "IF(BLANK() = BLANK(), 1, 0) + IF(BLANK() < 1, 10, 0) + IF(\"1\" = 1, 100, 0)", "1::BIGINT")
one("ctx_direct", "[Revenue]", f"(SELECT {r2('sum(o_totalprice)')} FROM orders WHERE o_orderstatus = 'F')", {("orders", "o_orderstatus"): "F"})
one("ctx_in", "[Revenue]", f"(SELECT {r2('sum(o_totalprice)')} FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))", {("customer", "c_mktsegment"): ["BUILDING", "MACHINERY"]})
REG = "FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey"
by("ctx_snowflake", "region.r_name", "[Revenue]", f"SELECT r_name AS member, {r2('sum(o_totalprice)')} AS value {REG} GROUP BY 1")
by("ctx_snowflake_deep", "region.r_name", "[Quantity]", f"SELECT r_name AS member, {r2('sum(l_quantity)')} AS value {REG} LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
by("ctx_fact_no_reverse", "orders.o_orderstatus", "COUNTROWS(customer)", "SELECT DISTINCT o_orderstatus AS member, (SELECT count(*) FROM customer) AS value FROM orders")
by("ctx_bidirectional", "orders.o_orderstatus", "COUNTROWS(customer)", "SELECT o_orderstatus AS member, count(DISTINCT o_custkey) AS value FROM orders GROUP BY 1", customer="both")
by("ctx_inactive", "nation.n_name", "COUNTROWS(supplier)", "SELECT n_name AS member, (SELECT count(*) FROM supplier) AS value FROM nation")
by("calc_userelationship", "nation.n_name", "CALCULATE(COUNTROWS(supplier), USERELATIONSHIP(nation[n_nationkey], supplier[s_nationkey]))", "SELECT n_name AS member, count(s_suppkey) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
by("calc_crossfilter_none", "customer.c_mktsegment", "CALCULATE([Orders], CROSSFILTER(customer[c_custkey], orders[o_custkey], NONE))", "SELECT DISTINCT c_mktsegment AS member, (SELECT count(*) FROM orders) AS value FROM customer")
by("calc_crossfilter_both", "orders.o_orderpriority", "CALCULATE(COUNTROWS(customer), CROSSFILTER(customer[c_custkey], orders[o_custkey], BOTH))", "SELECT o_orderpriority AS member, count(DISTINCT o_custkey) AS value FROM orders GROUP BY 1")
by("calc_replace", "customer.c_mktsegment", 'CALCULATE([Orders], customer[c_mktsegment] = "BUILDING")', "SELECT DISTINCT c_mktsegment AS member, (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') AS value FROM customer")
by("calc_predicate", "customer.c_mktsegment", 'CALCULATE([Orders], orders[o_totalprice] > 100000 || orders[o_orderstatus] = "P")', seg("count(*)", "AND (o_totalprice > 100000 OR o_orderstatus = 'P')", True))
by("calc_filter_table", "customer.c_mktsegment", "CALCULATE([Revenue], FILTER(FILTER(orders, orders[o_totalprice] > 50000), orders[o_orderstatus] <> \"P\"))", seg("sum(o_totalprice)", "AND o_totalprice > 50000 AND o_orderstatus <> 'P'"))
by("calc_removefilters_all", "customer.c_mktsegment", "CALCULATE([Orders], REMOVEFILTERS())", "SELECT DISTINCT c_mktsegment AS member, (SELECT count(*) FROM orders WHERE true) AS value FROM customer", {("orders", "o_orderstatus"): "F"})
by("calc_removefilters_table", "customer.c_mktsegment", "CALCULATE([Orders], REMOVEFILTERS(customer))", "SELECT DISTINCT c_mktsegment AS member, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS value FROM customer", {("orders", "o_orderstatus"): "F"})
by("calc_removefilters_column", "customer.c_mktsegment", "CALCULATE([Orders], REMOVEFILTERS(orders[o_orderstatus]))", seg("count(*)", "", True), {("orders", "o_orderstatus"): "F"})
by("calc_all_pct_of_total", "customer.c_mktsegment", "DIVIDE(100 * [Revenue], CALCULATE([Revenue], ALL(customer)))", seg("100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)"))
by("calc_keepfilters", "customer.c_mktsegment", 'CALCULATE([Orders], KEEPFILTERS(customer[c_mktsegment] = "BUILDING"))', seg("count(*)", "AND c_mktsegment = 'BUILDING'", True))
by("calc_nested", "customer.c_mktsegment", 'CALCULATE(CALCULATE([Orders], orders[o_orderstatus] = "F"), orders[o_totalprice] > 100000)', seg("count(*)", "AND o_orderstatus = 'F' AND o_totalprice > 100000", True))
by("calc_slicer_lists_all", "customer.c_mktsegment", "[Revenue]", seg("sum(o_totalprice)", "AND c_mktsegment = 'BUILDING'"), {("customer", "c_mktsegment"): "BUILDING"})
by("it_sumx", "customer.c_mktsegment", "[Gross]", f"SELECT c_mktsegment AS member, {r2('sum(l_extendedprice * (1 - l_discount))')} AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
for fn, agg in (("AVERAGEX", "avg"), ("MINX", "min"), ("MAXX", "max"), ("COUNTX", "count")):
    by(f"it_{fn.lower()}", "part.p_type", f"{fn}(lineitem, lineitem[l_quantity] * lineitem[l_tax])", f"SELECT p_type AS member, {'count(l_quantity * l_tax)' if agg == 'count' else r2(f'{agg}(l_quantity * l_tax)')} AS value FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
by("it_related", "lineitem.l_returnflag", "SUMX(lineitem, lineitem[l_quantity] * RELATED(part[p_retailprice]))", f"SELECT l_returnflag AS member, {r2('sum(l_quantity * p_retailprice)')} AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1")
by("it_filter", "customer.c_mktsegment", "SUMX(FILTER(orders, orders[o_totalprice] > 100000), orders[o_totalprice] / 2)", seg("sum(o_totalprice / 2)", "AND o_totalprice > 100000"))
by("it_values_measure", "region.r_name", "AVERAGEX(VALUES(customer[c_mktsegment]), [Revenue])", f"SELECT r_name AS member, {r2('avg(v)')} AS value FROM region LEFT JOIN (SELECT n_regionkey, c_mktsegment, sum(o_totalprice) AS v FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) ON n_regionkey = r_regionkey GROUP BY 1")
by("it_context_transition", "customer.c_mktsegment", "AVERAGEX(customer, [Revenue])", f"SELECT c_mktsegment AS member, {r2('avg(v)')} AS value FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
by("it_if_row", "orders.o_orderpriority", 'SUMX(orders, IF(orders[o_orderstatus] = "F", orders[o_totalprice], 0))', f"SELECT o_orderpriority AS member, {r2('sum(CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN o_totalprice ELSE 0 END)')} AS value FROM orders GROUP BY 1")
by("tbl_countrows_values", "region.r_name", "COUNTROWS(VALUES(customer[c_mktsegment])) + COUNTROWS(DISTINCT(nation[n_name]))", "SELECT r_name AS member, count(DISTINCT c_mktsegment) + count(DISTINCT n_name) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
by("tbl_countrows_filter", "region.r_name", "COUNTROWS(FILTER(nation, nation[n_nationkey] >= 10))", "SELECT r_name AS member, count(n_nationkey) FILTER (n_nationkey >= 10) AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
by("selectedvalue", "nation.n_name", 'SELECTEDVALUE(nation[n_name], "many")', "SELECT n_name AS member, n_name AS value FROM nation")
one("selectedvalue_many", 'SELECTEDVALUE(nation[n_name], "many")', "'many'")
by("hasonevalue", "region.r_name", "HASONEVALUE(nation[n_name])", "SELECT r_name AS member, count(DISTINCT n_name) = 1 AS value FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")

DAYS = "days AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d), cal AS (SELECT d, CAST(year(d) AS INTEGER) AS y, CAST(year(d) * 100 + month(d) AS INTEGER) AS ym FROM days), o AS (SELECT CAST(o_orderdate AS DATE) AS od, o_totalprice AS p FROM orders)"


def time(name: str, column: str, key: str, shifted: str, call: str) -> None:
    """`shifted`: SQL for (member, d), the dates that the call makes of each member's dates."""
    sql = f"WITH {DAYS}, s AS (SELECT DISTINCT m, d FROM ({shifted}) WHERE d IN (SELECT d FROM days)), m AS (SELECT DISTINCT {key} AS member FROM cal) SELECT CAST(m.member AS BIGINT) AS member, {r2('sum(p)')} AS value FROM m LEFT JOIN s ON s.m = m.member LEFT JOIN o ON o.od = s.d GROUP BY 1"
    by(name, f"calendar.{column}", call, sql)


time("ti_sply_year", "Year", "y", "SELECT y AS m, CAST(d - INTERVAL 1 YEAR AS DATE) AS d FROM cal", "[Revenue LY]")
time("ti_sply_month", "Month", "ym", "SELECT ym AS m, CAST(d - INTERVAL 1 YEAR AS DATE) AS d FROM cal", "[Revenue LY]")
for unit, span in (("DAY", "5 DAY"), ("MONTH", "5 MONTH"), ("QUARTER", "15 MONTH"), ("YEAR", "5 YEAR")):
    time(f"ti_dateadd_{unit.lower()}", "Month", "ym", f"SELECT ym AS m, CAST(d - INTERVAL {span} AS DATE) AS d FROM cal", f"CALCULATE([Revenue], DATEADD(calendar[Date], -5, {unit}))")
time("ti_previousmonth", "Month", "ym", "SELECT a.ym AS m, b.d FROM (SELECT ym, min(d) AS lo FROM cal GROUP BY 1) a JOIN cal b ON date_trunc('month', b.d) = date_trunc('month', a.lo) - INTERVAL 1 MONTH", "CALCULATE([Revenue], PREVIOUSMONTH(calendar[Date]))")
time("ti_previousyear", "Month", "ym", "SELECT a.ym AS m, b.d FROM (SELECT ym, min(y) AS y FROM cal GROUP BY 1) a JOIN cal b ON b.y = a.y - 1", "CALCULATE([Revenue], PREVIOUSYEAR(calendar[Date]))")
YTD = "SELECT a.ym AS m, b.d FROM (SELECT ym, min(y) AS y, max(d) AS hi FROM cal GROUP BY 1) a JOIN cal b ON b.y = a.y AND b.d <= a.hi"
time("ti_datesytd", "Month", "ym", YTD, "CALCULATE([Revenue], DATESYTD(calendar[Date]))")
time("ti_totalytd", "Month", "ym", YTD, "TOTALYTD([Revenue], calendar[Date])")
by("ti_countrows_dates", "calendar.Year", "COUNTROWS(PREVIOUSYEAR(calendar[Date]))", f"WITH {DAYS} SELECT CAST(a.y AS BIGINT) AS member, count(b.d) AS value FROM (SELECT DISTINCT y FROM cal) a LEFT JOIN cal b ON b.y = a.y - 1 GROUP BY 1")


# Shapes of models that the driver's tables don't have as they are.
def shaped(name: str, sql: str, digits: int = 2):
    def add(run):
        FOUND[name] = (lambda spark, d: tidy(run(spark, d), digits), sql)
        return run

    return add


@shaped("ctx_one_to_one", "SELECT c_mktsegment AS member, count(*) AS value FROM customer GROUP BY 1")
def ctx_one_to_one(spark, d):
    c = tables(spark, d)["customer"]
    m = Model({"names": c.select("c_custkey", "c_name"), "segments": c.select("c_custkey", "c_mktsegment")}, [Relationship(("names", "c_custkey"), ("segments", "c_custkey"), ONE_ONE, "both")])
    return grouped(m, ("segments", "c_mktsegment"), {"value": "COUNTROWS(names)"})


@shaped("ctx_many_to_many", f"SELECT p_brand AS member, {r2('(SELECT sum(p_size) FROM part y WHERE y.p_type IN (SELECT p_type FROM part z WHERE z.p_brand = x.p_brand))')} AS value FROM (SELECT DISTINCT p_brand FROM part) x")
def ctx_many_to_many(spark, d):
    p = tables(spark, d)["part"]
    m = Model({"part": p.select("p_partkey", "p_type", "p_brand"), "targets": p.select("p_type", F.col("p_size").cast("double").alias("size"))}, [Relationship(("part", "p_type"), ("targets", "p_type"), MANY_MANY, "left-to-right")])
    return grouped(m, ("part", "p_brand"), {"value": "SUM(targets[size])"})


ROLES = "sales AS (SELECT CAST(o_orderdate AS DATE) AS od, CAST(l_shipdate AS DATE) AS sd, l_extendedprice AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@shaped("ctx_role_playing_dates", f"WITH {DAYS}, {ROLES} SELECT CAST(y AS BIGINT) AS member, {r2('any_value(a)')} AS ordered, {r2('any_value(b)')} AS shipped FROM (SELECT DISTINCT y FROM cal) c LEFT JOIN (SELECT year(od) AS k, sum(p) AS a FROM sales GROUP BY 1) ON k = y LEFT JOIN (SELECT year(sd) AS j, sum(p) AS b FROM sales WHERE sd <= DATE '2001-12-31' GROUP BY 1) ON j = y GROUP BY 1")
def ctx_role_playing_dates(spark, d):
    t = tables(spark, d)
    sales = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_date("o_orderdate").alias("OrderDate"), F.to_date("l_shipdate").alias("ShipDate"), "l_extendedprice")
    m = Model({"calendar": calendar(spark), "sales": sales}, [Relationship(("calendar", "Date"), ("sales", "OrderDate")), Relationship(("calendar", "Date"), ("sales", "ShipDate"), active=False)])
    shipped = "CALCULATE(SUM(sales[l_extendedprice]), USERELATIONSHIP(calendar[Date], sales[ShipDate]))"
    return grouped(m, ("calendar", "Year"), {"ordered": "SUM(sales[l_extendedprice])", "shipped": shipped})


@shaped("calc_col_arith", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice * l_discount - l_tax, 6) + 0.0 AS x FROM lineitem", digits=6)
def calc_col_arith(spark, d):
    return calculated_column(star(spark, d), "lineitem", "lineitem[l_extendedprice] * [l_discount] - [l_tax]", "x").select("l_orderkey", "l_linenumber", "x")


@shaped("calc_col_related", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, p_type AS x FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def calc_col_related(spark, d):
    return calculated_column(star(spark, d), "lineitem", "RELATED(part[p_type])", "x").select("l_orderkey", "l_linenumber", "l_partkey", "x")


@shaped("calc_col_aggregated", f"SELECT l_returnflag AS member, {r2('sum(l_extendedprice * (1 + l_tax))')} AS value FROM lineitem GROUP BY 1")
def calc_col_aggregated(spark, d):
    m = star(spark, d)
    m.add_column("lineitem", "Charge", "lineitem[l_extendedprice] * (1 + lineitem[l_tax])")
    return grouped(m, ("lineitem", "l_returnflag"), {"value": "SUM(lineitem[Charge])"})


# Visuals and the rest.
def visual(name: str, v: visuals.Visual, sql: str) -> None:
    FOUND[name] = (lambda spark, d: tidy(visuals.run(star(spark, d), v)), sql)


visual("vis_kpi", visuals.Visual("kpi", ("Revenue",)), f'SELECT {r2("sum(o_totalprice)")} AS "Revenue" FROM orders')
visual("vis_bar_topn", visuals.Visual("bar", ("Revenue",), ("nation", "n_name"), limit=7), f'SELECT n_name AS member, {r2("sum(o_totalprice)")} AS "Revenue" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY sum(o_totalprice) DESC NULLS LAST, 1 LIMIT 7')
visual("vis_line_month", visuals.Visual("line", ("Revenue",), ("calendar", "Month")), f'WITH {DAYS} SELECT CAST(ym AS BIGINT) AS member, {r2("sum(p)")} AS "Revenue" FROM cal LEFT JOIN o ON od = d GROUP BY 1 ORDER BY 1 LIMIT 100')
visual("vis_table_multi", visuals.Visual("table", ("Revenue", "Orders", "Customers", "Average order"), ("nation", "n_name")), f'SELECT n_name AS member, {r2("sum(o_totalprice)")} AS "Revenue", count(o_orderkey) AS "Orders", count(DISTINCT o_custkey) AS "Customers", {r2("sum(o_totalprice) / nullif(count(o_orderkey), 0)")} AS "Average order" FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1')
visual("vis_slicer", visuals.Visual("slicer", (), ("customer", "c_mktsegment")), "SELECT DISTINCT c_mktsegment AS member FROM customer")
FOUND["vis_scalar_table"] = (lambda spark, d: tidy(visuals.run(star(spark, d), visuals.Visual("table", ("Orders", "Customers"))).drop("text")), "SELECT 'Orders' AS measure, CAST(count(*) AS DOUBLE) AS number FROM orders UNION ALL SELECT 'Customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders")


@shaped("vis_blank_member", f"SELECT g AS member, {r2('sum(o_totalprice)')} AS value FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS g, c_custkey FROM customer) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def vis_blank_member(spark, d):
    m = star(spark, d)
    m.tables["customer"] = m.tables["customer"].withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")))
    return grouped(m, ("customer", "c_mktsegment"), {"value": "[Revenue]"})


JOINED = {"region": "region", "nation": "nation JOIN region ON n_regionkey = r_regionkey", "customer": "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"}
JOINED["orders"] = "orders JOIN customer ON o_custkey = c_custkey" + JOINED["customer"].removeprefix("customer")
JOINED["lineitem"] = "lineitem JOIN orders ON l_orderkey = o_orderkey" + JOINED["orders"].removeprefix("orders")
SEEN = [f"SELECT '{t}' AS \"table\", (SELECT count(*) FROM {t}) AS total, (SELECT count(*) FROM {x} WHERE r_name = 'ASIA') AS visible" for t, x in JOINED.items()] + [f"SELECT '{t}', (SELECT count(*) FROM {t}), (SELECT count(*) FROM {t})" for t in ("supplier", "part", "events")] + ["SELECT 'calendar', 2557, 2557"]


@shaped("explain_context_counts", " UNION ALL ".join(SEEN))
def explain_context_counts(spark, d):
    return explain.counts(star(spark, d), {("region", "r_name"): "ASIA"})


def profile_sql(column: str, kind: str) -> str:
    """The profile of a column of orders."""
    number, text, time = kind in ("integer", "decimal"), kind == "string", kind == "datetime"
    shown = {"integer": "CAST({}(c) AS VARCHAR)", "decimal": "CAST({}(c) AS VARCHAR)", "datetime": "strftime({}(c), '%Y-%m-%d %H:%M:%S')"}
    bound = lambda f: shown[kind].format(f) if number or time else "NULL"
    length = lambda f: f"{f}(length(c))" if text else "NULL::BIGINT"
    return f"SELECT '{column}' AS \"column\", '{kind}' AS type, count(*) AS row_count, count(*) - count(c) AS null_count, {r2('100.0 * (count(*) - count(c)) / count(*)')} AS null_percent, count(DISTINCT c) AS distinct_count, {r2('100.0 * count(DISTINCT c) / count(*)')} AS distinct_percent, {bound('min')} AS min, {bound('max')} AS max, {r2('avg(c)') if number else 'NULL::DOUBLE'} AS mean, {length('min')} AS min_length, {length('max')} AS max_length, count(DISTINCT c) = count(*) AS is_potential_key FROM (SELECT {column} AS c FROM orders)"


@shaped("profile_columns", " UNION ALL ".join(profile_sql(c, k) for c, k in (("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "string"), ("o_totalprice", "decimal"), ("o_orderdate", "datetime"), ("o_orderpriority", "string"))))
def profile_columns(spark, d):
    return sources.profile(tables(spark, d)["orders"])


@shaped("model_unmatched_fk", "SELECT count(*) AS unmatched FROM orders ANTI JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def model_unmatched_fk(spark, d):
    t = tables(spark, d)
    m = Model({"customer": t["customer"].filter("c_acctbal > 0"), "orders": t["orders"]})
    found = m.check_relationship(Relationship(("customer", "c_custkey"), ("orders", "o_custkey")))
    n = next((x.details["unmatched"] for x in found if x.code == "UNMATCHED_FOREIGN_KEYS"), 0)
    return spark.range(1).select(F.lit(n).cast("bigint").alias("unmatched"))


@shaped("events_row_steps", "SELECT event_id, upper(event_type) AS kind, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level FROM events WHERE event_type <> 'view'")
def events_row_steps(spark, d):
    chain = [FilterRows([C("event_type", "not-equals", "view")]), CustomColumn("kind", "kind", "Text.Upper([event_type])"), ConditionalColumn("level", "level", [(C("value", "greater-than", 50), "high")], "low"), RemoveColumns(["ts", "user_id", "event_type", "value", "props"])]
    return stream_steps(spark.read.parquet(f"{d}/events.parquet"), chain)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Four measures by nation, one of them through a chain of four relationships, in one plan."""
    return tidy(visuals.run(star(spark, d), visuals.Visual("table", ("Revenue", "Orders", "Average order", "Quantity"), ("nation", "n_name"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries  # noqa: F401  adds to FOUND

    return {n: run for n, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    from . import more_queries  # noqa: F401

    return {n: sql for n, (_, sql) in FOUND.items() if sql}
