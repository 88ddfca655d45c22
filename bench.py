"""Times the headline queries: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores.

Each query's plan is built and its full result written to the no-op sink, once to warm up and then REPEATS times;
the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomquery.operators.steps import Aggregation, Condition, CustomColumn, FilterRows, GroupBy, RemoveDuplicates, UnpivotColumns
from loomquery.plans import explain
from loomquery.plans.measures import calculated_column, evaluate
from loomquery.plans.model import Model, Relationship
from loomquery.plans.pipeline import Query, QuerySet
from loomquery.plans.validation import Rule, Subject, validate
from loomquery.queries import flagship, queries, star, tables
from loomquery.sources import samples

REPEATS = 3


def steps(spark, d, source, *chain):
    return QuerySet({source: tables(spark, d)[source]}, [Query("q", source, list(chain))], check="lazy").evaluate("q").df()


def measure(text):
    return lambda spark, d: evaluate(star(spark, d), {"value": text})


def checkpoint(spark, d):
    """A relationship, a measure in three contexts, and a query's rows, validated; the score as a row."""
    subject = Subject(star(spark, d), QuerySet(tables(spark, d), [Query("some", "orders", [FilterRows([Condition("o_totalprice", "greater-than", 100000)])])]))
    rules = [Rule("relationship", {"from": ("customer", "c_custkey"), "to": ("orders", "o_custkey")}), Rule("measure-result", {"measure": "Orders", "cases": [{"filters": {("customer", "c_mktsegment"): x}, "expected": 0} for x in ("BUILDING", "MACHINERY", "none")]}), Rule("query-output-row-count", {"query": "some", "min": 1})]
    return spark.createDataFrame([(validate(subject, rules).score,)], "score double")


def query_checkpoint(spark, d):
    subject = Subject(None, QuerySet(tables(spark, d), [Query("some", "orders", [RemoveDuplicates(["o_custkey"])])]))
    rules = [Rule("query-present", {"query": "some"}), Rule("query-health", {"query": "some"}), Rule("query-output-schema", {"query": "some", "columns": {"o_custkey": "integer"}}), Rule("query-step-semantics", {"query": "some", "uses": ["RemoveDuplicates"]})]
    return spark.createDataFrame([(validate(subject, rules).score,)], "score double")


def generated(spark, d):
    """600,000 sample sales, whose table joins a model with its checks."""
    t = samples.retail(spark, 600_000)
    Model(t).check_relationship(Relationship(("Customers", "CustomerID"), ("Sales", "CustomerID")))
    return t["Sales"]


QUERIES = {
    "data_generation": generated,
    "measure_sum": measure("SUM(lineitem[l_extendedprice])"),
    "measure_distinctcount": measure("DISTINCTCOUNT(orders[o_custkey])"),
    "measure_sumx": measure("SUMX(lineitem, lineitem[l_quantity] * lineitem[l_extendedprice])"),
    "measure_calculate_filter": measure("CALCULATE(SUM(lineitem[l_extendedprice]), FILTER(lineitem, lineitem[l_quantity] > 25))"),
    "measure_calculate_column": measure("CALCULATE(SUM(lineitem[l_extendedprice]), lineitem[l_quantity] > 25)"),
    "measure_sameperiodlastyear": lambda spark, d: evaluate(star(spark, d), {"value": "[Revenue LY]"}, {("calendar", "Year"): 1997}),
    "column_arithmetic": lambda spark, d: calculated_column(star(spark, d), "lineitem", "lineitem[l_extendedprice] - lineitem[l_tax]", "x").agg(F.sum("x")),
    "column_related": lambda spark, d: calculated_column(star(spark, d), "lineitem", "RELATED(part[p_type])", "x").agg(F.count("x")),
    "context_analysis": lambda spark, d: explain.counts(star(spark, d), {("region", "r_name"): "ASIA"}),
    "validation_checkpoint": checkpoint,
    "validation_query": query_checkpoint,
    "step_filter": lambda spark, d: steps(spark, d, "lineitem", FilterRows([Condition("l_quantity", "greater-than", 25)])),
    "step_dedupe": lambda spark, d: steps(spark, d, "orders", RemoveDuplicates(["o_custkey"])),
    "step_group_by": lambda spark, d: steps(spark, d, "orders", GroupBy(["o_custkey"], [Aggregation("s", "s", "sum", "o_totalprice")])),
    "step_unpivot": lambda spark, d: steps(spark, d, "lineitem", UnpivotColumns(["l_quantity", "l_discount", "l_tax"])),
    "step_custom": lambda spark, d: steps(spark, d, "lineitem", CustomColumn("x", "x", "[l_quantity] * [l_extendedprice]")),
    "step_merge": queries()["pq_merge_left_outer"],
    "visual_nations_4_measures": flagship,
    "visual_snowflake": queries()["ctx_snowflake_deep"],
    "context_transition": queries()["it_context_transition"],
}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{d}/region.parquet").write.format("noop").mode("overwrite").save()
    found = {}
    for name, make in QUERIES.items():
        times = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            make(spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 4)
        print(name, found[name], file=sys.stderr)
    print(json.dumps({"metric": "total of the queries' median times", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(d.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
