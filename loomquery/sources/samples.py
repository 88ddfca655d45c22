"""Sample tables of any size, made by rule from row numbers: the same at every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ["Spain", "France", "Germany", "Italy", "Portugal", "Poland", "Sweden", "Norway", "Ireland", "Greece"]
SEGMENTS, CATEGORIES = ["Premium", "Standard", "Basic"], ["Furniture", "Electronics", "Office", "Garden"]


def pick(values: list[str], salt: int, row: str = "id") -> Column:
    return F.get(F.lit(values), F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(len(values))).cast("int"))


def number(low: int, high: int, salt: int, row: str = "id") -> Column:
    """A whole number from low to high."""
    return (F.pmod(F.xxhash64(row, F.lit(salt)), F.lit(high - low + 1)) + low).cast("bigint")


def calendar(spark: SparkSession, first: str = "2023-01-01", last: str = "2024-12-31") -> DataFrame:
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS Date")
    return days.select("Date", F.year("Date").cast("bigint").alias("Year"), F.date_format("Date", "MMMM").alias("Month"), F.month("Date").cast("bigint").alias("MonthNumber"), F.concat(F.lit("Q"), F.quarter("Date")).alias("Quarter"))


def retail(spark: SparkSession, sales: int = 1500, customers: int = 120, products: int = 20) -> dict[str, DataFrame]:
    """Customers, Products, Calendar and Sales: a star."""
    c = spark.range(1, customers + 1).select(F.col("id").alias("CustomerID"), F.concat(F.lit("Customer "), "id").alias("CustomerName"), pick(COUNTRIES, 1).alias("Country"), pick(SEGMENTS, 2).alias("Segment"))
    cost = number(5, 200, 4).cast("double")
    p = spark.range(1, products + 1).select(F.col("id").alias("ProductID"), F.concat(F.lit("Product "), "id").alias("ProductName"), pick(CATEGORIES, 3).alias("Category"), cost.alias("UnitCost"), F.round(cost * 1.6, 2).alias("UnitPrice"))
    rows = spark.range(1, sales + 1).select(F.col("id").alias("OrderID"), F.date_add(F.lit("2023-01-01").cast("date"), number(0, 730, 5).cast("int")).alias("Date"), number(1, customers, 6).alias("CustomerID"), number(1, products, 7).alias("ProductID"), number(1, 10, 8).alias("Quantity"))
    priced = rows.join(p.select("ProductID", "UnitCost", "UnitPrice"), "ProductID")
    s = priced.select("OrderID", "Date", "CustomerID", "ProductID", "Quantity", F.round(F.col("Quantity") * F.col("UnitPrice"), 2).alias("Revenue"), F.round(F.col("Quantity") * F.col("UnitCost"), 2).alias("Cost"))
    return {"Customers": c, "Products": p, "Calendar": calendar(spark), "Sales": s}


def relationship_lab(spark: SparkSession) -> dict[str, DataFrame]:
    """Tables for one-to-one, many-to-many and role-playing relationships."""
    base = retail(spark, 500, 30, 20)
    profile = spark.range(1, 31).select(F.col("id").alias("CustomerID"), pick(["Gold", "Silver", "Bronze"], 11).alias("LoyaltyTier"), F.date_add(F.lit("2020-01-01").cast("date"), number(0, 1000, 12).cast("int")).alias("SignupDate"))
    regions = ["North", "South", "East"]
    targets = spark.range(len(CATEGORIES) * len(regions)).select(F.get(F.lit(CATEGORIES), (F.col("id") / len(regions)).cast("int")).alias("Category"), F.get(F.lit(regions), (F.col("id") % len(regions)).cast("int")).alias("Region"), number(100, 1000, 13).alias("TargetAmount"))
    sales = base["Sales"].select("OrderID", F.col("Date").alias("OrderDate"), F.date_add("Date", number(1, 14, 14, "OrderID").cast("int")).alias("ShipDate"), "CustomerID", "Revenue")
    return {"Calendar": base["Calendar"], "Customers": base["Customers"], "CustomerProfile": profile, "Products": base["Products"].select("ProductID", "Category", "UnitPrice"), "Targets": targets, "Sales": sales}


def preparation_lab(spark: SparkSession) -> dict[str, DataFrame]:
    """Untidy tables for data preparation: number-like text with blanks, trailing spaces, repeated rows, drifting columns."""
    clean = spark.range(1, 104).select(F.when(F.col("id") % 34 != 0, F.col("id").cast("string")).alias("customer_id"), F.concat(F.lit(" Customer "), "id").alias("CustomerName"), F.when(F.col("id") % 9 == 0, "ES ").otherwise(pick(["ES", "FR", "DE"], 21)).alias("Country"), F.when(F.col("id") % 4 == 0, "old").alias("LegacyNotes"))
    month = lambda first, salt: spark.range(first, first + 150).select(F.col("id").alias("OrderID"), F.date_add(F.lit("2024-01-01" if first == 1 else "2024-02-01").cast("date"), number(0, 27, salt).cast("int")).alias("Date"), number(1, 103, salt + 1).alias("CustomerID"), number(1, 12, salt + 2).alias("ProductID"), number(1, 10, salt + 3).alias("Quantity"), number(10, 900, salt + 4).cast("double").alias("Revenue"))
    products = spark.range(1, 13).select(F.col("id").alias("ProductID"), F.concat(F.lit("Product "), "id").alias("ProductName"), pick(CATEGORIES, 3).alias("Category"), number(5, 300, 4).cast("double").alias("UnitPrice"))
    february = month(151, 40).withColumn("Promotion", F.when(F.col("OrderID") % 3 == 0, "SPRING"))
    return {"Customers_Dirty": clean.unionAll(clean.filter("CustomerName IN (' Customer 1', ' Customer 2', ' Customer 3', ' Customer 4', ' Customer 5')")), "Sales_Jan": month(1, 30), "Sales_Feb": february, "Products": products}


def monthly_targets(spark: SparkSession) -> DataFrame:
    """A wide table to unpivot. Fixed values."""
    return spark.sql("SELECT * FROM VALUES ('A', 100, 120, 130, 140), ('B', 80, 90, 95, 105), ('C', 60, 65, 70, 75) AS t(Product, Jan, Feb, Mar, Apr)")
