"""Retail transactions derived from the order tables (lineitem, orders, part)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.schema import MONEY, RAW_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )


def _category():
    return (
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), "Beauty")
        .when(F.col("p_type").isin("STANDARD", "MEDIUM"), "Clothing")
        .otherwise("Electronics")
    )


def _price():
    """Price per unit in whole cents."""
    return F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean transactions with the column names and types of the silver table's inputs."""
    buyer = F.col("o_custkey")
    return _sales(spark, sf_dir).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        buyer.cast("string").alias("customer_id"),
        F.when(buyer % 20 == 0, "Unknown").when(buyer % 2 == 0, "F").otherwise("M").alias("gender"),
        (18 + buyer % 47).cast("int").alias("age"),
        _category().alias("product_category"),
        F.col("l_quantity").cast("int").alias("quantity"),
        _price().alias("price_per_unit"),
        F.col("l_extendedprice").cast(MONEY).alias("total_amount"),
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sales as raw text columns, with the kinds of dirt an upload can hold."""
    order, part, buyer = F.col("l_orderkey"), F.col("l_partkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    quantity = F.col("l_quantity").cast("int")
    amount = F.col("l_extendedprice").cast(MONEY)
    values = [
        F.concat_ws("-", order, F.col("l_linenumber")),
        F.when(order % 97 == 1, F.date_format(day, "dd/MM/yyyy")).when(order % 89 != 1, day.cast("string")),
        buyer.cast("string"),
        F.when(buyer % 20 == 0, F.lit(None)).when(buyer % 2 == 0, "Female").when(buyer % 3 == 0, "n/a").otherwise(
            "Male"
        ),
        F.when(order % 83 == 1, "abc").when(order % 79 == 1, "0").when(order % 71 == 1, "30.0").when(order % 73 != 1, (18 + buyer % 47).cast("string")),
        F.when(part % 71 == 1, "Furniture").when(part % 67 != 1, _category()),
        F.when(order % 61 == 1, "0").when(order % 59 == 1, "-2").when(order % 43 == 1, "2.5").otherwise(quantity.cast("string")),
        _price().cast("string"),
        F.when(order % 53 == 1, "-5").when(order % 47 != 1, amount.cast("string")),
    ]
    return _sales(spark, sf_dir).select(*[v.alias(name) for v, name in zip(values, RAW_COLUMNS, strict=True)])
