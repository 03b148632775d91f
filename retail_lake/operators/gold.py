"""Silver to gold: the tables dashboards read."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.encode import age_band, money_mean, risk_band

# Keys of the daily table.
DAILY_KEYS = ["date", "product_category", "year", "month", "day_of_week", "quarter", "is_weekend"]


def female_share():
    return F.avg(F.coalesce((F.col("gender") == "F").cast("int"), F.lit(0)))


def daily_revenue(silver: DataFrame) -> DataFrame:
    """Measures per day and category; the calendar keys follow from the date, so they add no groups."""
    return silver.groupBy(*DAILY_KEYS).agg(
        F.sum("total_amount").cast("double").alias("daily_revenue"),
        F.sum("quantity").alias("daily_quantity"),
        F.count("transaction_id").alias("transaction_count"),
        F.avg("price_per_unit").alias("avg_price"),
        F.avg("age").alias("avg_customer_age"),
        female_share().alias("female_ratio"),
    )


def monthly_summary(silver: DataFrame, approximate: bool = False) -> DataFrame:
    """Measures per month and category; ``approximate`` trades exact customer counts for one shuffle less."""
    customers = F.approx_count_distinct("customer_id") if approximate else F.count_distinct("customer_id")
    return (
        silver.groupBy("year", "month", "product_category")
        .agg(
            F.sum("total_amount").cast("double").alias("monthly_revenue"),
            F.sum("quantity").alias("monthly_quantity"),
            F.count("transaction_id").alias("monthly_transactions"),
            money_mean("total_amount").alias("avg_transaction_value"),
            customers.alias("unique_customers"),
        )
        .withColumn("year_month", F.concat_ws("-", "year", F.lpad(F.col("month").cast("string"), 2, "0")))
    )


#: Of a sketch: 2^14 cells, a standard error of about 0.8 %; small sets are counted exactly.
SKETCH_BITS = 14


def customer_sketches(silver: DataFrame) -> DataFrame:
    """A mergeable sketch of the customers per month and category, at most 2^SKETCH_BITS bytes each.

    Counts of distinct customers do not add up over months; these sketches do, so any range of
    months is answered from this table.
    """
    sketch = F.hll_sketch_agg(F.col("customer_id").cast("string"), F.lit(SKETCH_BITS)).alias("customers")
    return silver.groupBy("year", "quarter", "month", "product_category").agg(sketch)


def customers_over(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated distinct customers by ``keys`` (columns of the table, or none of them: over all its rows).

    Each customer counts once in a group, however many of its months and categories it stands in.
    """
    merged = F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("estimated_customers")
    return sketches.groupBy(*keys).agg(merged)


def with_age_group(silver: DataFrame) -> DataFrame:
    return silver.withColumn("age_group", age_band("age"))


def customer_segments(silver: DataFrame) -> DataFrame:
    return (
        with_age_group(silver)
        .groupBy("product_category", "gender", "age_group")
        .agg(
            F.count("transaction_id").alias("transaction_count"),
            F.sum("total_amount").cast("double").alias("total_revenue"),
            money_mean("total_amount").alias("avg_spend"),
            F.avg("quantity").alias("avg_quantity"),
        )
    )


def anomaly_records(scored: DataFrame) -> DataFrame:
    """The anomaly table: scored feature rows with their risk level."""
    # Columns of the anomaly table, in order.
    return scored.select(
        "date",
        "product_category",
        "daily_revenue",
        "daily_quantity",
        "transaction_count",
        "revenue_z_score",
        "pct_from_rolling_mean",
        "rolling_mean_7",
        "anomaly_flag",
        "anomaly_score",
        risk_band("anomaly_score").alias("risk_level"),
    )


def enriched(daily: DataFrame, anomalies: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Daily revenue with its anomaly and forecast columns where those exist; a day without a flag is not flagged."""
    keys = ["date", "product_category"]
    return daily.join(anomalies, keys, "left").join(forecasts, keys, "left").na.fill(0, ["anomaly_flag"])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
