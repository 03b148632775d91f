"""Bronze, silver and gold in one job."""

from pyspark.sql import DataFrame, SparkSession

from retail_lake.operators import gold, silver
from retail_lake.sources.csv_files import copy_to_bronze, read_raw
from retail_lake.sources.tables import create_database, overwrite_table, with_run_columns


def bronze_to_silver(
    spark: SparkSession,
    raw: DataFrame,
    database: str,
    run: tuple[str, str] | None = None,
    fmt: str = "parquet",
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Clean the raw rows and store them; ``run`` is (run id, run date) and adds audit columns.

    ``partition_by`` (say, year) lets later date ranges skip folders; it pays where the raw
    files already arrive by date, as each task then writes few folders.
    """
    rows = silver.silver(raw)
    if run:
        rows = with_run_columns(rows, *run)
    return overwrite_table(rows, f"{database}.transactions", fmt, partition_by)


def silver_to_gold(
    spark: SparkSession,
    transactions: DataFrame,
    database: str,
    anomalies: DataFrame | None = None,
    fmt: str = "parquet",
    sketches: bool = False,
) -> dict[str, DataFrame]:
    """Store the gold tables; every one reads the stored silver table.  ``sketches`` adds those of the customers."""
    frames = {
        "daily_revenue": gold.daily_revenue(transactions).orderBy("date", "product_category"),
        "monthly_summary": gold.monthly_summary(transactions).orderBy("year", "month", "product_category"),
        "customer_segments": gold.customer_segments(transactions).orderBy("product_category", "gender", "age_group"),
    }
    if anomalies is not None:
        frames["anomaly_records"] = gold.anomaly_records(anomalies)
    if sketches:
        frames["customer_sketches"] = gold.customer_sketches(transactions)
    return {name: overwrite_table(df, f"{database}.{name}", fmt) for name, df in frames.items()}


def run(
    spark: SparkSession,
    source: str,
    bronze_path: str,
    silver_database: str,
    gold_database: str,
    locations: tuple[str, str] | None = None,
    anomalies: DataFrame | None = None,
    run_info: tuple[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Raw files to gold tables; returns the stored tables by name."""
    silver_at, gold_at = locations or (None, None)
    create_database(spark, silver_database, silver_at)
    create_database(spark, gold_database, gold_at)
    raw = read_raw(spark, copy_to_bronze(spark, source, bronze_path))
    stored = bronze_to_silver(spark, raw, silver_database, run_info)
    return {"transactions": stored, **silver_to_gold(spark, stored, gold_database, anomalies)}
