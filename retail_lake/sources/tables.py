"""Catalog tables: overwrite of medallion tables, append to the serving tables."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.functions.encode import whole_number
from retail_lake.schema import snake_case

# Serving tables, their columns and types. The last column is filled at load time.
SERVING_TABLES = {
    "sales_transactions": (
        "transaction_id STRING, date DATE, customer_id STRING, gender STRING, age INT, product_category STRING, "
        "quantity INT, price_per_unit DOUBLE, total_amount DOUBLE, uploaded_at TIMESTAMP"
    ),
    "daily_forecasts": (
        "forecast_date DATE, product_category STRING, predicted_revenue DOUBLE, model_version STRING, "
        "created_at TIMESTAMP"
    ),
    "anomaly_records": (
        "record_date DATE, product_category STRING, daily_revenue DOUBLE, anomaly_score DOUBLE, anomaly_flag INT, "
        "revenue_z_score DOUBLE, created_at TIMESTAMP"
    ),
}


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{where}")


def overwrite_table(
    df: DataFrame, table: str, fmt: str = "parquet", partition_by: list[str] | None = None
) -> DataFrame:
    """Replace a table, schema included, and return it as read back.

    The rows go to a new version folder first and the table is then pointed to it, so a failed
    write leaves the old table as it was, and a query that runs keeps the files it began with.
    Versions stay until the folder is cleaned up.
    """
    spark = df.sparkSession
    database, _, name = table.rpartition(".")
    root = spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    version = f"{root.rstrip('/')}/{name}/version-{uuid4().hex}"
    writer = df.write.format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(version)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    parts = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
    # only entries of the catalog change from here on; the files of the old version are no longer the table's
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING {fmt}{parts} LOCATION '{version}'")
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def with_run_columns(df: DataFrame, run_id: str, run_date: str) -> DataFrame:
    """Audit columns from the job's parameters."""
    return df.withColumns({"pipeline_run_id": F.lit(run_id), "run_date": F.to_date(F.lit(run_date))})


def create_serving_tables(spark: SparkSession, database: str, by_run: bool = False) -> None:
    """The serving tables; ``by_run`` adds a column ``run_id`` for :func:`append_run`."""
    run = ", run_id STRING) USING parquet PARTITIONED BY (run_id)" if by_run else ") USING parquet"
    for table, columns in SERVING_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}{run}")


def _fit(df: DataFrame, table: str) -> DataFrame:
    """Cast to the columns of a serving table and stamp the load time."""
    columns = [c.strip().split(" ") for c in SERVING_TABLES[table].split(",")]
    *data, (stamp, _) = columns
    return df.select(
        *[
            (whole_number(F.col(name)) if kind.lower() == "int" else F.col(name).try_cast(kind)).alias(name)
            for name, kind in data
        ],
        F.current_timestamp().alias(stamp)
    )


def transactions_rows(df: DataFrame) -> DataFrame:
    """Raw or silver transactions in the shape of ``sales_transactions``.

    Absent numbers load as 0; text that is no number of the column's kind loads as null.
    """
    named = df.toDF(*[snake_case(c) for c in df.columns])
    numbers = ["age", "quantity", "price_per_unit", "total_amount"]
    present = {c: F.coalesce(F.col(c), F.lit("0").cast(named.schema[c].dataType)) for c in numbers}
    return _fit(named.withColumns(present), "sales_transactions").na.fill(
        "", ["transaction_id", "customer_id", "gender", "product_category"]
    )


def forecast_rows(df: DataFrame, model_version: str = "gbt_v1") -> DataFrame:
    return _fit(
        df.select(
            F.col("date").alias("forecast_date"),
            "product_category",
            "predicted_revenue",
            F.lit(model_version).alias("model_version"),
        ),
        "daily_forecasts",
    )


def anomaly_rows(df: DataFrame) -> DataFrame:
    return _fit(df.withColumnRenamed("date", "record_date"), "anomaly_records").na.fill(
        0, ["daily_revenue", "anomaly_score", "anomaly_flag", "revenue_z_score"]
    )


def append_table(rows: DataFrame, table: str) -> None:
    """Append one job's rows; the commit is per job, so a lost executor adds nothing twice."""
    rows.write.mode("append").insertInto(table)


def append_run(rows: DataFrame, table: str, run_id: str) -> None:
    """Append the rows of one run to a table made ``by_run``; a run that is repeated replaces its own rows.

    Other runs are not touched; a repeated run without rows leaves none.
    """
    name = run_id.replace("\\", "\\\\").replace("'", "\\'")
    rows.sparkSession.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (run_id = '{name}') SELECT * FROM {{rows}}", rows=rows)


def append_jdbc(rows: DataFrame, url: str, table: str, batch_size: int = 10_000, connections: int = 16) -> None:
    """Append over JDBC in batches, one transaction per partition.

    A task that dies after its commit is run again and would repeat its rows, so point this
    at a load table keyed by run and merge from there.
    """
    rows.repartition(connections).write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize=batch_size
    ).save()
