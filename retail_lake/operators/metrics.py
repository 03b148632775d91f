"""Summary statistics, forecast errors and anomaly reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.encode import safe_divide
from retail_lake.functions.quantiles import exact_quantiles
from retail_lake.operators.quality import long_rows

# Percentiles of the anomaly score report.
SCORE_PERCENTILES = [50, 75, 90, 95, 99]


def sales_summary(daily: DataFrame, year: int | None = None) -> DataFrame:
    """Sum, mean, max and min of daily revenue per category, for one year if given."""
    if year is not None:
        # A date range, unlike year(date) = y, reaches the file scan of a stored table.
        daily = daily.where(F.col("date").between(f"{year}-01-01", f"{year}-12-31"))
    r = F.col("daily_revenue")
    return daily.groupBy("product_category").agg(
        F.round(F.sum(r), 2).alias("revenue_sum"),
        F.round(F.avg(r), 2).alias("revenue_mean"),
        F.round(F.max(r), 2).alias("revenue_max"),
        F.round(F.min(r), 2).alias("revenue_min"),
    )


def monthly_pivot(daily: DataFrame, categories: list[str], year: int | None = None) -> DataFrame:
    """Revenue by calendar month (rows) and category (columns), zero where nothing was sold."""
    if year is not None:
        daily = daily.where(F.col("date").between(f"{year}-01-01", f"{year}-12-31"))
    months = daily.select(
        F.month("date").alias("month_no"), F.date_format("date", "MMMM").alias("month_name"),
        "product_category", "daily_revenue",
    )
    table = months.groupBy("month_no", "month_name").pivot("product_category", categories).agg(
        F.round(F.sum("daily_revenue"), 2)
    )
    return table.na.fill(0.0, categories)


def percentiles(df: DataFrame, column: str, points: list[int] = SCORE_PERCENTILES) -> DataFrame:
    """Rows (percentile, value), linearly interpolated."""
    wide = exact_quantiles(df, column, [p / 100 for p in points])
    return long_rows(
        wide, [{"percentile": F.lit(p), "value": F.col(f"q{i}")} for i, p in enumerate(points)]
    )


def describe(df: DataFrame, column: str) -> DataFrame:
    """Rows (statistic, value): count, mean, std, min, quartiles, max."""
    c = F.col(column)
    basic = df.agg(
        F.struct(
            F.count(c).cast("double").alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
        )
    ).scalar()
    quartiles = {"q0": "25%", "q1": "50%", "q2": "75%"}
    wide = exact_quantiles(df, column, [0.25, 0.5, 0.75]).withColumn("s", basic)
    rows = [{"statistic": F.lit(n), "value": F.col(f"s.{n}")} for n in ["count", "mean", "std", "min"]]
    rows += [{"statistic": F.lit(label), "value": F.col(q)} for q, label in quartiles.items()]
    rows += [{"statistic": F.lit("max"), "value": F.col("s.max")}]
    return long_rows(wide, rows)


def forecast_metrics(df: DataFrame, actual: str = "daily_revenue", predicted: str = "prediction") -> DataFrame:
    """MAE, RMSE and MAPE per split, and per split and category; MAPE uses only days with sales."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    scored = df.groupingSets([["split"], ["split", "product_category"]], "split", "product_category").agg(
        F.grouping("product_category").alias("_all"),
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(y > 0, F.abs(e / y))) * 100).alias("mape"),
    )
    return scored.select(
        "split",
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("product_category")).alias("product_category"),
        "rows", "mae", "rmse", "mape",
    )


def anomaly_rate(scored: DataFrame) -> DataFrame:
    counted = scored.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum("anomaly_flag"), F.lit(0)).cast("long").alias("anomalies"),
    )
    share = safe_divide(F.col("anomalies"), F.col("total_records")) * 100
    return counted.withColumns(
        {
            "normal": F.col("total_records") - F.col("anomalies"),
            "anomaly_percent": share,
            "normal_percent": safe_divide(F.col("normal"), F.col("total_records")) * 100,
        }
    )


def anomaly_breakdown(scored: DataFrame) -> DataFrame:
    """Flagged days by category, by month and by weekend, in one aggregate: rows (dimension, member, anomalies)."""
    keys = ["product_category", "Month", "IsWeekend"]
    counts = (
        scored.where("anomaly_flag = 1")
        .groupingSets([[k] for k in keys], *keys)
        .agg(F.grouping_id(*keys).alias("_set"), F.count(F.lit(1)).alias("anomalies"))
    )
    # grouping_id has one bit per key, first key highest; a set bit means "not grouped by it".
    dimension = F.when(F.col("_set") == 3, "category").when(F.col("_set") == 5, "month").otherwise("weekend")
    day_type = F.when(F.col("IsWeekend") == 1, "Weekend").otherwise("Weekday")
    member = (
        F.when(F.col("_set") == 3, F.col("product_category"))
        .when(F.col("_set") == 5, F.col("Month").cast("string"))
        .otherwise(day_type)
    )
    return counts.select(dimension.alias("dimension"), member.alias("member"), "anomalies")


def top_anomalies(scored: DataFrame, by: str = "anomaly_score", n: int = 10) -> DataFrame:
    """The n highest rows by ``by``; date and category decide ties."""
    return scored.orderBy(F.desc(by), "date", "product_category").limit(n)
