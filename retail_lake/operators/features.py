"""Daily series per category: aggregate, dense calendar, lags, rolling statistics, deviations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.dates import feature_calendar
from retail_lake.functions.encode import category_code, one_hot, or_one
from retail_lake.functions.series import drop_history, rolling_columns, run_window, split_runs
from retail_lake.operators.gold import female_share
from retail_lake.schema import CATEGORIES
from retail_lake.staging import stage

# Lags and rolling windows in days.
LAGS = [1, 7, 14]
MEANS = [7, 14]
SPREAD = [7]
HISTORY_DAYS = max(LAGS + MEANS + SPREAD)
# Days per task of one series; any length above HISTORY_DAYS gives the same result.
RUN_DAYS = 366

MEASURES = ["daily_revenue", "daily_quantity", "transaction_count", "avg_price", "avg_age", "female_ratio"]


def daily_features(tx: DataFrame) -> DataFrame:
    """One row per day and category with sales; the gender share needs no second aggregate."""
    return (
        tx.where(F.col("date").isNotNull() & F.col("product_category").isNotNull())
        .groupBy("date", "product_category")
        .agg(
            F.coalesce(F.sum("total_amount").cast("double"), F.lit(0.0)).alias("daily_revenue"),
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("daily_quantity"),
            F.count("transaction_id").alias("transaction_count"),
            F.avg("price_per_unit").alias("avg_price"),
            F.avg("age").alias("avg_age"),
            female_share().alias("female_ratio"),
        )
    )


def dense_grid(daily: DataFrame, categories: list[str] | None = CATEGORIES) -> DataFrame:
    """Every day of the range for every category, with zeros on the days the grid adds.

    ``daily`` is read three times here (range, categories, values), so pass a staged frame.
    ``categories=None`` takes all that occur; a list drops the others.
    """
    bounds = daily.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    if categories is None:
        series = daily.select("product_category").distinct()
    else:
        listed = F.explode(F.array(*map(F.lit, categories)))
        series = daily.sparkSession.range(1).select(listed.alias("product_category"))
    day_range = F.sequence(F.col("b.lo"), F.col("b.hi"), F.expr("interval 1 day"))
    grid = series.withColumn("b", bounds).select("product_category", F.explode(day_range).alias("date"))
    joined = grid.join(daily.withColumn("_sold", F.lit(True)), ["date", "product_category"], "left")
    added = F.col("_sold").isNull()
    filled = [F.when(added, F.lit(0).cast(daily.schema[m].dataType)).otherwise(F.col(m)).alias(m) for m in MEASURES]
    return joined.select("date", "product_category", *filled)


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(feature_calendar("date"))


def with_encodings(df: DataFrame, unknown_code: int = 0) -> DataFrame:
    return df.withColumns(
        {
            "category_encoded": category_code("product_category", unknown_code=unknown_code),
            **one_hot("product_category"),
        }
    )


def with_lags_and_rolling(grid: DataFrame, run_days: int = RUN_DAYS) -> DataFrame:
    """Lags and rolling statistics of revenue; all windows share one shuffle and one sort."""
    runs = split_runs(grid, "date", HISTORY_DAYS, run_days)
    w = run_window("product_category", "date")
    lags = {f"lag_{n}": F.lag("daily_revenue", n).over(w) for n in LAGS}
    return drop_history(runs.withColumns({**lags, **rolling_columns("daily_revenue", w, MEANS, SPREAD)}))


def with_deviation(df: DataFrame) -> DataFrame:
    """Distance from the category mean (in sample deviations) and from the rolling mean.

    Mean and deviation come from a grouped aggregate joined back, not from an unbounded
    window, so no task has to hold a whole series.
    """
    stats = df.groupBy("product_category").agg(
        F.avg("daily_revenue").alias("_mean"), F.stddev_samp("daily_revenue").alias("_std")
    )
    revenue, rolling = F.col("daily_revenue"), F.col("rolling_mean_7")
    return (
        df.join(stats, "product_category")
        .withColumns(
            {
                "revenue_z_score": (revenue - F.col("_mean")) / or_one(F.col("_std")),
                "pct_from_rolling_mean": (revenue - rolling) / or_one(rolling),
            }
        )
        .drop("_mean", "_std")
    )


def drop_warm_up(df: DataFrame) -> DataFrame:
    return df.dropna(subset=[f"lag_{n}" for n in LAGS])


def series_features(tx: DataFrame, categories: list[str] | None = CATEGORIES) -> DataFrame:
    """All feature columns for every day, warm-up days included.

    The daily aggregate is the only step that sees all transactions; it is staged, so the
    transactions are read once however often the small series is read afterwards.
    """
    grid = dense_grid(stage(daily_features(tx)), categories)
    return with_deviation(with_encodings(with_calendar(with_lags_and_rolling(grid))))


def feature_table(tx: DataFrame, categories: list[str] | None = CATEGORIES) -> DataFrame:
    """The model input table: one row per category and day, from the 15th day on."""
    return drop_warm_up(series_features(tx, categories))


def export_names(features: DataFrame) -> DataFrame:
    """Key columns under the names used in exported files."""
    return features.withColumnsRenamed({"date": "Date", "product_category": "Product Category"})


def z_flag(features: DataFrame, threshold: float = 3.0, by_category: dict[str, float] | None = None) -> DataFrame:
    """Add ``anomaly_flag`` by the z-score rule, with other thresholds for some categories."""
    limit = F.lit(float(threshold))
    for category, value in (by_category or {}).items():
        limit = F.when(F.col("product_category") == category, F.lit(float(value))).otherwise(limit)
    return features.withColumn(
        "anomaly_flag", F.coalesce((F.col("revenue_z_score") > limit).cast("int"), F.lit(0))
    )
