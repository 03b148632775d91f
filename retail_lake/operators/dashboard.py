"""Dashboard measures over the gold tables, and the documented alert rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_lake.functions.encode import safe_divide


def totals(daily: DataFrame, month: int | None = None) -> DataFrame:
    """Sum and average of daily revenue per category and over all; ``month`` is the slicer."""
    if month is not None:
        daily = daily.where(F.col("month") == month)
    summed = daily.groupingSets([[], ["product_category"]], "product_category").agg(
        F.grouping("product_category").alias("_all"),
        F.round(F.sum("daily_revenue"), 2).alias("total_revenue"),
        F.avg("daily_revenue").alias("avg_daily_revenue"),
        F.count(F.lit(1)).alias("days"),
    )
    return summed.select(
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("product_category")).alias("product_category"),
        "total_revenue", "avg_daily_revenue", "days",
    )


def month_growth(monthly: DataFrame) -> DataFrame:
    """Growth in percent over the calendar month before, per category and over all; 0 without revenue in that month.

    Windows run over months, of which a category has a few hundred at most.
    """
    revenue = monthly.groupingSets([["year_month"], ["year_month", "product_category"]], "year_month", "product_category")
    revenue = revenue.agg(
        F.grouping("product_category").alias("_all"), F.sum("monthly_revenue").alias("monthly_revenue")
    ).select(
        "year_month",
        F.when(F.col("_all") == 1, "(all)").otherwise(F.col("product_category")).alias("product_category"),
        "monthly_revenue",
    )
    month = F.substring("year_month", 1, 4).cast("int") * 12 + F.substring("year_month", 6, 2).cast("int")
    before = Window.partitionBy("product_category").orderBy("_month").rangeBetween(-1, -1)
    revenue = revenue.withColumn("_month", month)
    return revenue.withColumn("previous_revenue", F.sum("monthly_revenue").over(before)).select(
        "year_month",
        "product_category",
        F.round("monthly_revenue", 2).alias("monthly_revenue"),
        F.round("previous_revenue", 2).alias("previous_revenue"),
        (safe_divide(F.col("monthly_revenue") - F.col("previous_revenue"), F.col("previous_revenue")) * 100).alias(
            "growth_percent"
        ),
    )


def shares(monthly: DataFrame, segments: DataFrame) -> DataFrame:
    """Revenue share per category, and transaction share per gender within each category."""
    by_category = monthly.groupBy(F.lit("revenue by category").alias("measure"), F.lit("(all)").alias("within"),
                                  F.col("product_category").alias("member"))
    by_category = by_category.agg(F.sum("monthly_revenue").alias("amount"))
    by_gender = segments.groupBy(F.lit("transactions by gender").alias("measure"),
                                 F.col("product_category").alias("within"), F.col("gender").alias("member"))
    by_gender = by_gender.agg(F.sum("transaction_count").cast("double").alias("amount"))
    whole = F.sum("amount").over(Window.partitionBy("measure", "within"))
    return by_category.unionByName(by_gender).select(
        "measure", "within", "member",
        F.round("amount", 2).alias("amount"),
        (safe_divide(F.col("amount"), whole) * 100).alias("share_percent"),
    )


def monthly_cards(monthly: DataFrame) -> DataFrame:
    """Total revenue and average transaction per category: the plain mean of the monthly averages beside the weighted one."""
    return monthly.groupBy("product_category").agg(
        F.round(F.sum("monthly_revenue"), 2).alias("total_revenue"),
        F.avg("avg_transaction_value").alias("avg_transaction_unweighted"),
        (F.sum("monthly_revenue") / F.sum("monthly_transactions")).alias("avg_transaction"),
    )


def segment_cuts(segments: DataFrame) -> DataFrame:
    """Revenue and spend by age band, by age band and category, and by category and gender.

    ``avg_spend`` is the mean of the segment averages, as a chart over the table shows it;
    ``avg_spend_weighted`` is the mean over transactions.
    """
    keys = ["product_category", "gender", "age_group"]
    sets = [["age_group"], ["product_category", "age_group"], ["product_category", "gender"]]
    cut = segments.groupingSets(sets, *keys).agg(
        F.round(F.sum("total_revenue"), 2).alias("total_revenue"),
        F.sum("transaction_count").alias("transaction_count"),
        F.avg("avg_spend").alias("avg_spend"),
        (F.sum("total_revenue") / F.sum("transaction_count")).alias("avg_spend_weighted"),
        *[F.grouping(k).alias(f"_{k}") for k in keys],
    )
    labels = [F.when(F.col(f"_{k}") == 1, "(all)").otherwise(F.col(k)).alias(k) for k in keys]
    return cut.select(*labels, "total_revenue", "transaction_count", "avg_spend", "avg_spend_weighted")


def anomaly_runs(scored: DataFrame) -> DataFrame:
    """Runs of consecutive flagged days per category; two or more days in a row escalate.

    Only flagged days enter the window, at most one per category and calendar day.
    """
    place = F.row_number().over(Window.partitionBy("product_category").orderBy("date"))
    runs = scored.where("anomaly_flag = 1").withColumn("_run", F.date_sub("date", place))
    return (
        runs.groupBy("product_category", "_run")
        .agg(
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
            F.count(F.lit(1)).alias("days"),
            F.max("revenue_z_score").alias("max_z"),
        )
        .withColumn("escalate", (F.col("days") >= 2).cast("int"))
        .drop("_run")
    )


def alert_tiers(scored: DataFrame) -> DataFrame:
    """Actions of the alert policy per scored day: score tiers and the pricing review by z-score."""
    # Score thresholds and the z-score threshold of the alert policy.
    score, z = F.col("anomaly_score"), F.col("revenue_z_score")
    action = F.when(score > 0.65, "stock audit").when(score > 0.55, "alert manager").otherwise("none")
    return scored.withColumns(
        {"alert_action": action, "pricing_review": F.coalesce((z > 3.0).cast("int"), F.lit(0))}
    )


def reorder_signal(features: DataFrame, share: float = 0.6) -> DataFrame:
    """Days on which the 7-day mean is below ``share`` of that month's mean; a window holds one month."""
    month = Window.partitionBy("product_category", F.trunc("date", "month"))
    mean = F.avg("daily_revenue").over(month)
    return features.select("date", "product_category", "rolling_mean_7", mean.alias("monthly_mean")).withColumn(
        "reorder", F.coalesce((F.col("rolling_mean_7") < share * F.col("monthly_mean")).cast("int"), F.lit(0))
    )
