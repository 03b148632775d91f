import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_lake.functions.series import drop_history, rolling_columns, run_window, split_runs
from retail_lake.operators import dashboard, features, metrics, quality

DAY0 = dt.date(2023, 1, 1)
DAILY = "date date, product_category string, daily_revenue double, daily_quantity long, transaction_count long, avg_price double, avg_age double, female_ratio double"


def daily(spark, revenue: dict[str, list[float | None]]):
    """One row per category and listed value; None leaves the day out."""
    rows = [
        (DAY0 + dt.timedelta(days=i), c, float(v), 1, 1, 1.0, 30.0, 0.5)
        for c, values in revenue.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, DAILY)


def test_grid_fills_only_added_days(spark):
    df = daily(spark, {"Beauty": [5, None, 7], "Toys": [1, 1, 1]})
    df = df.withColumn("avg_age", F.when(F.col("date") == F.lit(DAY0), F.lit(None)).otherwise(F.col("avg_age")))
    grid = features.dense_grid(df, ["Beauty", "Clothing"]).orderBy("product_category", "date").collect()
    assert [(r.product_category, r.daily_revenue, r.avg_age) for r in grid] == [
        ("Beauty", 5.0, None), ("Beauty", 0.0, 0.0), ("Beauty", 7.0, 30.0),
        ("Clothing", 0.0, 0.0), ("Clothing", 0.0, 0.0), ("Clothing", 0.0, 0.0),
    ]
    assert features.dense_grid(df, None).select("product_category").distinct().count() == 2


def test_two_transactions_give_six_cells(spark):
    df = daily(spark, {"Beauty": [100], "Electronics": [None, 300]})
    assert features.dense_grid(df).count() == 6


def test_rolling_values_by_hand(spark):
    grid = features.dense_grid(daily(spark, {"Beauty": [100.0 * i for i in range(20)]}), ["Beauty"])
    rows = features.with_lags_and_rolling(grid).orderBy("date").collect()
    assert rows[0].rolling_mean_7 is None and rows[0].rolling_std_7 == 0.0 and rows[0].lag_1 is None
    assert (rows[1].rolling_mean_7, rows[1].rolling_std_7) == (0.0, 0.0)
    assert rows[2].rolling_mean_7 == 50.0 and math.isclose(rows[2].rolling_std_7, 70.7107, abs_tol=1e-4)
    assert (rows[15].lag_1, rows[15].lag_7, rows[15].lag_14) == (1400.0, 800.0, 100.0)


@pytest.mark.parametrize("run_days", [15, 20, 366])
def test_runs_do_not_change_any_value(spark, run_days):
    rng = np.random.default_rng(7)
    values = {c: list(rng.integers(0, 1000, 120).astype(float)) for c in ("Beauty", "Clothing")}
    grid = features.dense_grid(daily(spark, values), ["Beauty", "Clothing"])
    got = features.with_lags_and_rolling(grid, run_days).orderBy("product_category", "date").toPandas()
    for c, series in values.items():
        mine = got[got.product_category == c].reset_index(drop=True)
        y = pd.Series(series)
        past = y.shift(1)
        for n in (1, 7, 14):
            np.testing.assert_allclose(mine[f"lag_{n}"], y.shift(n))
        for n in (7, 14):
            np.testing.assert_allclose(mine[f"rolling_mean_{n}"], past.rolling(n, min_periods=1).mean())
            np.testing.assert_allclose(
                mine[f"rolling_std_{n}"], past.rolling(n, min_periods=1).std().fillna(0), atol=1e-9
            )
        np.testing.assert_allclose(mine["rolling_max_7"], past.rolling(7, min_periods=1).max())
        np.testing.assert_allclose(mine["rolling_min_7"], past.rolling(7, min_periods=1).min())


def test_one_series_spreads_over_several_tasks(spark):
    grid = features.dense_grid(daily(spark, {"Beauty": [1.0] * 400}), ["Beauty"])
    runs = split_runs(grid, "date", 14, 50)
    assert runs.select("_run").distinct().count() >= 8
    assert drop_history(runs).count() == 400
    with pytest.raises(ValueError):
        split_runs(grid, "date", 14, 14)


def test_runs_before_1970(spark):
    df = spark.range(40).select(
        F.date_add(F.lit("1969-12-15").cast("date"), F.col("id").cast("int")).alias("date"),
        F.lit("a").alias("product_category"), F.col("id").cast("double").alias("daily_revenue"),
    )
    w = run_window("product_category", "date")
    split = split_runs(df, "date", 14, 16).withColumns(rolling_columns("daily_revenue", w, [7], [7]))
    plain = Window.partitionBy("product_category").orderBy("date")
    whole = df.withColumns(rolling_columns("daily_revenue", plain, [7], [7]))
    assert drop_history(split).orderBy("date").collect() == whole.orderBy("date").collect()


def test_constant_series_has_zero_deviation(spark):
    grid = features.dense_grid(daily(spark, {"Beauty": [50.0] * 20}), ["Beauty"])
    rows = features.with_deviation(features.with_lags_and_rolling(grid)).collect()
    assert {r.revenue_z_score for r in rows} == {0.0} and {r.rolling_std_7 for r in rows} == {0.0}


def test_feature_table_has_33_columns_and_no_warm_up(spark):
    from retail_lake.schema import ANOMALY_FEATURES, FORECAST_FEATURES, LEAK_FREE_FEATURES

    tx = spark.range(3000).select(
        F.concat(F.lit("T"), "id").alias("transaction_id"),
        F.date_add(F.lit(DAY0), (F.col("id") % 120).cast("int")).alias("date"),
        F.lit("F").alias("gender"), F.lit(30).alias("age"),
        F.element_at(F.array(*map(F.lit, ["Beauty", "Clothing", "Electronics"])), (F.col("id") % 3 + 1).cast("int")).alias("product_category"),
        F.lit(2).alias("quantity"), F.lit(5.0).alias("price_per_unit"), F.lit(10).cast("decimal(18,2)").alias("total_amount"),
    )
    table = features.feature_table(tx)
    assert len(table.columns) == 33 and table.count() == 3 * (120 - 14)
    assert set(FORECAST_FEATURES) | set(ANOMALY_FEATURES) <= set(table.columns)
    assert len(FORECAST_FEATURES) == 29 and len(ANOMALY_FEATURES) == 16 and len(LEAK_FREE_FEATURES) == 23
    assert {r.check_name: r.passed for r in quality.expectations(table).collect()}["null lag_14"] == 1


def test_expectations_report_failures(spark):
    grid = features.dense_grid(daily(spark, {"Beauty": [1.0] * 20}), ["Beauty"])
    report = quality.expectations(features.with_lags_and_rolling(grid))
    got = {r.check_name: (r.passed, r.observed) for r in report.collect()}
    assert got["rows"] == (0, 20.0) and got["categories"] == (0, 1.0) and got["null lag_14"] == (0, 14.0)
    assert got["missing model inputs"][0] == 0 and got["negative revenue"] == (1, 0.0)


def test_metrics_skip_days_without_sales_in_mape(spark):
    df = spark.createDataFrame(
        [("train", "a", 100.0, 90.0), ("train", "a", 0.0, 10.0)],
        "split string, product_category string, daily_revenue double, prediction double",
    )
    rows = {r.product_category: r for r in metrics.forecast_metrics(df).collect()}
    assert (rows["a"].mae, rows["a"].rmse, rows["a"].mape) == (10.0, 10.0, 10.0) and rows["(all)"].rows == 2


def test_runs_of_anomalies_escalate(spark):
    days = [0, 1, 2, 5, 9, 10]
    df = spark.createDataFrame(
        [("a", DAY0 + dt.timedelta(days=i), int(i in days), float(i)) for i in range(12)],
        "product_category string, date date, anomaly_flag int, revenue_z_score double",
    )
    runs = dashboard.anomaly_runs(df).orderBy("first_day").collect()
    assert [(r.days, r.escalate, r.max_z) for r in runs] == [(3, 1, 2.0), (1, 0, 5.0), (2, 1, 10.0)]


def test_growth_starts_at_zero(spark):
    df = spark.createDataFrame(
        [("2023-01", "a", 100.0), ("2023-02", "a", 150.0), ("2023-02", "b", 50.0)],
        "year_month string, product_category string, monthly_revenue double",
    )
    got = {(r.year_month, r.product_category): r.growth_percent for r in dashboard.month_growth(df).collect()}
    assert got[("2023-01", "(all)")] == 0.0 and got[("2023-02", "(all)")] == 100.0 and got[("2023-02", "a")] == 50.0


def test_z_flag_takes_limits_per_category(spark):
    df = spark.createDataFrame([("a", 3.5), ("b", 3.5), ("a", None)], "product_category string, revenue_z_score double")
    flags = [r.anomaly_flag for r in features.z_flag(df, 3.0, {"b": 4.0}).collect()]
    assert flags == [1, 0, 0]
