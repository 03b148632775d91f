import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retail_lake.operators import anomaly, forecast, metrics
from retail_lake.plans import training
from retail_lake.schema import CATEGORIES, FORECAST_FEATURES, LEAK_FREE_FEATURES
from retail_lake.sources.star_schema import transactions

SF_DIR = "/root/testdata/sf0.001"
FEW = {"maxIter": 5}


@pytest.fixture(scope="module")
def trained(spark):
    return training.train(transactions(spark, SF_DIR), forest={"trees": 30}, **FEW)


def test_forest_scores_and_share(trained):
    scored = trained.scored.agg(
        F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"),
        F.avg("anomaly_flag").alias("share"), F.count(F.lit(1)).alias("n"),
    ).first()
    assert 0 < scored.low <= scored.high <= 1
    assert scored.share <= 0.05 + 1 / scored.n and scored.share > 0.03


def test_forest_is_the_same_however_rows_are_spread(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    one = anomaly.fit(df.repartition(1), ["id"], ["a", "b"], trees=10)
    many = anomaly.fit(df.repartition(7), ["id"], ["a", "b"], trees=10)
    np.testing.assert_array_equal(one.feature, many.feature)
    np.testing.assert_allclose(one.cut, many.cut)


def test_forest_finds_the_outlier(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(500, 2)))] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    scored, forest = anomaly.detect(df, ["id"], features=["a", "b"], trees=50)
    assert scored.orderBy(F.desc("anomaly_score")).first().id == 999
    assert forest.sample_rows == 256 and scored.where("id = 999").first().anomaly_flag == 1


def test_scores_equal_a_walk_through_the_trees(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = anomaly.fit(df, ["id"], ["a", "b"], trees=5)

    def depth(t, x, node=0):
        f = forest.feature[t, node]
        if f < 0:
            return forest.path[t, node]
        return depth(t, x, 2 * node + 1 + int(x[f] > forest.cut[t, node]))

    got = {r.id: r.anomaly_score for r in anomaly.score(df, forest).collect()}
    for i, *values in rows:
        x = (np.array(values) - forest.means) / forest.stds
        mean = np.mean([depth(t, x) for t in range(5)])
        assert got[i] == pytest.approx(2 ** (-mean / float(anomaly.mean_path(40))))


def test_mean_path_values():
    assert list(anomaly.mean_path([0, 1, 2])) == [0.0, 0.0, 1.0]
    assert float(anomaly.mean_path(256)) == pytest.approx(10.2448, abs=1e-4)


def test_constant_column_and_tiny_input(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 1.0)], "id long, a double")
    scored, _ = anomaly.detect(df, ["id"], features=["a"], trees=3)
    assert scored.agg(F.sum("anomaly_flag")).first()[0] == 0
    with pytest.raises(ValueError):
        anomaly.fit(df.limit(1), ["id"], ["a"])


def test_standardised_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in anomaly.standardise(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_holds_out_four_weeks(trained):
    split = forecast.time_split(trained.features, tune_weeks=4)
    days = {r.split: r.days for r in split.groupBy("split").agg(F.count_distinct("date").alias("days")).collect()}
    assert days["validation"] == 28 and days["tune"] == 28


def test_models_survive_saving(spark, trained, tmp_path):
    training.save(spark, trained, str(tmp_path))
    model, detector = training.load(spark, str(tmp_path))
    assert detector.threshold == trained.detector.threshold
    np.testing.assert_array_equal(detector.feature, trained.detector.feature)
    some = trained.features.limit(20)
    a = forecast.predict(some, model).orderBy("product_category", "date").toPandas()["prediction"]
    b = forecast.predict(some, trained.model).orderBy("product_category", "date").toPandas()["prediction"]
    pd.testing.assert_series_equal(a, b)


def test_missing_inputs_are_named(spark, trained):
    split = forecast.time_split(trained.features).drop("lag_7")
    with pytest.raises(ValueError, match="lag_7"):
        forecast.fit(split, **FEW)


@pytest.mark.parametrize("category,days", [("Beauty", 7), ("Electronics", 14), ("Clothing", 3), ("Clothing", 5)])
def test_forecast_requests(trained, category, days):
    rows = forecast.forecast(trained.features, trained.model, days, category).collect()
    assert len(rows) == days and all(r.predicted_revenue >= 0 for r in rows)
    assert {(r.product_category, r.anomaly_flag, r.anomaly_score) for r in rows} == {(category, 0, None)}
    last = trained.features.agg(F.max("date")).first()[0]
    assert sorted(r.date for r in rows) == [last + dt.timedelta(days=i + 1) for i in range(days)]


@pytest.mark.parametrize("category,days", [("Furniture", 7), ("Beauty", 99), ("Beauty", 0)])
def test_bad_requests(trained, category, days):
    with pytest.raises(ValueError):
        forecast.forecast(trained.features, trained.model, days, category)


@pytest.mark.parametrize("mode", ["chain", "calendar"])
def test_steps_equal_a_loop_over_days(spark, trained, mode):
    """The one-pass forecast against a plain loop that predicts one day at a time."""
    days = 4
    got = {
        r.step: r.predicted_revenue
        for r in forecast.forecast(trained.features, trained.model, days, "Beauty", lag_mode=mode).collect()
    }
    history = trained.features.where("product_category = 'Beauty'").orderBy("date").toPandas()
    row, past = history.iloc[-1].copy(), list(history["daily_revenue"])
    lag = [past[-1], past[-7], past[-14]]
    for step in range(1, days + 1):
        day = pd.Timestamp(row["date"]) + pd.Timedelta(days=step)
        if mode == "calendar":
            lag = [past[-1], past[-7], past[-14]]
        x = {c: row[c] for c in FORECAST_FEATURES}
        x |= dict(zip(["lag_1", "lag_7", "lag_14"], lag))
        if mode == "calendar":
            for n in (7, 14):
                x[f"rolling_mean_{n}"], x[f"rolling_std_{n}"] = np.mean(past[-n:]), np.std(past[-n:], ddof=1)
            x["rolling_max_7"], x["rolling_min_7"] = max(past[-7:]), min(past[-7:])
        x |= {
            "Year": day.year, "Month": day.month, "Day": day.day, "DayOfWeek": day.dayofweek,
            "WeekOfYear": day.isocalendar().week, "DayOfYear": day.dayofyear, "Quarter": day.quarter,
            "IsWeekend": int(day.dayofweek >= 5), "IsMonthStart": int(day.day <= 5), "IsMonthEnd": int(day.day >= 25),
            "revenue_z_score": 0.0, "pct_from_rolling_mean": 0.0,
        }
        frame = spark.createDataFrame(pd.DataFrame([{k: float(v) for k, v in x.items()}]))
        value = max(0.0, round(trained.model.transform(frame).first().prediction, 2))
        assert got[step] == pytest.approx(value, abs=0.011), step
        past.append(got[step])
        lag = [got[step], lag[0], lag[1]]


def test_forecast_days_are_scored(trained):
    rows = forecast.forecast(trained.features, trained.model, 3, detector=trained.detector).collect()
    assert len(rows) == 3 * len(CATEGORIES) and all(0 < r.anomaly_score <= 1 for r in rows)


def test_summary_prefers_the_earlier_day(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", d + dt.timedelta(days=i), v, f) for i, (v, f) in enumerate([(5.0, 0), (9.0, 1), (9.0, 1), (5.0, 0)])]
    df = spark.createDataFrame(rows, "product_category string, date date, predicted_revenue double, anomaly_flag int")
    s = forecast.forecast_summary(df).first()
    assert (s.total_predicted_revenue, s.avg_daily_revenue, s.max_day, s.min_day) == (28.0, 7.0, dt.date(2024, 1, 2), d)
    assert s.anomaly_days_count == 2 and s.anomaly_days == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)]


def test_forecast_text(trained):
    blocks = forecast.forecast_context(forecast.forecast(trained.features, trained.model, 2)).collect()
    assert len(blocks) == 3 and all(b.context.count("\n") == 3 and "Avg/day" in b.context for b in blocks)


def test_short_series_repeat_their_last_value(spark, trained):
    short = trained.features.where("product_category = 'Beauty'").orderBy("date").limit(5)
    r = forecast.latest_actuals(short).first()
    assert r.lag_1 == r.lag_7 == r.lag_14 and len(r.recent) == 5


def test_other_feature_lists_and_stop_rules(trained):
    split = forecast.time_split(trained.features)
    model = forecast.fit(split, LEAK_FREE_FEATURES, stop_on="validation", **FEW)
    assert model.stages[0].getInputCols() == LEAK_FREE_FEATURES
    model = forecast.fit(split, stop_on=None, **FEW)
    assert model.stages[-1].getNumTrees == FEW["maxIter"]


def test_reported_errors_cover_all_splits(trained):
    assert {r.split for r in trained.metrics.collect()} == {"train", "tune", "validation"}


def test_report_on_scored_rows(trained):
    top = metrics.top_anomalies(trained.scored, n=10).collect()
    assert len(top) == 10 and top[0].anomaly_score >= top[-1].anomaly_score
    table = anomaly.export_table(trained.scored)
    assert len(table.columns) == 17


def test_bad_features_stop_training(spark):
    with pytest.raises(ValueError, match="rows"):
        training.train(transactions(spark, SF_DIR).where("date < '1995-02-20'"), **FEW)


def test_rule_of_the_best_prefix():
    assert forecast.best_prefix([5.0, 4.0, 4.5, 3.0, 3.5], patience=30) == 4
    assert forecast.best_prefix([5.0, 4.0, 4.5, 4.2, 3.0], patience=2) == 2
    assert forecast.best_prefix([3.0, 3.0], patience=30) == 1


def test_kept_prefix_is_the_best_for_the_tune_rows(trained):
    split = forecast.time_split(trained.features, tune_weeks=forecast.TEST_WEEKS)
    settings = {"maxIter": 12, "stepSize": 0.9, "maxDepth": 6}  # overfits soon
    model, losses = forecast.fit_prefix(split, **settings)
    kept = model.stages[-1].getNumTrees
    assert len(losses) == 12 and kept == forecast.best_prefix(losses) < 12
    tune = split.where("split = 'tune'")
    error = lambda m: forecast.predict(tune, m).agg(F.avg((F.col("prediction") - F.col("daily_revenue")) ** 2)).first()[0]
    assert error(model) == pytest.approx(min(losses), rel=1e-9)
    assert error(model) <= error(forecast.fit(split, stop_on=None, **settings))
    whole, none = forecast.fit_prefix(split.where("split <> 'tune'"), **settings)
    assert whole.stages[-1].getNumTrees == 12 and none == []
