"""Demand forecast: time split, boosted trees, recursive multi-day forecast and its summary."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_lake.functions.dates import feature_calendar
from retail_lake.operators import anomaly
from retail_lake.operators.features import with_encodings
from retail_lake.schema import CATEGORIES, FORECAST_FEATURES
from retail_lake.staging import stage

TEST_WEEKS = 4
MAX_DAYS = 14

# What a series without history is taken to have had.
DEFAULTS = {
    "lag_1": 300.0, "lag_7": 300.0, "lag_14": 300.0,
    "rolling_mean_7": 300.0, "rolling_mean_14": 300.0,
    "rolling_std_7": 100.0, "rolling_std_14": 100.0,
    "rolling_max_7": 500.0, "rolling_min_7": 100.0,
    "avg_age": 35.0, "female_ratio": 0.5, "transaction_count": 3.0, "avg_price": 150.0,
}
# Settings of the boosted trees.
BOOSTING = {
    "maxIter": 300,
    "maxDepth": 4,
    "stepSize": 0.05,
    "subsamplingRate": 0.8,
    "featureSubsetStrategy": "0.8",
    "minInstancesPerNode": 2,
    "seed": 42,
}
#: Trees without gain after which no better prefix is looked for.
PATIENCE = 30
LAGS = ["lag_1", "lag_7", "lag_14"]
ROLLING = ["rolling_mean_7", "rolling_mean_14", "rolling_std_7", "rolling_std_14", "rolling_max_7", "rolling_min_7"]
SAME_DAY = ["avg_age", "female_ratio", "transaction_count", "avg_price"]


def time_split(features: DataFrame, test_weeks: int = TEST_WEEKS, tune_weeks: int = 0) -> DataFrame:
    """Add ``split``: validation for the last weeks, tune for the weeks before them if asked, else train."""
    last = features.agg(F.max("date")).scalar()
    cutoff = F.date_sub(last, 7 * test_weeks)
    tune_from = F.date_sub(last, 7 * (test_weeks + tune_weeks))
    return features.withColumn(
        "split",
        F.when(F.col("date") > cutoff, "validation").when(F.col("date") > tune_from, "tune").otherwise("train"),
    )


def split_summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split", "product_category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg("daily_revenue").alias("revenue_mean"),
        F.max("daily_revenue").alias("revenue_max"),
        F.min("daily_revenue").alias("revenue_min"),
    )


def fit(
    split: DataFrame, columns: list[str] = FORECAST_FEATURES, stop_on: str | None = "tune", **settings
) -> PipelineModel:
    """Fit boosted trees on the train rows.

    ``stop_on`` names the split that decides when to stop adding trees.  The default is a
    set of its own, so the validation error stays honest; "validation" stops on the very
    rows that are reported.  None always grows ``maxIter`` trees.
    """
    if missing := [c for c in columns if c not in split.columns]:
        raise ValueError(f"missing model inputs: {missing}")
    used = ["train"] if stop_on is None else ["train", stop_on]
    rows = split.where(F.col("split").isin(used)).na.fill({c: v for c, v in DEFAULTS.items() if c in columns})
    rows = rows.select(*columns, "daily_revenue", (F.col("split") == F.lit(stop_on or "")).alias("is_stop"))
    trees = GBTRegressor(featuresCol="features", labelCol="daily_revenue", **{**BOOSTING, **settings})
    if stop_on is not None:
        trees = trees.setValidationIndicatorCol("is_stop")
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    return Pipeline(stages=[assemble, trees]).fit(rows)


def best_prefix(losses: list[float], patience: int = PATIENCE) -> int:
    """How many trees to keep: up to the least loss that ``patience`` further trees did not undercut."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def fit_prefix(
    split: DataFrame, columns: list[str] = FORECAST_FEATURES, stop_on: str = "tune", patience: int = PATIENCE, **settings
) -> tuple[PipelineModel, list[float]]:
    """Boosted trees on the train rows, kept up to the best number of trees for the rows of ``stop_on``.

    All trees are grown, the mean squared error of every prefix is taken on the ``stop_on`` rows in
    one pass, and the ensemble is grown again with as many trees as ``best_prefix`` says; the same
    seed and the same stored rows give the same first trees.  Returns the model and the errors by
    number of trees.  Without ``stop_on`` rows all trees stay.
    """
    rows = stage(split.where(F.col("split").isin("train", stop_on)))
    train = rows.where("split = 'train'")
    full = fit(train, columns, None, **settings)
    tuning = rows.where(F.col("split") == stop_on)
    if tuning.isEmpty():
        return full, []
    filled = tuning.na.fill({c: v for c, v in DEFAULTS.items() if c in columns})
    losses = full.stages[-1].evaluateEachIteration(full.stages[0].transform(filled), "squared")
    kept = best_prefix(losses, patience)
    return (full if kept == len(losses) else fit(train, columns, None, **{**settings, "maxIter": kept})), losses


def predict(df: DataFrame, model: PipelineModel) -> DataFrame:
    inputs = model.stages[0].getInputCols()
    return model.transform(df.na.fill({c: v for c, v in DEFAULTS.items() if c in inputs})).drop("features")


def feature_importance(model: PipelineModel, spark, n: int = 10) -> DataFrame:
    """The n most important inputs."""
    names, weights = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(names, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(n)


def latest_actuals(features: DataFrame) -> DataFrame:
    """One row per category with what the next day's features start from.

    Shorter series repeat their last value for the lags they do not reach.  ``recent``
    holds the last 14 revenues, oldest first.
    """
    rn = F.row_number().over(Window.partitionBy("product_category").orderBy(F.desc("date")))
    tail = features.withColumn("rn", rn).where(F.col("rn") <= MAX_DAYS)

    def nth(column: str, n: int) -> Column:
        return F.max(F.when(F.col("rn") == n, F.col(column)))

    last = {c: nth(c, 1) for c in [*ROLLING, *SAME_DAY, "daily_quantity"]}
    revenues = F.sort_array(F.collect_list(F.struct((-F.col("rn")).alias("age"), "daily_revenue")))
    return tail.groupBy("product_category").agg(
        nth("date", 1).alias("last_date"),
        nth("daily_revenue", 1).alias("lag_1"),
        F.coalesce(nth("daily_revenue", 7), nth("daily_revenue", 1)).alias("lag_7"),
        F.coalesce(nth("daily_revenue", 14), nth("daily_revenue", 1)).alias("lag_14"),
        *[v.alias(c) for c, v in last.items()],
        F.transform(revenues, lambda r: r["daily_revenue"]).alias("recent"),
    )


def _starting_state(latest: DataFrame) -> DataFrame:
    """Latest values with defaults and encodings; deviations from a value not known yet are 0."""
    return with_encodings(latest.na.fill(DEFAULTS)).withColumns(
        {"revenue_z_score": F.lit(0.0), "pct_from_rolling_mean": F.lit(0.0)}
    )


def _with_day_features(state: DataFrame, day: Column) -> DataFrame:
    return state.withColumns({"date": day, **feature_calendar(day)})


def future_features(latest: DataFrame, days: int = MAX_DAYS) -> DataFrame:
    """Feature rows of the next days of every category, lags as last known."""
    steps = F.sequence(F.lit(1), F.lit(days))
    ahead = _starting_state(latest).withColumn("step", F.explode(steps))
    return _with_day_features(ahead, F.date_add("last_date", F.col("step")))


def check_request(days: int, category: str | None = None, categories: list[str] = CATEGORIES) -> None:
    if category is not None and category not in categories:
        raise ValueError(f"unknown category {category!r}; choose from {categories}")
    if not 1 <= days <= MAX_DAYS:
        raise ValueError(f"days must lie between 1 and {MAX_DAYS}")


def _sum(array: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, v: a + v)


def _with_calendar_state(state: DataFrame) -> DataFrame:
    """Lags and rolling statistics read off ``recent``, the days right before the target day."""
    size = F.size("recent")
    last = F.element_at("recent", -1)
    lags = {
        "lag_1": last,
        "lag_7": F.coalesce(F.try_element_at("recent", F.lit(-7)), last),
        "lag_14": F.coalesce(F.try_element_at("recent", F.lit(-14)), last),
    }
    windows = {f"_w{n}": F.slice("recent", F.greatest(size - n + 1, F.lit(1)), n) for n in (7, 14)}
    # One projection per layer, so that each value is computed once.
    layered = state.withColumns({**lags, **windows}).withColumns(
        {
            **{f"rolling_mean_{n}": _sum(f"_w{n}") / F.size(f"_w{n}") for n in (7, 14)},
            "rolling_max_7": F.array_max("_w7"),
            "rolling_min_7": F.array_min("_w7"),
        }
    )
    return layered.withColumns({f"rolling_std_{n}": _sample_std(f"_w{n}", f"rolling_mean_{n}") for n in (7, 14)})


def _sample_std(array: str, mean: str) -> Column:
    squares = F.aggregate(array, F.lit(0.0), lambda a, v: a + (v - F.col(mean)) * (v - F.col(mean)))
    return F.when(F.size(array) > 1, F.sqrt(squares / (F.size(array) - 1))).otherwise(F.lit(0.0))


def forecast(
    features: DataFrame,
    model: PipelineModel,
    days: int = 7,
    category: str | None = None,
    lag_mode: str = "chain",
    detector: anomaly.Forest | None = None,
) -> DataFrame:
    """Forecast the next days of every category (or one), each day fed by the days before it.

    All series advance together: a series is one row, each day adds one column, and the
    steps are narrow, so the whole horizon is one pass without a shuffle.

    ``lag_mode="chain"`` hands values down (lag_14 <- lag_7 <- lag_1 <- forecast) and keeps
    the rolling statistics of the last known day; "calendar" moves true day lags and
    recomputes the rolling statistics from known and forecast days.

    With a ``detector`` each forecast day is scored with its revenue and the last known
    quantity; without one the flag is 0 and the score null.
    """
    check_request(days, category)
    if lag_mode not in ("chain", "calendar"):
        raise ValueError("lag_mode must be 'chain' or 'calendar'")
    if category is not None:
        features = features.where(F.col("product_category") == category)
    state = _starting_state(latest_actuals(features))
    carried = state.columns
    done: list[str] = []
    for step in range(1, days + 1):
        if lag_mode == "calendar":
            state = _with_calendar_state(state)
        day = _with_day_features(state, F.date_add("last_date", step))
        revenue = F.greatest(F.lit(0.0), F.round("prediction", 2))
        named = model.transform(day).withColumn("_revenue", revenue)
        record = F.struct(
            F.lit(step).alias("step"), F.col("_revenue").alias("predicted_revenue"),
            *[F.col(c) for c in ROLLING],
        )
        if lag_mode == "chain":
            moved = {"lag_14": F.col("lag_7"), "lag_7": F.col("lag_1"), "lag_1": F.col("_revenue")}
        else:
            longer = F.concat("recent", F.array("_revenue"))
            moved = {"recent": F.slice(longer, F.greatest(F.size(longer) - 13, F.lit(1)), 14)}
        state = named.select(*[moved.get(c, F.col(c)).alias(c) for c in carried], *done, record.alias(f"_day{step}"))
        done.append(f"_day{step}")

    known = [c for c in carried if c not in (*LAGS, *ROLLING, "recent")]
    long = state.select(*known, F.inline(F.array(*done))).withColumn("date", F.date_add("last_date", F.col("step")))
    return _with_anomaly(long, detector).select(
        "product_category",
        "step",
        "date",
        F.date_format("date", "EEEE").alias("day_of_week"),
        "predicted_revenue",
        "anomaly_flag",
        "anomaly_score",
    )


def _with_anomaly(long: DataFrame, detector: anomaly.Forest | None) -> DataFrame:
    if detector is None:
        return long.withColumns({"anomaly_flag": F.lit(0), "anomaly_score": F.lit(None).cast("double")})
    rows = long.withColumns({"daily_revenue": F.col("predicted_revenue"), **feature_calendar(F.col("date"))})
    scored = anomaly.flag(anomaly.score(rows, detector), detector.threshold)
    return scored.withColumn("anomaly_score", F.round("anomaly_score", 4))


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Per category: total, daily mean, best and worst day (the earlier one on a tie) and anomalous days."""
    value, day = F.col("predicted_revenue"), F.col("date")
    early = F.struct(value, -F.unix_date(day))
    late = F.struct(value, F.unix_date(day))
    flagged = F.when(F.col("anomaly_flag") == 1, day)
    return forecasts.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("days_ahead"),
        F.round(F.sum(value), 2).alias("total_predicted_revenue"),
        F.round(F.avg(value), 2).alias("avg_daily_revenue"),
        F.max_by(day, early).alias("max_day"),
        F.max(value).alias("max_revenue"),
        F.min_by(day, late).alias("min_day"),
        F.min(value).alias("min_revenue"),
        F.count(flagged).alias("anomaly_days_count"),
        F.array_sort(F.collect_list(flagged)).alias("anomaly_days"),
    )


def forecast_context(forecasts: DataFrame) -> DataFrame:
    """One text block per category: a line per day and a closing total."""
    # Wording and layout of the lines.
    money = F.format_number("predicted_revenue", 0)
    line = F.concat(
        F.lit("  "), F.date_format("date", "yyyy-MM-dd"), F.lit(" ("), F.rpad(F.col("day_of_week"), 9, " "),
        F.lit("): Rs "), money,
    )
    lines = F.sort_array(F.collect_list(F.struct("step", line.alias("line"))))
    return forecasts.groupBy("product_category").agg(
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("--- "), F.first("product_category"), F.lit(" (next "), F.count(F.lit(1)).cast("string"),
                F.lit(" days) ---"),
            ),
            F.array_join(F.transform(lines, lambda x: x["line"]), "\n"),
            F.concat(
                F.lit("  Total: Rs "), F.format_number(F.sum("predicted_revenue"), 0),
                F.lit("  |  Avg/day: Rs "), F.format_number(F.avg("predicted_revenue"), 0),
            ),
        ).alias("context")
    )
