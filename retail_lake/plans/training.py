"""From transactions to models: features, forecast model, anomaly detector."""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.operators import anomaly, features, forecast, metrics, quality
from retail_lake.schema import FORECAST_FEATURES
from retail_lake.staging import stage


@dataclass(frozen=True)
class Trained:
    """What the training job leaves behind."""

    features: DataFrame
    model: PipelineModel
    metrics: DataFrame
    scored: DataFrame
    detector: anomaly.Forest


def train(
    tx: DataFrame,
    columns: list[str] = FORECAST_FEATURES,
    stop_on: str | None = "tune",
    forest: dict | None = None,
    **boosting,
) -> Trained:
    """Build the feature table once and fit both models on it."""
    table = stage(features.feature_table(tx))
    failed = quality.expectations(table).where(F.col("passed") == 0)
    if problems := [r["check_name"] for r in failed.collect()]:
        raise ValueError(f"feature table fails its checks: {problems}")
    split = forecast.time_split(table, tune_weeks=0 if stop_on != "tune" else forecast.TEST_WEEKS)
    model = forecast.fit(split, columns, stop_on, **boosting)
    errors = metrics.forecast_metrics(forecast.predict(split, model))
    scored, detector = anomaly.detect(table, ["product_category", "date"], **(forest or {}))
    return Trained(table, model, errors, scored, detector)


def save(spark: SparkSession, trained: Trained, path: str) -> None:
    trained.model.write().overwrite().save(f"{path}/forecast")
    anomaly.save(spark, trained.detector, f"{path}/anomaly")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, anomaly.Forest]:
    return PipelineModel.load(f"{path}/forecast"), anomaly.load(spark, f"{path}/anomaly")
