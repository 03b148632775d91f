"""Time the headline queries and jobs; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "silver_clean",
    "silver_quality",
    "validation_report",
    "gold_daily_revenue",
    "gold_monthly_summary",
    "gold_customer_segments",
    "mom_growth",
    "dash_segments",
    "daily_features",
    "dense_grid",
    "feature_table",
    "zscore",
    "order_percentiles",
    "describe_revenue",
    "anomaly_breakdown",
    "anomaly_runs",
    "forecast_metrics",
    "latest_actuals",
    "chunk_documents",
    "keyword_search",
    "bm25_search",
    "knn_topk",
    "context_assembly",
    "intent_route_default",
    "session_history",
    "ingest_stream",
    "iso_forest_score",
    "gbt_predict",
    "forecast",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("retail-lake-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from retail_lake import catalog
    from retail_lake.operators import features
    from retail_lake.plans import medallion, training
    from retail_lake.sources.star_schema import raw_transactions, transactions
    from retail_lake.staging import work_path

    def consume(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def bronze_to_silver() -> None:
        medallion.bronze_to_silver(spark, raw_transactions(spark, SF_DIR), "bench_silver")

    def silver_to_gold() -> None:
        medallion.silver_to_gold(spark, spark.table("bench_silver.transactions"), "bench_gold")

    def offline_training() -> None:
        """Features, forecast model and anomaly detector with their full settings."""
        trained = training.train(transactions(spark, SF_DIR))
        consume(features.export_names(trained.features))
        consume(trained.scored)

    for name in ("bench_silver", "bench_gold"):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{work_path(spark, name)}'")
    jobs = {name: (lambda q=catalog.QUERIES[name]: consume(q(spark, SF_DIR))) for name in HEADLINE}
    jobs |= {
        "job_bronze_to_silver": bronze_to_silver,
        "job_silver_to_gold": silver_to_gold,
        "job_offline_training": offline_training,
    }
    consume(catalog.QUERIES["feature_table"](spark, SF_DIR))  # warm-up

    seconds = {}
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries and jobs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
