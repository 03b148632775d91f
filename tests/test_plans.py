"""What the plans must look like on large inputs."""

import pytest
from pyspark.sql import functions as F

from retail_lake.catalog import present
from retail_lake.operators import features, gold, metrics, quality, silver
from retail_lake.sources.star_schema import raw_transactions, transactions

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "daily")
    features.daily_features(transactions(spark, SF_DIR)).write.parquet(path)
    return spark.read.parquet(path)


def test_year_filter_and_columns_reach_the_scan(stored):
    text = plan(metrics.sales_summary(stored, 1997))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(date,1997-01-01)" in scan and "LessThanOrEqual(date,1997-12-31)" in scan
    assert "ReadSchema: struct<date:date,product_category:string,daily_revenue:double>" in scan


def test_scans_read_only_what_a_report_needs(spark):
    text = plan(quality.distinct_categories(transactions(spark, SF_DIR)))
    assert "l_extendedprice" not in text and "o_custkey" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    rows = silver.silver(raw_transactions(spark, SF_DIR))
    for df in (gold.daily_revenue(rows), gold.customer_segments(rows), quality.silver_quality(rows)):
        text = plan(df)
        assert "partial_sum" in text or "partial_count" in text


def test_all_series_windows_share_one_sort(spark, stored):
    grid = features.dense_grid(stored)
    text = plan(features.with_lags_and_rolling(grid))
    assert text.count("Window [") == 1


def test_grid_of_all_categories_is_not_gathered(stored):
    text = plan(features.dense_grid(stored, None))
    assert "collect_set" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_shown_numbers_do_not_saturate(spark):
    shown = present(spark.sql("SELECT 1e13D AS a, -1e13D AS b, -1.5e-6D AS c, 1234567.1234567D AS d")).first()
    assert tuple(shown) == (1e13, -1e13, -1e-6, 1234567.123457)


def test_hot_customer_and_category(spark):
    """Two thirds of the rows belong to one customer and category."""
    hot = F.col("id") % 3 > 0
    df = spark.range(30_000).repartition(6).select(
        F.when(hot, "hot").otherwise(F.col("id").cast("string")).alias("customer_id"),
        F.when(hot, "Beauty").otherwise("Clothing").alias("product_category"),
        F.lit("2023-01-01").cast("date").alias("date"), F.lit(1).cast("decimal(18,2)").alias("total_amount"),
    )
    row = quality.silver_quality(df).first()
    assert (row.total_records, row.unique_customers, row.categories) == (30_000, 10_001, 2)


def test_silver_report_parses_only_what_it_reads(spark):
    rows = silver.silver(raw_transactions(spark, SF_DIR))
    text = plan(quality.silver_quality(rows))
    assert "l_linenumber" not in text and "FLOOR(((l_extendedprice" not in text


def test_numbers_are_parsed_once(spark):
    """Filters on typed columns stay above the parsing: one rule evaluation for each of the two whole-number columns."""
    rows = silver.silver(raw_transactions(spark, SF_DIR))
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 2
