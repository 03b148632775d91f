import datetime as dt
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from retail_lake.functions.encode import age_band, category_code, risk_band, standard_gender
from retail_lake.functions.dates import iso_date
from retail_lake.functions.encode import whole_number
from retail_lake.operators import gold, quality, silver
from retail_lake.schema import RAW_COLUMNS, RAW_SCHEMA, clean_header, normalise_headers
from retail_lake.staging import stage

GOOD = [
    ("T001", "2023-06-15", "C001", "Female", "28", "Beauty", "2", "50", "100"),
    ("T002", "2023-06-16", "C002", "Male", "35", "Electronics", "1", "300", "300"),
]
BAD = [
    ("T003", "15/06/2023", "C3", "Male", "30", "Beauty", "1", "25", "25"),
    ("T004", "2023-06-17", "C4", "Male", "abc", "Beauty", "1", "25", "25"),
    ("T005", "2023-06-17", "C5", "Male", "30", None, "1", "25", "25"),
    ("T006", "2023-06-17", "C6", "Male", "30", "Beauty", "1", "25", "0"),
    ("T007", "2023-06-17", "C7", "Male", "30", "Beauty", "1", "25", "-5"),
    ("T008", "2023-06-17", "C8", "Male", "30", "Beauty", "1", "25", None),
    ("T009", "2023-06-17", "C9", "Male", None, "Beauty", "1", "25", "25"),
]
ODD = [("T010", "2023-06-18", "C10", None, "61", "Furniture", "3", "10", "30")]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(GOOD + BAD + ODD, RAW_SCHEMA)


def test_two_known_rows(spark):
    rows = silver.silver(spark.createDataFrame(GOOD, RAW_SCHEMA)).orderBy("transaction_id").collect()
    assert [(r.transaction_id, r.gender, r.category_code, r.day_of_week, r.is_weekend) for r in rows] == [
        ("T001", "F", 0, 5, 0),
        ("T002", "M", 2, 6, 0),
    ]
    assert rows[0].date == dt.date(2023, 6, 15) and rows[0].total_amount == Decimal("100.00")
    assert rows[0].total_amount_calc == 100.0


def test_dirty_rows_are_dropped_without_an_error(raw):
    kept = silver.silver(raw).orderBy("transaction_id").collect()
    assert [r.transaction_id for r in kept] == ["T001", "T002", "T010"]
    assert (kept[2].gender, kept[2].category_code) == ("Unknown", -1)


def test_drop_counts_add_up(raw):
    counts = silver.drop_counts(raw).first()
    assert tuple(counts) == (10, 3, 3, 4)


def test_report_lists_errors_and_warnings(raw):
    found = {(r.severity, r.check_name, r.column_name): r.n for r in quality.validation_report(raw).collect()}
    assert found[("error", "unparsable date", "Date")] == 1
    assert found[("warning", "non-numeric", "Age")] == 2
    assert found[("warning", "unknown category", "Product Category")] == 2
    assert found[("warning", "null", "Total Amount")] == 1
    assert quality.is_valid(quality.validation_report(raw)).first().valid == 0


def test_report_for_wrong_columns(spark):
    report = quality.validation_report(spark.createDataFrame([("2023-01-01", 100)], "Date string, Sales int"))
    assert {r.column_name for r in report.collect()} == set(RAW_COLUMNS) - {"Date"}
    with pytest.raises(ValueError, match="missing columns"):
        silver.typed(spark.createDataFrame([("2023-01-01", 100)], "Date string, Sales int"))


def test_clean_upload_has_an_empty_report(spark):
    report = quality.validation_report(spark.createDataFrame(GOOD, RAW_SCHEMA))
    assert report.count() == 0 and quality.is_valid(report).first().valid == 1


def test_empty_load(spark):
    empty = spark.createDataFrame([], RAW_SCHEMA)
    summary = quality.ingest_summary(silver.typed(empty)).collect()
    assert [(r.rows, r.first_date, r.last_date) for r in summary] == [(0, None, None)]
    assert tuple(quality.silver_quality(silver.silver(empty)).first()) == (0, None, None, 0, 0, 0, 0)


def test_headers_lose_stars_and_blanks(spark):
    assert [clean_header(c) for c in ["**Total Amount**", " Date ", "* Age *"]] == ["Total Amount", "Date", "Age"]
    starred = spark.createDataFrame(GOOD, RAW_SCHEMA).toDF(*[f" **{c}**" for c in RAW_COLUMNS])
    assert normalise_headers(starred).columns == RAW_COLUMNS


def test_codes_and_bands(spark):
    df = spark.createDataFrame(
        [("Beauty", 17, 0.65, "Female"), ("Clothing", 25, 0.55, "Male"), ("Toys", 54, 0.5499, "F"), (None, None, None, None)],
        "c string, age int, s double, g string",
    ).select(category_code("c"), category_code("c", unknown_code=0), age_band("age"), risk_band("s"), standard_gender("g"))
    assert [tuple(r) for r in df.collect()] == [
        (0, 0, "18-24", "HIGH", "F"),
        (1, 1, "25-34", "MEDIUM", "M"),
        (-1, 0, "45-54", "LOW", "Unknown"),
        (-1, 0, "55+", "LOW", "Unknown"),
    ]


def test_amount_check_finds_the_odd_row(spark):
    rows = [*GOOD, ("T9", "2023-06-15", "C", "Male", "20", "Beauty", "2", "50", "120")]
    checked = silver.amount_check(silver.silver(spark.createDataFrame(rows, RAW_SCHEMA)))
    assert {r.product_category: r.mismatches for r in checked.collect()} == {"Beauty": 1, "Electronics": 0}


def test_approximate_customers_stay_close(spark, raw):
    exact = gold.monthly_summary(silver.silver(raw)).orderBy("product_category").collect()
    rough = gold.monthly_summary(silver.silver(raw), approximate=True).orderBy("product_category").collect()
    assert [r.unique_customers for r in exact] == [r.unique_customers for r in rough]


def test_dates_are_read_as_the_formatter_reads_them(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-13-01", "0000-01-01", "0001-01-01", "9999-12-31", "+10000-01-01", "10000-01-01", "+2024-01-01",
             "-2024-01-01", "2024-1-1", " 2024-01-01", "2024-01-01 ", "2024-01-01\n", "2024-01-01T00", "2024-01-1T", "31/12/2024", "1582-10-10",
             "20240101", "2024", "٢٠٢٤-٠١-٠١", "+99999999999-01-01", "9" * 25 + "-01-01", "", "abc", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~iso_date(F.col("t")).eqNullSafe(F.try_to_date("t", "yyyy-MM-dd"))).collect() == []
    text = rows.select(iso_date(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "as date" in text


def test_whole_numbers(spark):
    texts = ["2", " 2.0 ", "2.", "+2", "-3", "2e0", "1.5e1", "20E-1", "2.0000001", "2.0000000000000000001", "1.5", "1e-3", "x", "", None, "3000000000", "1e40", ".0", "--2"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.n for r in rows.select("k", whole_number(F.col("t")).alias("n")).orderBy("k").collect()]
    assert got == [2, 2, 2, 2, -3, 2, 15, 2, *[None] * 11]
    assert [r[0] for r in spark.sql("SELECT 2.0D AS d UNION ALL SELECT 2.5D").select(whole_number(F.col("d"))).collect()] == [2, None]


def test_customer_sketches_merge_over_any_months(spark):
    """Customers come back in other months and categories; 2 % is 2.5 standard errors."""
    rows = spark.range(200_000).select(
        F.lit(2024).alias("year"),
        (F.col("id") % 12 + 1).alias("month"),
        F.floor(F.col("id") % 12 / 3 + 1).alias("quarter"),
        F.when(F.col("id") % 5 < 2, "Beauty").otherwise("Clothing").alias("product_category"),
        F.when(F.col("id") % 97 != 0, F.pmod(F.xxhash64("id"), F.lit(60_000)).cast("string")).alias("customer_id"),
    )
    stored = stage(gold.customer_sketches(rows))
    assert stored.count() == 24
    for keys in ([], ["year"], ["quarter"], ["quarter", "product_category"], ["month"]):
        exact = {tuple(r)[:-1]: r[-1] for r in rows.groupBy(*keys).agg(F.count_distinct("customer_id")).collect()}
        told = {tuple(r)[:-1]: r[-1] for r in gold.customers_over(stored, keys).collect()}
        assert set(told) == set(exact)
        assert all(abs(told[k] - exact[k]) <= 0.02 * exact[k] for k in exact)
    assert gold.customers_over(stored.limit(0), ["year"]).count() == 0
