"""Data checks: ingest validation, silver quality numbers and expectations on features."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.functions.dates import iso_date
from retail_lake.functions.encode import money_mean, whole_number
from retail_lake.schema import CATEGORIES, CORRUPT_COLUMN, FORECAST_FEATURES, INTEGER_COLUMNS, NUMERIC_COLUMNS, RAW_COLUMNS, missing_columns
from retail_lake.sources.csv_files import bind, headers, lines


def long_rows(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn one row into many: each dict gives the columns of one output row."""
    structs = [F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or df.columns
    counted = df.agg(*[F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return long_rows(counted, [{"column_name": F.lit(c), "nulls": F.col(f"n{i}")} for i, c in enumerate(columns)])


def not_numeric(column: str) -> Column:
    """True where a value does not read as a number of its column's kind; nulls count as such."""
    value = whole_number(_q(column)) if column in INTEGER_COLUMNS else _q(column).try_cast("double")
    return value.isNull()


def non_numeric_counts(df: DataFrame, columns: list[str] = NUMERIC_COLUMNS) -> DataFrame:
    counted = df.agg(*[F.count_if(not_numeric(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    return long_rows(counted, [{"column_name": F.lit(c), "non_numeric": F.col(f"n{i}")} for i, c in enumerate(columns)])


def is_unknown(column: str, valid: list[str] = CATEGORIES) -> Column:
    return ~F.coalesce(_q(column).isin(valid), F.lit(False))


def unknown_categories(df: DataFrame, column: str = "Product Category", valid: list[str] = CATEGORIES) -> DataFrame:
    """Values outside the valid list with their row counts."""
    return (
        df.where(is_unknown(column, valid))
        .groupBy(_q(column).alias("product_category"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_categories(df: DataFrame, column: str = "product_category") -> DataFrame:
    return df.select(column).distinct()


def validation_report(raw: DataFrame) -> DataFrame:
    """Errors and warnings of an upload as rows (severity, check, column, rows affected).

    Missing columns end the report; otherwise one pass over the rows counts everything.
    """
    spark = raw.sparkSession
    if lacking := missing_columns(raw):
        return spark.createDataFrame(
            [("error", "missing column", c, None) for c in lacking],
            "severity string, check_name string, column_name string, n long",
        )
    bad_date = _q("Date").isNotNull() & iso_date(_q("Date")).isNull()
    checks = [("error", "unparsable date", "Date", bad_date)]
    checks += [("warning", "non-numeric", c, not_numeric(c)) for c in NUMERIC_COLUMNS]
    checks += [("warning", "unknown category", "Product Category", is_unknown("Product Category"))]
    checks += [("warning", "null", c, _q(c).isNull()) for c in RAW_COLUMNS]
    counted = raw.agg(*[F.count_if(test).alias(f"n{i}") for i, (*_, test) in enumerate(checks)])
    rows = [
        {"severity": F.lit(s), "check_name": F.lit(k), "column_name": F.lit(c), "n": F.col(f"n{i}")}
        for i, (s, k, c, _) in enumerate(checks)
    ]
    return long_rows(counted, rows).where("n > 0")


def upload_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of an upload folder: ``file_name, status, errors, warnings, rows, first_date, last_date, categories``.

    A file is rejected that is no ``.csv``, has no header, lacks columns, or holds malformed rows
    or unparsable dates; other findings are warnings with their row counts.  ``categories`` lists
    the known ones found.  All files are judged together.  A file of no bytes has no row, as
    Spark's file sources pass over it.
    """
    # names only: the content column is not read
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")
    )
    found = lines(spark.read, path)
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, RAW_COLUMNS)), "names"))
    known = headers(found)
    heads = known.select("file_path", absent.alias("absent"))
    fits = F.col(CORRUPT_COLUMN).isNull()
    bad_date = _q("Date").isNotNull() & iso_date(_q("Date")).isNull()
    errors = [("malformed row", ~fits), ("unparsable date", fits & bad_date)]
    warnings = [(f"non-numeric in {c}", fits & _q(c).isNotNull() & not_numeric(c)) for c in NUMERIC_COLUMNS]
    warnings += [("unknown category", fits & _q("Product Category").isNotNull() & is_unknown("Product Category"))]
    warnings += [(f"null in {c}", fits & _q(c).isNull()) for c in RAW_COLUMNS]
    date = iso_date(_q("Date"))
    counted = bind(found, known, RAW_COLUMNS).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.array_sort(F.collect_set(F.when(_q("Product Category").isin(CATEGORIES), _q("Product Category")))).alias("categories"),
        *[F.count_if(test).alias(f"n{i}") for i, (_, test) in enumerate(errors + warnings)],
    )

    def told(checks: list[tuple[str, Column]], first: int) -> Column:
        texts = [F.when(F.col(f"n{i}") > 0, F.concat(F.lit(f"{name}: "), F.col(f"n{i}"))) for i, (name, _) in enumerate(checks, first)]
        return F.array_compact(F.array(*texts))

    none = F.array().cast("array<string>")
    problems = (
        F.when(~F.col("file_name").endswith(".csv"), F.array(F.lit("not a .csv file")))
        .when(F.col("absent").isNull(), F.array(F.lit("no header")))
        .when(F.size("absent") > 0, F.transform("absent", lambda c: F.concat(F.lit("missing column: "), c)))
        .otherwise(told(errors, 0))
    )
    judged = listed.join(heads, "file_path", "left").join(counted, "file_path", "left")
    whole = F.size("absent") == 0
    return judged.select(
        "file_name",
        F.when(F.size(problems) == 0, "accepted").otherwise("rejected").alias("status"),
        problems.alias("errors"),
        F.when(whole, told(warnings, len(errors))).otherwise(none).alias("warnings"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "first_date",
        "last_date",
        F.coalesce("categories", none).alias("categories"),
    )


def is_valid(report: DataFrame) -> DataFrame:
    """One row: whether the report holds no error."""
    return report.agg((F.count_if(F.col("severity") == "error") == 0).cast("int").alias("valid"))


def ingest_summary(df: DataFrame) -> DataFrame:
    """Rows per category beside the totals of the whole load; an empty load gives one row of nulls and 0."""
    per_category = df.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )
    # Built on the same aggregate, so its shuffle is reused and the load is read once.
    total = per_category.agg(
        F.lit("(all)").alias("product_category"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return per_category.unionByName(total)


def silver_quality(df: DataFrame) -> DataFrame:
    """Rows, date range, distinct customers and categories, and null counts.

    Counting is done per (customer, category) first, so the two distinct counts run over
    that much smaller set and one very frequent customer costs no more than a rare one.
    """
    pairs = df.groupBy("customer_id", "product_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("date").alias("lo"),
        F.max("date").alias("hi"),
        F.count_if(F.col("date").isNull()).alias("no_date"),
        F.count_if(F.col("total_amount").isNull()).alias("no_amount"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.count_distinct("product_category").alias("categories"),
        F.coalesce(F.sum("no_date"), F.lit(0)).alias("null_dates"),
        F.coalesce(F.sum("no_amount"), F.lit(0)).alias("null_amounts"),
    )


def revenue_by_category(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("product_category")
        .agg(
            F.sum("total_amount").cast("double").alias("total_revenue"),
            money_mean("total_amount").alias("avg_per_tx"),
            F.count("transaction_id").alias("transactions"),
        )
        .orderBy(F.desc("total_revenue"), "product_category")
    )


def expectations(
    features: DataFrame,
    flag: str | None = None,
    min_rows: int = 300,
    categories: int = 3,
    required: list[str] = FORECAST_FEATURES,
) -> DataFrame:
    """Checks on a feature table as rows (check_name, passed, observed); one aggregate answers all.

    ``flag`` names a 0/1 anomaly column whose share must lie between 1 and 15 percent.
    """
    lags = ["lag_1", "lag_7", "lag_14"]
    # Accepted share of flagged rows, in percent.
    low, high = 1.0, 15.0
    measures = {
        "rows": F.count(F.lit(1)),
        "categories": F.count_distinct("product_category"),
        "null revenue": F.count_if(F.col("daily_revenue").isNull()),
        "negative revenue": F.count_if(F.col("daily_revenue") < 0),
        **{f"null {c}": F.count_if(F.col(c).isNull()) for c in lags},
    }
    if flag:
        measures["flagged percent"] = 100.0 * F.sum(flag) / F.count(F.lit(1))
    observed = features.agg(*[m.cast("double").alias(name) for name, m in measures.items()])
    tests = {
        "rows": F.col("rows") >= min_rows,
        "categories": F.col("categories") == categories,
        "flagged percent": F.col("`flagged percent`").between(low, high),
    }
    rows = [
        {
            "check_name": F.lit(name),
            "passed": F.coalesce(tests.get(name, _q(name) == 0), F.lit(False)).cast("int"),
            "observed": _q(name),
        }
        for name in measures
    ]
    lacking = len([c for c in required if c not in features.columns])
    rows.append(
        {
            "check_name": F.lit("missing model inputs"),
            "passed": F.lit(int(lacking == 0)),
            "observed": F.lit(float(lacking)),
        }
    )
    return long_rows(observed, rows)
