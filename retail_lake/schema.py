"""Column names, fixed values and header handling shared by every operator."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The raw transaction columns in file order.
RAW_COLUMNS = [
    "Transaction ID",
    "Date",
    "Customer ID",
    "Gender",
    "Age",
    "Product Category",
    "Quantity",
    "Price per Unit",
    "Total Amount",
]
# Raw columns that hold numbers, and those that hold whole ones.
NUMERIC_COLUMNS = ["Age", "Quantity", "Price per Unit", "Total Amount"]
INTEGER_COLUMNS = ["Age", "Quantity"]

# Known categories with their ordinal codes.
CATEGORY_CODES = {"Beauty": 0, "Clothing": 1, "Electronics": 2}
CATEGORIES = list(CATEGORY_CODES)

# Model inputs of the demand forecast.
FORECAST_FEATURES = [
    "category_encoded", "is_beauty", "is_clothing", "is_electronics",
    "Year", "Month", "Day", "DayOfWeek", "WeekOfYear", "DayOfYear", "Quarter",
    "IsWeekend", "IsMonthStart", "IsMonthEnd",
    "lag_1", "lag_7", "lag_14",
    "rolling_mean_7", "rolling_mean_14", "rolling_std_7", "rolling_std_14",
    "rolling_max_7", "rolling_min_7",
    "avg_age", "female_ratio", "transaction_count", "avg_price",
    "revenue_z_score", "pct_from_rolling_mean",
]
# Columns known only once the day is over; a model meant for real forecasts leaves them out.
SAME_DAY_FEATURES = [
    "avg_age", "female_ratio", "transaction_count", "avg_price",
    "revenue_z_score", "pct_from_rolling_mean",
]
LEAK_FREE_FEATURES = [c for c in FORECAST_FEATURES if c not in SAME_DAY_FEATURES]

# Model inputs of the anomaly detector.
ANOMALY_FEATURES = [
    "daily_revenue", "daily_quantity", "transaction_count",
    "revenue_z_score", "pct_from_rolling_mean",
    "rolling_mean_7", "rolling_std_7", "rolling_max_7", "rolling_min_7",
    "avg_price", "avg_age", "female_ratio",
    "DayOfWeek", "Month", "IsWeekend", "category_encoded",
]

# The columns of the exported anomaly table, in order.
ANOMALY_COLUMNS = [
    "Date", "Product Category",
    "daily_revenue", "daily_quantity", "transaction_count",
    "avg_price", "avg_age", "female_ratio",
    "DayOfWeek", "Month", "IsWeekend",
    "rolling_mean_7", "rolling_std_7",
    "revenue_z_score", "pct_from_rolling_mean",
    "anomaly_flag", "anomaly_score",
]

CORRUPT_COLUMN = "_corrupt"
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
RAW_SCHEMA_CHECKED = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])

MONEY = T.DecimalType(18, 2)


def clean_header(name: str) -> str:
    """Drop blanks and markdown stars around a column name."""
    return re.sub(r"^[\s*]+|[\s*]+$", "", name)


def snake_case(name: str) -> str:
    return re.sub(r"\s+", "_", clean_header(name)).lower()


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def missing_columns(df: DataFrame, required: list[str] = RAW_COLUMNS) -> list[str]:
    return sorted(set(required) - set(df.columns))
