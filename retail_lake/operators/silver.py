"""Bronze to silver: typed, cleaned transactions with calendar columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_lake.functions.dates import iso_date, silver_calendar
from retail_lake.functions.encode import category_code, standard_gender, whole_number
from retail_lake.schema import CORRUPT_COLUMN, MONEY, snake_case
from retail_lake.sources.csv_files import check_headers

# Columns a transaction must have, and those that must be above zero.
CRITICAL = ["date", "total_amount", "product_category", "quantity"]
POSITIVE = ["total_amount", "quantity", "age"]
# Columns that filters test and that cost parsing.
PARSED = ["date", "age", "quantity", "total_amount"]


def typed(raw: DataFrame) -> DataFrame:
    """Raw text columns under snake_case names and with their types; what does not parse is null."""
    types = {
        "age": "int",
        "quantity": "int",
        "price_per_unit": "double",
        "total_amount": MONEY,
    }
    columns = []
    for name in check_headers(raw).columns:
        short = snake_case(name)
        if short == "date":
            column = iso_date(F.col(f"`{name}`"))
        elif types.get(short) == "int":
            column = whole_number(F.col(f"`{name}`"))
        else:
            column = F.col(f"`{name}`").try_cast(types.get(short, "string"))
        columns.append(column)
    # A generator is a barrier: a filter on a typed column stays above it, so that each value is
    # parsed once and not again in every filter.  Columns that no filter parses stand beside it,
    # where a report that does not read them leaves them out.
    names = [snake_case(name) for name in raw.columns]
    placed = [(n in PARSED, c.alias(f"c{i}")) for i, (n, c) in enumerate(zip(names, columns, strict=True))]
    behind = F.inline(F.array(F.struct(*[c for is_parsed, c in placed if is_parsed])))
    beside = [c for is_parsed, c in placed if not is_parsed]
    return raw.select(*beside, behind).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def drop_reason() -> Column:
    """Why a typed row is not kept, or null for a good row."""
    lacking = F.lit(False)
    for c in CRITICAL:
        lacking = lacking | F.col(c).isNull()
    above = F.lit(True)
    for c in POSITIVE:
        above = above & F.coalesce(F.col(c) > 0, F.lit(False))
    return F.when(lacking, "missing value").when(~above, "not positive")


def clean(df: DataFrame) -> DataFrame:
    """Keep complete rows with positive amount, quantity and age; standardise gender, add the category code."""
    kept = df.dropna(subset=CRITICAL)
    for c in POSITIVE:
        kept = kept.where(F.col(c) > 0)
    return kept.withColumns({"gender": standard_gender("gender"), "category_code": category_code("product_category")})


def silver(raw: DataFrame) -> DataFrame:
    """The silver table from raw text transactions; lines kept in the corrupt column have no values and go."""
    return with_derived(clean(typed(raw.drop(CORRUPT_COLUMN))))


def with_derived(df: DataFrame) -> DataFrame:
    """Calendar columns and the recomputed amount."""
    return df.withColumns({**silver_calendar("date"), "total_amount_calc": F.col("quantity") * F.col("price_per_unit")})


def drop_counts(raw: DataFrame) -> DataFrame:
    """Rows read, kept and dropped by reason, in one pass."""
    reason = drop_reason()
    return typed(raw).agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(reason.isNull()).alias("rows_kept"),
        F.count_if(reason == "missing value").alias("dropped_missing"),
        F.count_if(reason == "not positive").alias("dropped_not_positive"),
    )


def amount_check(df: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per category: how often the stated amount differs from quantity times price."""
    gap = F.abs(F.col("total_amount").cast("double") - F.col("quantity") * F.col("price_per_unit"))
    return df.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(gap > tolerance).alias("mismatches"),
        F.sum("total_amount").cast("double").alias("stated_total"),
        F.round(F.sum(F.col("quantity") * F.col("price_per_unit")), 2).alias("computed_total"),
    )
