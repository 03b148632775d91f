"""Scalar rules: category codes, bands and guarded division."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from retail_lake.schema import CATEGORIES, CATEGORY_CODES


def whole_number(column: Column) -> Column:
    """Text or number as an int: ``2``, ``2.0`` and ``2e0`` are 2; a fraction, however small, other text and what is out of range are null."""
    text = F.trim(column.cast("string"))
    digits = F.regexp_extract(text, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    exponent = F.when(text.rlike(r"^[+-]?([0-9]+\.?|[0-9]*\.[0-9]{1,9})[eE][+-]?[0-9]{1,2}$"), text)
    exact = exponent.try_cast("decimal(38,18)")
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("int"), F.when(exact == F.floor(exact), exact).try_cast("int"))


def category_code(category: str | Column, codes: dict[str, int] = CATEGORY_CODES, unknown_code: int = -1) -> Column:
    c = F.col(category) if isinstance(category, str) else category
    pairs = [F.lit(v) for pair in codes.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(unknown_code)).cast("int")


def one_hot(category: str, categories: list[str] = CATEGORIES) -> dict[str, Column]:
    return {
        "is_" + c.lower().replace(" ", "_"): F.coalesce((F.col(category) == c).cast("int"), F.lit(0))
        for c in categories
    }


def standard_gender(gender: str) -> Column:
    """Female and Male become F and M; anything else, null included, is Unknown."""
    # Codes of the genders.
    g = F.col(gender)
    return F.when(g == "Female", "F").when(g == "Male", "M").otherwise("Unknown")


def age_band(age: str) -> Column:
    """Label of the age band; the youngest is open below, a missing age falls into the oldest."""
    # The age bands of the segment table.
    a = F.col(age)
    return F.when(a < 25, "18-24").when(a < 35, "25-34").when(a < 45, "35-44").when(a < 55, "45-54").otherwise("55+")


def risk_band(score: str) -> Column:
    # Score thresholds of the alert policy.
    high, medium = 0.65, 0.55
    s = F.col(score)
    return F.when(s >= high, "HIGH").when(s >= medium, "MEDIUM").otherwise("LOW")


def money_mean(amount: str) -> Column:
    """Mean of a decimal column as a double, from the exact sum: the same however the rows are spread."""
    return F.sum(amount).cast("double") / F.count(amount)


def or_one(denominator: Column) -> Column:
    """The denominator, with zero replaced by one."""
    return F.coalesce(F.nullif(denominator, F.lit(0.0)), F.lit(1.0))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is zero or either side is missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
