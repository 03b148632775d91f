"""Calendar columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(column: Column) -> Column:
    """Text as a date as ``try_to_date`` reads it by ``yyyy-MM-dd``.

    A cast reads plain dates, far cheaper than a formatter, which throws and catches an exception
    for each text that does not fit: it gets only years that a cast reads otherwise.
    """
    text = column.cast("string")
    plain = text.rlike(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    other = text.rlike(r"\A[+-]?[0-9]{4,}-[0-9]{2}-[0-9]{2}\z")
    return F.when(plain, text.try_cast("date")).when(other, F.try_to_date(text, "yyyy-MM-dd"))


def flag(condition: Column) -> Column:
    """0/1 integer for a condition, 0 when it is unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def silver_calendar(date: str = "date") -> dict[str, Column]:
    """Calendar columns of the silver table; ``day_of_week`` counts from 1 = Sunday."""
    d = F.col(date)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.dayofweek(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
        "is_weekend": flag(F.weekday(d) >= 5),
        "is_month_end": flag(F.dayofmonth(d) >= 25),
    }


def feature_calendar(date: str | Column = "date") -> dict[str, Column]:
    """Calendar columns of the feature table; ``DayOfWeek`` counts from 0 = Monday."""
    d = F.col(date) if isinstance(date, str) else date
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "Day": F.dayofmonth(d),
        "DayOfWeek": F.weekday(d),
        "WeekOfYear": F.weekofyear(d),
        "DayOfYear": F.dayofyear(d),
        "Quarter": F.quarter(d),
        "IsWeekend": flag(F.weekday(d) >= 5),
        "IsMonthStart": flag(F.dayofmonth(d) <= 5),
        "IsMonthEnd": flag(F.dayofmonth(d) >= 25),
    }


def date_names(date: str = "date") -> dict[str, Column]:
    d = F.col(date)
    return {
        "month_name": F.date_format(d, "MMMM"),
        "weekday_name": F.date_format(d, "EEEE"),
        "date_text": F.date_format(d, "yyyy-MM-dd"),
    }
