"""Text blocks for an analyst: sales summary, monthly revenue and anomalies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from retail_lake.operators import metrics
from retail_lake.schema import CATEGORIES


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)").cast("string")


def _section(df: DataFrame, number: int, title: str, order: list[Column], line: Column) -> DataFrame:
    return df.select(
        F.lit(number).alias("section_no"),
        F.lit(title).alias("section"),
        F.concat_ws(" ", *order).alias("line_key"),
        line.alias("line"),
    )


def sales_context(daily: DataFrame, scored: DataFrame, year: int, by: str = "anomaly_score") -> DataFrame:
    """Lines of the sales context: (section_no, section, line_key, line), sorted by section and key.

    ``daily`` has a row per day and category, ``scored`` the flagged rows; ``by`` ranks the
    anomalies, whose lines stand in that order and end with the anomaly score.
    """
    summary = metrics.sales_summary(daily, year)
    pivot = metrics.monthly_pivot(daily, CATEGORIES, year)
    flagged = scored.where("anomaly_flag = 1")
    # ten rows by now, so one task may number them
    place = F.row_number().over(Window.orderBy(F.desc(by), "date", "product_category"))
    top = metrics.top_anomalies(flagged, by).withColumn("place", place)
    counts = flagged.groupBy("product_category").agg(F.count(F.lit(1)).alias("anomalies"))
    # Titles of the sections.
    sections = [
        _section(
            summary, 1, f"SALES SUMMARY ({year})", [F.col("product_category")],
            F.concat_ws(" ", "product_category", *map(_money, ["revenue_sum", "revenue_mean", "revenue_max", "revenue_min"])),
        ),
        _section(
            pivot, 2, "MONTHLY REVENUE BY CATEGORY", [F.lpad(F.col("month_no").cast("string"), 2, "0")],
            F.concat_ws(" ", "month_name", *map(_money, CATEGORIES)),
        ),
        _section(
            top, 3, "TOP 10 ANOMALOUS DAYS",
            [F.lpad(F.col("place").cast("string"), 2, "0")],
            F.concat_ws(
                " ", F.date_format("date", "yyyy-MM-dd"), "product_category", _money("daily_revenue"),
                F.col("revenue_z_score").cast("decimal(18,2)").cast("string"),
                F.col("anomaly_score").cast("decimal(18,4)").cast("string"),
            ),
        ),
        _section(
            counts, 4, "ANOMALY COUNT BY CATEGORY", [F.col("product_category")],
            F.concat_ws(" ", "product_category", F.col("anomalies").cast("string")),
        ),
    ]
    lines = sections[0]
    for more in sections[1:]:
        lines = lines.unionByName(more)
    return lines


def as_text(lines: DataFrame) -> DataFrame:
    """The lines as one text: a few dozen rows, whatever the size of the data."""
    ordered = F.sort_array(F.collect_list(F.struct("line_key", "line")))
    blocks = lines.groupBy("section_no", "section").agg(
        F.concat(
            F.lit("=== "), F.col("section"), F.lit(" ===\n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
        ).alias("block")
    )
    in_order = F.sort_array(F.collect_list(F.struct("section_no", "block")))
    return blocks.agg(F.array_join(F.transform(in_order, lambda x: x["block"]), "\n\n").alias("context"))
