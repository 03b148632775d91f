"""Whole-document text scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One row per text file: source (file name), path, category (from the name) and text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    source = F.col("_metadata.file_name")
    stem = F.regexp_replace(source, r"\.[^.]*$", "")
    words = F.replace(F.replace(stem, F.lit("_knowledge"), F.lit("")), F.lit("_"), F.lit(" "))
    return files.select(
        source.alias("source"),
        F.col("_metadata.file_path").alias("path"),
        F.initcap(words).alias("category"),
        F.col("value").alias("text"),
    )
