"""Shared-folder staging: where jobs keep intermediate results that several later steps read."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared folder named by the session; only a local session gets one of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        root = sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="retail-lake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark)}/retail_lake/{label}-{uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the rows in the shared folder.

    Parquet lets later steps read the columns and rows they need.  Meant for results that are small next to their input (a daily aggregate over all
    transactions, a scored table) and are read by more than one later step.
    """
    path = work_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
