"""Arriving transaction files as a stream: check every row, keep the good, quarantine the rest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from retail_lake.operators.silver import drop_reason, typed
from retail_lake.schema import CORRUPT_COLUMN, RAW_COLUMNS
from retail_lake.sources.csv_files import bind, headers, lines
from retail_lake.staging import stage

OK = "ok"
#: Where the files of each batch are listed, below the target.
UPLOADS_FOLDER = "_uploads"
UPLOADS = "file_path string, file_name string, digest string, taken boolean"


def read_arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of CSV files as they appear, with the file each came from."""
    return lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch), path)


def classify(found: DataFrame) -> DataFrame:
    """Typed rows of a batch of lines, with the raw text of what failed and ``status``: ok or the reason for quarantine.

    Values are bound by the header of their file; files that lack a column are quarantined whole.
    """
    rows = bind(found, headers(found), RAW_COLUMNS)
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in RAW_COLUMNS]))
    lacking = rows.withColumn("lacking", F.coalesce(F.size("lacking"), F.lit(0)) > 0)
    checked = typed(lacking.withColumn("raw_row", F.coalesce(CORRUPT_COLUMN, raw)))
    malformed = F.when(F.col(CORRUPT_COLUMN).isNotNull(), "malformed row")
    absent = F.when(F.col("lacking") == "true", "missing column")
    status = F.coalesce(absent, malformed, drop_reason(), F.lit(OK))
    return checked.withColumn("status", status).drop(CORRUPT_COLUMN, "lacking", "file_path")


def file_digests(found: DataFrame) -> DataFrame:
    """``file_path, file_name, digest`` of each file of ``lines``; files of the same lines have the same digest, in any order.

    Sums over hashes of the lines, which tasks make side by side however a file is split.
    """
    return found.groupBy("file_path", "file_name").agg(
        F.concat_ws(
            ":",
            F.count(F.lit(1)).cast("string"),
            F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string"),
            F.sum(F.xxhash64(F.lit("second"), "value").cast("decimal(38,0)")).cast("string"),
        ).alias("digest")
    )


def judge_uploads(digests: DataFrame, seen: DataFrame) -> DataFrame:
    """``digests`` with ``taken``: the first file by path of each content that no file of ``seen`` has."""
    place = F.row_number().over(Window.partitionBy("digest").orderBy("file_path"))
    known = seen.select("digest", F.lit(True).alias("known")).distinct()
    judged = digests.withColumn("place", place).join(known, "digest", "left")
    return judged.select("file_path", "file_name", "digest", (F.col("known").isNull() & (F.col("place") == 1)).alias("taken"))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Process all files that arrived since the last run and stop.

    Every micro-batch writes its own folder and replaces it when run again, so a batch
    repeated after a lost executor or driver leaves each row once.  The headers of a batch's
    files are read first; then one pass writes good and quarantined rows, split by ``status``.

    An upload whose content was taken before, in an earlier batch or from another file of its
    own, is not taken again; :func:`uploads` lists every file.
    """
    spark.createDataFrame([], UPLOADS).write.mode("overwrite").parquet(f"{target}/{UPLOADS_FOLDER}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again must not find its own files among the earlier ones
        seen = uploads(batch.sparkSession, target).where((F.col("batch_id") < batch_id) & F.col("taken"))
        judged = stage(judge_uploads(file_digests(batch), seen))
        fresh = batch.join(judged.where("taken").select("file_path"), "file_path", "left_semi")
        judged.write.mode("overwrite").parquet(f"{target}/{UPLOADS_FOLDER}/batch_id={batch_id}")
        classify(fresh).write.mode("overwrite").partitionBy("status").parquet(f"{target}/batch_id={batch_id}")

    return (
        read_arriving(spark, source, **options)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def uploads(spark: SparkSession, target: str) -> DataFrame:
    """Every file that arrived: ``file_path, file_name, digest, taken, batch_id``."""
    root = f"{target}/{UPLOADS_FOLDER}"
    return spark.read.schema(f"{UPLOADS}, batch_id int").option("basePath", root).parquet(f"{root}/batch_id=*")


def accepted(spark: SparkSession, target: str) -> DataFrame:
    return _stored(spark, target).where(F.col("status") == OK).drop("status", "raw_row")


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    return _stored(spark, target).where(F.col("status") != OK)


def _stored(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(f"{target}/batch_id=*")


def ingest_report(spark: SparkSession, target: str) -> DataFrame:
    """Rows per status."""
    return _stored(spark, target).groupBy("status").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("file_name").alias("files")
    )
