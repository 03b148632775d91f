"""The training-data pipeline: stages over the documents, each written and read again by the next."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.llm import language
from retail_lake.llm.common import written
from retail_lake.llm.decontaminate import without_benchmark
from retail_lake.llm.mixing import mixed_blocks
from retail_lake.llm.ngram_join import component_rows, text_hash
from retail_lake.llm.token_output import token_index, write_token_ids
from retail_lake.staging import work_path

#: Least share of a document's letters in its main language.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one language holds half the letters or more; texts without letters go."""
    model = language.fit(language.training_rows(docs))
    told = language.predict(docs, model, carry=True)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, that with the least doc_id.

    Rows without a doc_id come after those with one; of rows equal in doc_id the one with the least
    hash of its text stays.  Texts without words are no copies, but rows equal in doc_id and text
    become one.
    """
    alone = F.col("component_key").isNull()
    own = [F.when(alone, F.col(c)).alias(f"own_{c}") for c in ("doc_id", "text_hash")]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")).alias("least")
    kept = component_rows(docs).groupBy("component_key", *own).agg(least)
    kept = kept.select(F.col("least.doc_id").alias("kept_id"), F.col("least.text_hash").alias("kept_hash"))
    own = "own_text"
    while own in docs.columns:
        own += "_"
    hashed = docs.withColumn(own, text_hash())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col(own) == F.col("kept_hash"))
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; texts that are null, empty or repeated are judged like others, each row by itself."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks that the mix of sources puts into its slots, a row for each document in each; texts without words go, a null source is the last one."""
    return mixed_blocks(docs)


def mixed_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage of ``source_mix``: all its rows with the columns of documents; the slots of the rows stay in the mix that it writes."""
    return source_mix(spark, docs, sf_dir).select(*[F.col(f"`{c}`") for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Parquet; the index of the files, a row per document row, is the result.  Null texts are empty."""
    return token_index(spark, write_token_ids(docs, work_path(spark, "pipeline_tokens")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", mixed_texts),
    ("token_files", token_files),
]
#: The stages use a trained model, SimHash and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
