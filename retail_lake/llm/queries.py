"""The registered queries of this folder, each over its whole table, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_lake.llm import language, toxicity
from retail_lake.llm.chat import chat_windows, digests
from retail_lake.llm.common import written
from retail_lake.llm.decontaminate import benchmark_matches
from retail_lake.llm.fingerprints import fingerprints_with_edits
from retail_lake.llm.mixing import mix
from retail_lake.llm.ngram_join import ngram_jaccard_join
from retail_lake.llm.repair import damaged, repair_report
from retail_lake.llm.secrets import secret_scan
from retail_lake.llm.sharding import histogram_shards
from retail_lake.llm.spelling import DAMAGE_ONE_IN, spelling_variants
from retail_lake.llm.token_counts import token_counts
from retail_lake.llm.token_output import token_index, write_token_ids
from retail_lake.staging import work_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_token_ids(_table(spark, sf_dir, "documents"), work_path(spark, "token_ids"))
    return token_index(spark, out)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return digests(written(chat_windows(turns), "chat"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(language.training_rows(docs))
    return language.predict(docs, model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans")
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = mix(_table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a fixed rule: their faults, the cheapest edits and what these make."""
    return repair_report(damaged(_table(spark, sf_dir, "conversations")), "copies")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document by a classifier of the labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, _table(spark, sf_dir, "labels")))
    return toxicity.predict(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "worst_word")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, one run in 199 damaged, with near words, forms and roots."""
    return spelling_variants(_table(spark, sf_dir, "documents"), damage=DAMAGE_ONE_IN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: function for name, function in list(globals().items()) if name.startswith("op")
}

# Words of a text, A-Z in lower case, as a DuckDB list.
_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * both_have >= 75 * (len(x.s) + len(y.s) - both_have)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(n_links, 0) AS n_links, component_id
FROM sets JOIN least ON least.a = doc_id LEFT JOIN degree ON degree.a = doc_id""",
}
