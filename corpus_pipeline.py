"""A training-data pipeline over `documents`: each stage is a table written as Parquet and read by the next.

Null ids, null and empty texts, repeated rows, empty tables and extra columns have the results that the operators'
docstrings state. Every stage but the last returns the columns of its input.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptmill.llm import bpe, decontaminate, jaccard, language, line_dedup
from scriptmill.llm.common import bounded, passing, stage, table

#: a document is rejected if no language has at least this mean probability
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language prevails. Texts without a letter go, as do those with a null id."""
    prevails = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    named = docs.where("doc_id is not null")
    with passing(spark):
        # of rows that share an id one is enough; those that go are few where most texts are prose, so that no text is shuffled
        gone = stage(language.identify(docs, language.fit_field(docs)).where("doc_id is not null").select(
            F.col("doc_id").alias("_gone"), F.coalesce(prevails, F.lit(False)).alias("_prevails")).groupBy("_gone").agg(
            F.max("_prevails").alias("_prevails")).where("not _prevails").select("_gone"), "other-languages", lasting=True)
    return named.join(bounded(gone), F.col("doc_id") == F.col("_gone"), "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier document has; those with nothing left go.

    `n_chars`, where there is such a column, is that of the new text.
    """
    left = line_dedup.drop_repeated_lines(docs).where("text <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each component of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", dedup_documents),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode_bpe),
]
#: a trained model, lookbehind patterns and byte-pair merges are not SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        with passing(spark):
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return docs


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
