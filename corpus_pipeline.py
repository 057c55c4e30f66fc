"""A corpus pipeline: STAGES in order, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of `documents`.
`run` applies them to `documents`, each result written as Parquet to the shared folder and read again.

Whole texts go to Python workers in batches of bounded bytes. Rows with null, empty or repeated texts and ids are judged
like others: a text without a recognisable language goes in the first stage, nulls among them; of equal rows one
stays; other columns are kept as they are, whatever their names; without documents every stage gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import bpe, decontamination, language, minhash, secret_scan
from packetloom.settings import bounded_batches, settle


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    bounded_batches(spark)
    return language.with_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    bounded_batches(spark)
    return minhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    bounded_batches(spark)
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; `n_chars` follows the text."""
    bounded_batches(spark)
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    bounded_batches(spark)
    return bpe.encode(docs, bpe.tokenizer_file(spark)).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_removal),
    ("BPE encoding", token_ids),
]

#: SQL cannot express the language model, ProbMinHash or BPE; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
