"""From documents to piece ids: five stages, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate class stays, passages that repeat across the remaining
documents are cut out of all but the first, documents with benchmark passages go, and what is left is encoded. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelcast.llm import decontaminate, ngram_join, pieces, queries, repeats, toxicity
from parcelcast.llm.common import table
from parcelcast.session import scratch_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under 0.5, by a classifier learned from the labelled rows of ``docs`` outside fold 0. Null and
    empty texts score the base rate and stay."""
    return toxicity.reject(docs, queries.toxicity_model(spark, docs, sf_dir))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of near duplicates. Of empty texts one stays; rows with a null id stay."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id has; rows that become empty go."""
    return repeats.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark passage is found; null and empty texts stay."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of every row; null and empty texts have no ids."""
    ids = pieces.encode(docs, queries.piece_vocabulary())
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("benchmark", without_benchmark),
    ("pieces", encoded),
]

#: The trained, hashed and searched stages have no SQL form; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
