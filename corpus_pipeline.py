"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and all but the last return the columns of documents.  Rows with nulls in any
column are handled as the operators document it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spoolglass.llm.chaining import cut_passages
from spoolglass.llm.common import fresh_path, table
from spoolglass.llm.decontamination import clean_documents
from spoolglass.llm.piece_tokens import encode_decode
from spoolglass.llm.quality import kept_documents
from spoolglass.llm.queries import vocabulary
from spoolglass.llm.simhash import first_of_similar


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep; null and empty texts go."""
    return kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of five-word shingles or more, chained) the document with the smallest id.

    Rows that share an id, or have none, are compared by their texts like all others.
    """
    return first_of_similar(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document of a smaller id has, word for word or nearly."""
    return cut_passages(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and decoded text of each document."""
    return encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: No SQL: the stages use zstandard, XXH64, alignments and a vocabulary; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each writes its documents in the shared folder, and the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
