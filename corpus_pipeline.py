"""A training corpus from the documents table: five stages, each on all that the one before it kept.

toxicity            documents predicted toxic go
line_dedup          lines of recurring templates go from all documents but the first
simhash_near_dedup  of each class of near-duplicates the document with the smallest id stays
suffix_dedup        bytes of long repeated passages go
packing             the rest becomes sequences of token ids (pieces with their ids)

All stages but the last return the columns of documents, n_chars brought up to date. Documents whose
text has become empty stay until near-dedup, where they are one class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm.common import cut, small_batches, table
from pressmill.llm.lines import without_recurring
from pressmill.llm.packing import packed
from pressmill.llm.queries import tokenizer_path
from pressmill.llm.repeats import without_repeats
from pressmill.llm.simhash import drop_near_duplicates
from pressmill.llm.toxicity import without_toxic


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(without_recurring(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return counted(without_repeats(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL can express neither the model nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)  # the next stage reads its input several times
    return docs
