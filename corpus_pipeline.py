"""From raw documents to packed training sequences: the stages, each on what its predecessor kept.

Every stage but the last returns the columns of ``documents``. An empty table passes through; null and empty texts score
the labels' share, are copies of each other, hold no benchmark item and no personal data, and pack to one id.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontaminate, near_dups, packing, pii, quality
from touchline.llm.queries import TOKENIZER
from touchline.llm.shared import documents, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, quality.learn(docs, documents(spark, sf_dir, "labels")))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    return near_dups.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, documents(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked."""
    return pii.redacted(docs, pii.learn(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [("quality", good_quality), ("near_dedup", one_of_near_copies), ("decontamination", without_benchmark),
          ("personal_data", without_personal_data), ("packing", packed)]
ORACLE_SQL = None  # the classifier, the tagger and the tokenizer have no SQL; the tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
