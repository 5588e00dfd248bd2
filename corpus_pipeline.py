"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame. run() writes each
stage's result to the shared folder and reads it again, so a lost executor costs no more than a stage; what a stage wrote on
its way is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, packing, quality, simhash
from millrace.llm.common import scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and drops those that are likely toxic or of low quality.

    A null text is rated as an empty one. Repeated rows and null ids are rated like others; an empty table stays empty.
    """
    return quality.select_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (but for the case of A-Z) the one with the largest doc_id stays.

    A null text equals an empty one, a null id comes before all others, of repeated rows one stays.
    """
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of five words, similarity of 0.8 or more) the least doc_id stays.

    A null text has one empty shingle, as every text without words has. Rows with a null id all stay.
    """
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to the square root of their size, by repeating documents, in a global random order.

    A null source is a source, a null id hashes as a word; a table without any characters gives no rows.
    """
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048.

    A null text has the end token alone. Repeated rows are packed as often as they come; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("source_mixing", source_mixing),
    ("best_fit_packing", packed),
]

#: No stage from the classifier on can be told in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
