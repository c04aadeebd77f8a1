"""Corpus pipeline: documents through quality, exact and near dedup, mixing and tokenising.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, quality, simhash
from tidemark.session import remove, shared_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, scores 0.5 or more.

    Rows are judged one by one: null text as empty, null ids and repeated rows like any other.
    Without labels the score is the prior; an empty table stays empty."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one of the largest doc_id.

    Null text counts as empty, a null id is smaller than any other, and rows repeated with id and
    text stay once; an empty table stays empty."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id.

    Null, empty and blank texts are one group; a null id is a group's smallest only where it has
    no other; repeated rows stay once; an empty table stays empty."""
    return simhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's budget takes it.

    Null sources are one source; texts of no words are copied as their place in the order says;
    null and repeated ids are rows of their own, and any layout of the rows gives the same mix; an
    empty table stays empty."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, a row a document of the mix.

    Null text counts as empty and has no ids; null ids stay null; repeated rows each get a row;
    an empty table gives no rows."""
    return bpe.encoding_digests(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix),
    ("byte-level bpe", tokenise),
]

#: The classifier and the fingerprints have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what lies between them goes to the shared folder, and
    each stage's input goes once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
