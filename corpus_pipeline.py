"""A corpus pipeline: five stages over ``documents``, each written before the next reads it.

Every stage works on all that its predecessor kept and returns the columns of ``documents``;
the last returns what it reads back from the token files.  Rows count one by one in every stage,
whatever ids they share: ids may be null or repeated, further columns pass unchanged, texts are
taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from requestlab.llm import decontam, jaccard, langid, mixing, queries, wavelet
from requestlab.llm.tables import materialize

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart stay; `und` (null or empty text, no letter) and ambiguous ones go.

    The model is fitted on the labelled documents outside the held-out fold; without any label all go.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join stays, the smallest doc_id (null last).

    Of rows repeated under that id one stays; documents without a word are in no class and stay.
    """
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts and items match nothing."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, three times at most.

    A null source is a source of its own; documents without a word stay once.
    """
    return mixing.repeat_by_mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: a row a document, in the order of doc_id (nulls first, ties by text); null text is empty."""
    return wavelet.token_ids(docs, queries.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mix),
    ("token_ids", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents``; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
