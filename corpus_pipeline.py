"""The corpus pipeline: stages over ``documents``, each applying one training-data operator.

Every stage reads what its predecessor wrote. The first four are filters and return the
columns of ``documents``; the last encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecharbor.llm import bpe, decontam, quality, simhash, toxicity
from vecharbor.llm.common import materialize, read
from vecharbor.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_rows(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontam.clean_rows(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encoded(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]

#: Models, iterated links and byte-pair merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
