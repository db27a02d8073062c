"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes the documents that the one before kept. `run` writes each stage's result to the shared folder and
reads it back, so that a later stage doesn't repeat the earlier ones.

In every stage null and empty texts are documents of no words (one of them stays as the group of equal texts), texts of any
length are treated whole, and rows without a doc_id pass all but the classifier untouched. Rows that repeat a doc_id are judged each by itself by the classifier;
near-duplicates and benchmark leaks keep or drop them together, and of different texts under one doc_id only one is searched for passages.
Empty tables give no rows; further columns pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import bpe, decontam, passages, simhash, sites
from scholia.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return sites.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles agree by 0.8 or more."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has."""
    return passages.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens: their number, and digests of the ids and of the text decoded from them."""
    return bpe.digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Stages fit models and align texts, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
