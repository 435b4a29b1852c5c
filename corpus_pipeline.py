"""Corpus preparation: toxicity, near copies, repeated substrings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame; all but the last return the columns
of docs. run() writes each stage's result as Parquet to the shared folder, reads it as the next stage's docs, and deletes what the stage
wrote besides. Null, empty, long and repeated texts, ties, empty tables and further columns: see the operator of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from findling.llm import decontamination, packing, simhash, substrings, toxicity
from findling.llm.common import passing, staged
from findling.llm.queries import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under a half by the lexicon learned from labels."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows of 35 words; documents with no word left stay, with an empty text."""
    return substrings.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Learned models, fingerprints and tokenizers are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with passing(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", last=True)
    return docs
