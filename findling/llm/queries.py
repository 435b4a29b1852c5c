"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from findling.llm import decontamination, idfiles, language, media, packing, pieces, sharding, simhash, substrings, toxicity
from findling.llm.common import staged
from findling.llm.oracles import ORACLE_SQL as ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op4_bitplane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.id_file_table(table(spark, sf_dir, "documents"))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed_table(table(spark, sf_dir, "documents"))


def op8_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(staged(media.media_table(table(spark, sf_dir, "documents")), "media"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_language_id, op3_rendezvous_shards, op4_bitplane_files, op5_best_two_fit, op6_toxicity, op7_substring_dedup, op8_media_png, op9_decontamination, op10_simhash)}
