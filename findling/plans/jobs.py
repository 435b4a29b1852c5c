"""Batch jobs: corpus, embeddings, evaluation, mining, segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.functions import text as tx
from findling.operators import evaluate, mine, segment
from findling.operators.index import counted_rows, of_counted
from findling.operators.retrieve import best_passages, bm25, query_terms
from findling.plans.engine import Engine
from findling.sources import tables
from findling.sources.shared import written


def build_corpus(spark: SparkSession, raw_path: str, out_path: str, n: int | None = 10_000) -> None:
    """Documents of raw Parquet files, in the files' order, as JSON lines; of those that are long enough, the first n if given."""
    tables.write_json(tables.shape_corpus(tables.read_raw(spark, raw_path), F.col("_at"), n=n), out_path)


def embed_missing(corpus: DataFrame, cache_path: str, encode: Callable[[DataFrame], DataFrame], first: DataFrame | None = None, limit: int | None = None) -> None:
    """Embeds documents that the cache lacks, those of `first`(doc_id) before the rest, and appends them to the cache."""
    spark = corpus.sparkSession
    try:
        known = tables.read_cache(spark, cache_path)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = corpus.select("doc_id").limit(0)
    todo = tables.missing(corpus, known)
    if limit is not None:
        early = first.select("doc_id", F.lit(0).alias("turn")).distinct() if first is not None else corpus.select("doc_id").limit(0).withColumn("turn", F.lit(0))
        todo = todo.join(early, "doc_id", "left").orderBy(F.coalesce("turn", F.lit(1)), "doc_id").limit(limit).drop("turn")
    tables.write_json(encode(todo).select("doc_id", "embedding"), cache_path, "append")


def evaluate_strategies(engine: Engine, queries: DataFrame, out_path: str | None = None) -> DataFrame:
    out = evaluate.compare(engine.strategies(queries))
    if out_path:
        tables.write_json(out, out_path)
    return out


def mine_training_sets(engine: Engine, queries: DataFrame, out_path: str) -> DataFrame:
    """Writes train and val pairs and triples; returns their counts."""
    split = mine.stratified(queries)
    found = written(mine.negatives(split, engine.lexical(split), engine.dense(split)), "negatives")
    texts = engine.docs.select("doc_id", tx.pair_text(F.col("title"), F.col("abstract")).alias("doc_text"))
    pairs, triples = mine.training_sets(split, found, texts)
    tables.write_json(pairs, f"{out_path}/pairs", "overwrite", "split")
    tables.write_json(triples, f"{out_path}/triples", "overwrite", "split")
    return mine.stats(pairs)


def compare_passages(segments: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    """Whole documents against best passages, both with library-default BM25 over white-space words; evaluate.deltas() gives the differences."""
    known = queries.select("query_id", "relevant_doc_id")
    asked = query_terms(queries, tx.lower_words(F.col("query")))
    whole = F.struct(F.lit(None).cast("string").alias("passage_id"), F.lit("WHOLE").alias("segment_type"), F.concat_ws(" ", "title", "abstract", "body").alias("text"))
    texts = segments.select("doc_id", F.inline(F.concat(F.array(whole), segment.passage_rows())))
    # both from one pass over the segments; of their texts only the counts are written
    counted = written(counted_rows(texts.withColumnRenamed("doc_id", "parent"), tx.counted_words(F.col("text")), "passage_id", "parent", "segment_type"), "counted", "segment_type")
    documents, own = counted.filter("segment_type = 'WHOLE'").withColumn("doc_id", F.col("parent")).drop("parent"), counted.filter("segment_type <> 'WHOLE'")
    runs = {"monolithic": bm25(of_counted(documents), asked, k, k1=1.5), "passage_maxp": best_passages(of_counted(own), asked, k, k1=1.5)}
    return evaluate.compare({name: evaluate.metrics(evaluate.ranks(hits, known), cut_ndcg=False) for name, hits in runs.items()})
