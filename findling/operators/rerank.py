"""Second stage: candidates scored as (query, document) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions import text as tx
from findling.functions.vectors import sigmoid
from findling.operators.mine import of_ids
from findling.operators.retrieve import DIGITS, ranked
from findling.sources.shared import written


def overlap_logit(query: Column, text: Column) -> Column:
    """Stand-in for a trained pair scorer: 4 times the share of the query's distinct terms in the text, less 2."""
    q = F.array_distinct(tx.terms(query))
    share = F.size(F.array_intersect(q, F.array_distinct(tx.terms(text)))) / F.when(F.size(q) > 0, F.size(q)).otherwise(1)
    return F.round(4.0 * share - 2.0, DIGITS)


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int = 10, scorer: Callable[[Column, Column], Column] | None = overlap_logit) -> DataFrame:
    """candidates(query_id, doc_id, rank, score) with queries(query_id, query) and docs(doc_id, doc_text): rank, score
    (probability), raw_logit, stage1_rank, stage1_score and rank_shift of the best k. Without a scorer, the first k as they are.

    Texts are joined to the few candidates only; a scorer may be a column expression or a vectorised UDF.
    """
    first = candidates.select("query_id", "doc_id", F.col("rank").alias("stage1_rank"), F.col("score").alias("stage1_score"))
    if scorer is None:
        return first.filter(F.col("stage1_rank") <= k).withColumn("rank", F.col("stage1_rank")).withColumn("score", F.col("stage1_score"))
    first = written(first, "candidates")  # of a known size, so that they go to the texts if they are few
    pairs = of_ids(docs.select("doc_id", "doc_text"), first).join(first, "doc_id").join(queries.select("query_id", "query"), "query_id")
    scored = pairs.withColumn("raw_logit", scorer(F.col("query"), F.col("doc_text"))).drop("query", "doc_text")
    best = ranked(scored, k, F.desc("raw_logit"), F.asc("stage1_rank"))
    return best.withColumn("score", F.round(sigmoid(F.col("raw_logit")), DIGITS)).withColumn("rank_shift", F.col("stage1_rank") - F.col("rank"))
