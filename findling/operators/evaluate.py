"""Ranking metrics with one relevant document a query, summaries, misses and percentiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions.vectors import rank_discount

HIT_AT, PRECISION_AT, RECALL_AT = (1, 5, 10, 20), (5, 10), (5, 10, 20)
METRICS = ("mrr", "ndcg_at_10", *(f"hit_at_{k}" for k in HIT_AT), *(f"precision_at_{k}" for k in PRECISION_AT), *(f"recall_at_{k}" for k in RECALL_AT))


def ranks(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """rank of the relevant document of each of relevant(query_id, relevant_doc_id, ...), null if it was not retrieved."""
    found = hits.select("query_id", F.col("doc_id").alias("relevant_doc_id"), "rank").groupBy("query_id", "relevant_doc_id").agg(F.min("rank").alias("rank"))
    return relevant.join(found, ["query_id", "relevant_doc_id"], "left")


def metrics(ranked: DataFrame, cut_ndcg: bool = True) -> DataFrame:
    """Adds the metrics of `rank` to each query."""
    r = F.col("rank")

    def when(test: Column, value: Column | float) -> Column:
        return F.coalesce(F.when(test, value), F.lit(0.0)).cast("double")

    gain = when((r <= 10) if cut_ndcg else r.isNotNull(), rank_discount(r))
    return ranked.select("*", when(r.isNotNull(), 1.0 / r).alias("mrr"), gain.alias("ndcg_at_10"), *(when(r <= k, 1.0).alias(f"hit_at_{k}") for k in HIT_AT), *(when(r <= k, 1.0 / k).alias(f"precision_at_{k}") for k in PRECISION_AT), *(when(r <= k, 1.0).alias(f"recall_at_{k}") for k in RECALL_AT))


def summary(per_query: DataFrame, *by: str, digits: int = 9) -> DataFrame:
    """Number of queries and mean of every metric, in all or by group; zeros for no query."""
    means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), digits).alias(m) for m in METRICS]
    grouped = per_query.groupBy(*by) if by else per_query
    return grouped.agg(F.count(F.lit(1)).alias("num_queries"), *means)


def misses(per_query: DataFrame, beyond: int = 10) -> DataFrame:
    return per_query.filter(F.col("rank").isNull() | (F.col("rank") > beyond))


def imperfect(per_query: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries whose relevant document is not the first hit, with the document that is (null if nothing was retrieved)."""
    first = hits.filter(F.col("rank") == 1).select("query_id", F.col("doc_id").alias("top_doc_id"))
    return misses(per_query, 1).join(first, "query_id", "left")


def deltas(summary: DataFrame, base: str, other: str) -> DataFrame:
    """One row: how much better each metric of the strategy `other` is than that of `base`, and the numbers of queries."""
    own = [F.max(F.when(F.col("strategy") == other, F.col(m))) - F.max(F.when(F.col("strategy") == base, F.col(m))) for m in METRICS]
    return summary.agg(F.max("num_queries").alias("num_queries"), *(F.round(x, 9).alias(f"{m}_delta") for m, x in zip(METRICS, own, strict=True)))


def nearest_rank(values: DataFrame, column: str, share: float = 0.95, *by: str) -> DataFrame:
    """The value at 0-based place int(n * share) of each group's ascending values, found by counts of equal values, so that no
    group is gathered in one place."""
    from pyspark.sql import Window as W

    own = values.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    places = own.withColumn("upto", F.sum("n").over(w.orderBy(column))).withColumn("all", F.sum("n").over(w))
    return places.filter(F.col("upto") > F.floor(F.col("all") * share)).groupBy(*by).agg(F.min(column).alias("p95"))


def interpolated(values: DataFrame, column: str, share: float = 0.95, *by: str) -> DataFrame:
    return values.groupBy(*by).agg(F.percentile(column, F.lit(share)).alias("p95"))


def evaluate(search: Callable[[DataFrame, int], DataFrame], queries: DataFrame, k: int) -> DataFrame:
    """Metrics of any search function (queries, k) -> hits(query_id, doc_id, rank) over queries(query_id, query, relevant_doc_id)."""
    return metrics(ranks(search(queries, k), queries))


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """One summary row for each strategy's per-query metrics."""
    out = None
    for name, per_query in runs.items():
        part = summary(per_query).withColumn("strategy", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def classification(scored: DataFrame, label: str = "label", prediction: str = "prediction", score: str = "score") -> DataFrame:
    """Precision, recall, F1 and area under the ROC curve (by rank sums over distinct scores)."""
    from pyspark.sql import Window as W

    y = F.col(label).cast("int")
    counts = scored.agg(F.count_if((y == 1) & (F.col(prediction) == 1)).alias("tp"), F.count_if((y == 0) & (F.col(prediction) == 1)).alias("fp"), F.count_if((y == 1) & (F.col(prediction) == 0)).alias("fn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    rates = counts.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    bins = scored.groupBy(score).agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(F.lit(1)).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    area = bins.withColumn("below", below).agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    return rates.withColumn("roc_auc", F.coalesce(area.scalar(), F.lit(0.0)))
