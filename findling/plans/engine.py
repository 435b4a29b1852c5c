"""The engine: search, evaluation and segmentation as compositions of the operators."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.functions import text as tx
from findling.operators import evaluate, mine, rerank, retrieve, segment
from findling.operators.index import Index, build, build_fields
from findling.sources import tables
from findling.sources.shared import written
from findling.streaming.ingest import Table, ingest_batch

MODES, SEGMENTERS = ("hybrid", "bm25", "dense"), ("rule", "ml", "llm")
BOOSTS = {"title": 3.0, "abstract": 2.0, "summary": 1.0, "search_text": 1.0}
CANDIDATES = 50


def _checked(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")


@dataclass
class Engine:
    """docs(doc_id, title, abstract, summary, search_text), vectors(doc_id, embedding) and an encoder of queries.

    encoder(queries(query_id, query)) adds an embedding, null where it has none.
    """

    docs: DataFrame
    vectors: DataFrame | None = None
    encoder: Callable[[DataFrame], DataFrame] | None = None
    scorer: Callable[[Column, Column], Column] | None = rerank.overlap_logit
    index: Index | None = None
    fields: dict[str, Index] = field(default_factory=dict)
    boundary_model: object = None
    answers: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.index is None:
            self.index = build(self.docs, tx.counted_terms(F.concat_ws(" ", *(tx.present(F.col(c)) for c in ("title", "abstract", "summary")))))

    @property
    def spark(self) -> SparkSession:
        return self.docs.sparkSession

    def multi_field(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        """BM25 in four boosted fields, the best of which counts."""
        if not self.fields:
            self.fields = build_fields(self.docs, {c: tx.counted_terms(F.col(c)) for c in BOOSTS})
        return retrieve.best_field(self.fields, retrieve.query_terms(queries, tx.terms(F.col("query"))), BOOSTS, k)

    def lexical(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        return retrieve.bm25(self.index, retrieve.query_terms(queries, tx.terms(F.col("query"))), k)

    def dense(self, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
        asked = self.encoder(queries) if self.encoder else queries
        if self.vectors is None or "embedding" not in asked.columns:
            return self.lexical(queries.limit(0), k)
        return retrieve.dense(asked, self.vectors, k)

    def candidates(self, queries: DataFrame, mode: str = "hybrid", k: int = CANDIDATES) -> DataFrame:
        """First-stage hits; any mode but bm25 and dense is the fusion of both."""
        if mode == "bm25":
            return self.lexical(queries, k)
        if mode == "dense":
            return self.dense(queries, k)
        return retrieve.fuse(self.lexical(queries, k), self.dense(queries, k), k)

    def search_all(self, queries: DataFrame, mode: str = "hybrid", rerank_hits: bool = True, top_k: int = 10, top_k_candidates: int = CANDIDATES) -> DataFrame:
        """Hits of all queries(query_id, query), with title, abstract and category of the documents."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        _checked("top_k", top_k, 1, 100)
        _checked("top_k_candidates", top_k_candidates, 1, 200)
        found = self.candidates(queries, mode, top_k_candidates)
        if rerank_hits and self.scorer is not None:
            texts = self.docs.select("doc_id", tx.pair_text(F.col("title"), F.col("abstract")).alias("doc_text"))
            found = rerank.rerank(found, queries, texts, top_k, self.scorer)
        else:
            found = found.filter(F.col("rank") <= top_k)
        shown = [c for c in ("title", "abstract", "category") if c in self.docs.columns]
        found = written(found, "found")
        return mine.of_ids(self.docs.select("doc_id", *shown), found).join(found, "doc_id", "right")

    def search(self, q: str, mode: str = "hybrid", rerank_hits: bool = True, top_k: int = 10, top_k_candidates: int = CANDIDATES, explain: bool = False) -> dict:
        """One query: a dictionary with the hits (top_k of them reach the driver) and, if asked for, the plan."""
        if not q:
            raise ValueError("q must not be empty")
        one = self.spark.createDataFrame([("q", q)], "query_id string, query string")
        start = time.perf_counter()
        hits = self.search_all(one, mode, rerank_hits, top_k, top_k_candidates)
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]
        latency = round(1000 * (time.perf_counter() - start), 2)
        out = {"query": q, "mode": mode, "rerank_applied": bool(rerank_hits and self.scorer), "results_count": len(rows), "results": rows, "latency_ms": latency}
        if explain:
            out["explanation"] = {"stage1": {"bm25": "Okapi BM25", "dense": "exact cosine"}.get(mode, "reciprocal rank fusion, k = 60"), "stage2": "pair scorer" if out["rerank_applied"] else "none", "plan": hits._jdf.queryExecution().simpleString()}
        return out

    def segment_all(self, docs: DataFrame, engine: str = "rule") -> DataFrame:
        """Segments of docs(doc_id, title, abstract, full_text): by rules; `ml` adds the first 50 boundary lines that a fitted
        model predicts, if there is one; `llm` adds stored structures."""
        if engine not in SEGMENTERS:
            raise ValueError(f"engine must be one of {SEGMENTERS}")
        used = "rule" if engine == "ml" and self.boundary_model is None else engine
        out = segment.segmented(docs).withColumn("engine_used", F.lit(used))
        if engine == "ml" and self.boundary_model is not None:
            from findling.operators import lines

            found = lines.predict(self.boundary_model, lines.features(lines.lines(docs))).filter("prediction = 1")
            first = F.slice(F.array_sort(F.collect_list(F.struct("line_no", F.substring("line", 1, 80).alias("preview"), "probability_boundary"))), 1, 50)
            out = out.join(found.groupBy("doc_id").agg(first.alias("boundaries")), "doc_id", "left")
        if engine == "llm":
            out = out.withColumn("doc_id", F.col("doc_id").cast("string")).join(segment.structured(docs, self.answers), "doc_id", "left")
        return out

    def health(self) -> dict:
        """Row counts of what is loaded."""
        size = self.index.size.first()
        return {"status": "healthy", "documents": int(size["n_docs"]), "terms": self.index.terms.count(), "vectors": self.vectors.count() if self.vectors is not None else 0, "scorer": self.scorer is not None}

    def ingest(self, docs: DataFrame, path: str, policy=tables.first_wins) -> str:
        """Ingests docs(doc_id, title, abstract, summary, text) at once into the table and log under `path`; the name of the task."""
        table = Table(self.spark, f"{path}/table")
        ingest_batch(docs.withColumn("seq", F.monotonically_increasing_id()), table.version() or 0, table, f"{path}/log", f"{path}/rows", policy)
        return "sync-execution"

    def task_status(self, task_id: str, path: str | None = None) -> dict:
        """Of the task that ingest() names: done. Of a doc_id: its last row in the log under `path`, UNKNOWN if there is none."""
        if task_id == "sync-execution":
            return {"task_id": task_id, "status": "SUCCESS", "message": "Task was executed synchronously."}
        try:
            row = self.spark.read.parquet(f"{path}/log").filter(F.col("doc_id") == task_id).orderBy(F.desc("batch")).first()
        except Exception as e:  # no log that can be read
            return {"task_id": task_id, "status": "UNKNOWN", "message": str(e).splitlines()[0]}
        if row is None:
            return {"task_id": task_id, "status": "UNKNOWN", "message": "No such document."}
        return {"task_id": task_id, "status": row["status"], **({"error": row["error"]} if row["error"] else {"result": {"embedding_dim": row["embedding_dim"], **row["stats"].asDict()}})}

    def metrics(self, path: str) -> dict:
        """Metrics of each strategy as evaluate_strategies() has written them; zeros for those that are not there."""
        try:
            found = {r["strategy"]: r.asDict() for r in self.spark.read.json(path).collect()}
        except Exception:  # none written yet
            found = {}
        return {name: {m: (found.get(name) or {}).get(m, 0.0) for m in evaluate.METRICS} for name in ("bm25", "dense", "hybrid", "hybrid_rerank")}

    def strategies(self, queries: DataFrame, k: int = CANDIDATES) -> dict[str, DataFrame]:
        """Per-query metrics of four strategies over queries(query_id, query, relevant_doc_id)."""
        known = queries.select("query_id", "relevant_doc_id")
        lexical, dense = written(self.lexical(queries, k), "lexical"), written(self.dense(queries, k), "dense")
        fused = written(retrieve.fuse(lexical, dense, k), "fused")
        texts = self.docs.select("doc_id", tx.pair_text(F.col("title"), F.col("abstract")).alias("doc_text"))
        runs = {"bm25": lexical, "dense": dense, "hybrid": fused, "hybrid_rerank": rerank.rerank(fused, queries, texts, 10, self.scorer)}
        return {name: evaluate.metrics(evaluate.ranks(hits, known)) for name, hits in runs.items()}
