"""The entry point, engine validation, and some registered queries against DuckDB."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from findling.operators.index import Index
from findling.plans import queries as q
from findling.plans.engine import Engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
CHOSEN = ("tokenize_counts", "bm25_top10", "cosine_top10", "rrf_weighted", "metrics_by_type", "paragraphs", "mining_stats", "upsert_last_wins", "ingest_log", "p95_nearest_rank", "shape_corpus", "search_hybrid_rerank", "corpus_job", "embed_job", "structures_from_answers")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "events", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda rows, cols: sorted(str([f"{v:.6g}" if isinstance(v, float) else str(v) for v in (r[cols.index(c)] for c in order)]) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Steel widget frame", "A frame of steel.", "s"), ("b", "Paper lamp", "A lamp made of paper.", "s")], "doc_id string, title string, abstract string, summary string").withColumn("search_text", F.col("title"))
    engine = Engine(docs)
    found = engine.search("steel frame", explain=True)
    assert [r["doc_id"] for r in found["results"]] == ["a"] and found["explanation"]["stage2"] == "pair scorer"
    for bad in ({"q": ""}, {"q": "x", "mode": "none"}, {"q": "x", "top_k": 0}, {"q": "x", "top_k_candidates": 201}):
        with pytest.raises(ValueError):
            engine.search(**bad)
    with pytest.raises(ValueError):
        engine.segment_all(docs, "other")
    assert engine.health()["documents"] == 2
    engine.index.write(str(tmp_path / "index"), buckets=2)
    again = Engine(docs, index=Index.read(spark, str(tmp_path / "index")))
    assert again.search("paper lamp", "bm25", rerank_hits=False)["results"][0]["doc_id"] == "b"


def test_mined_counts(spark):
    rows = {r.split: r for r in q.QUERIES["mining_stats"](spark, DATA).collect()}
    assert all(r.total_pairs - r.total_triples == r.num_queries for r in rows.values())


def test_positions_are_whole_with_wide_rows(spark):
    from findling.operators.mine import positions
    from findling.sources import tables

    wide = spark.range(60_000, numPartitions=7).select(F.col("id").alias("doc_id"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"), F.rand(3).alias("r")).repartition(9, "r")
    for adaptive, parts in (("true", "40"), ("false", "4")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            placed = positions(wide)
            assert placed.filter("pos = doc_id and length(text) = 640").count() == 60_000
            narrow = positions(wide.select("doc_id", "text")).select("pos", "doc_id")
            assert narrow.filter("pos = doc_id").count() == 60_000
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    raw = wide.select("doc_id", F.col("text").alias("abstract"), F.col("text").alias("description"))
    assert tables.shape_corpus(raw, F.col("doc_id")).select(F.countDistinct("doc_id")).first()[0] == 60_000


def test_engine_ingest_status_and_metrics(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Steel widget", "A frame.", "", None), (None, "No key", "x", "", ""), ("b", "Lamp", "", "", "1. A lamp comprising: a bulb of glass; and a socket.")], "doc_id string, title string, abstract string, summary string, text string")
    engine = Engine(docs.filter("doc_id is not null").withColumn("search_text", F.col("title")))
    path = f"file://{tmp_path}/tasks"
    assert engine.task_status("a", path)["status"] == "UNKNOWN"
    assert engine.task_status(engine.ingest(docs, path))["status"] == "SUCCESS"
    done = engine.task_status("a", path)
    assert done["status"] == "SUCCESS" and done["result"]["embedding_dim"] == 768 and "claim_count" in done["result"]
    assert engine.task_status("zz", path)["status"] == "UNKNOWN"
    log = spark.read.parquet(f"{path}/log")
    assert log.filter("status = 'FAILED' and error = 'doc_id is missing'").count() == 1 and log.count() == 3
    engine.ingest(docs.withColumn("title", F.lit("again")), path)
    from findling.streaming.ingest import Table

    assert {r.doc_id: r.title for r in Table(spark, f"{path}/table").read().collect()} == {"a": "Steel widget", "b": "Lamp"}
    assert "latency_ms" in engine.search("steel", "bm25", rerank_hits=False)
    full = docs.filter("doc_id = 'b'").select("doc_id", "title", "abstract", F.col("text").alias("full_text"))
    assert {k: engine.segment_all(full, k).first().engine_used for k in ("rule", "ml")} == {"rule": "rule", "ml": "rule"}
    assert engine.metrics(f"{path}/none")["bm25"]["mrr"] == 0.0
    queries = spark.createDataFrame([(1, "steel widget", "a"), (2, "lamp", "b")], "query_id long, query string, relevant_doc_id string")
    from findling.plans import jobs
    from findling.sources import tables

    out = jobs.evaluate_strategies(engine, queries, f"{path}/metrics")
    assert engine.metrics(f"{path}/metrics")["bm25"]["mrr"] == 1.0 and "| bm25 |" in tables.report(out, "Metrics")


def test_scratch_needs_a_shared_folder(monkeypatch, spark):
    from types import SimpleNamespace

    from findling.sources import shared

    far = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app-1", master="spark://x", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(ValueError):
        shared.shared_dir(far)


def test_entry_without_the_training_data_package(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path / "copy", capture_output=True, text=True, check=True)
    assert said.stdout.split()[1:] == ["True", "False"]
