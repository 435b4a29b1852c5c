"""Searches whose pairs never become rows, against the plain way."""

import numpy as np
from pyspark.sql import functions as F

from findling.operators import retrieve


def test_bucketed_equals_the_join_of_all_pairs(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(3)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(300, 6)))]
    rows += [(k + 300, x) for k, x in rows[:50]]  # equal vectors: ties by key
    vectors = spark.createDataFrame(rows, "doc_id long, e array<double>").select("doc_id", array_to_vector("e").alias("v")).repartition(5)
    asked = vectors.filter("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.8, numHashTables=3, seed=7).fit(vectors)
    joined = model.approxSimilarityJoin(asked, vectors, 1.9, "distance").select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.doc_id").alias("doc_id"), (-F.col("distance")).alias("score"))
    want = retrieve.ranked(joined, 10, F.desc("score"), F.asc("doc_id"))

    def hashed(rows, key):
        return model.transform(rows).select(key, vector_to_array("v").alias("v"), F.array(*(F.get(vector_to_array(F.get("h", F.lit(n))), F.lit(0)) for n in range(3))).alias("buckets"))

    got = retrieve.bucketed(hashed(asked, "query_id"), hashed(vectors, "doc_id"), 10, 1.9)
    as_set = lambda df: {(r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect()}
    assert as_set(got) == as_set(want) and got.count() < 10 * asked.count()
    assert retrieve.bucketed(hashed(asked.limit(0), "query_id"), hashed(vectors, "doc_id"), 10, 1.9).count() == 0


def test_no_pair_of_the_bucket_query_is_a_row(spark):
    from findling.plans import queries as q

    plan = q.QUERIES["lsh_recall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_distinct" not in plan and "datasetA" not in plan


def test_best_holds_k_of_each_query_over_parts():
    rng = np.random.default_rng(5)
    scores = np.where(rng.random((4, 500)) < 0.1, -np.inf, rng.integers(0, 9, (4, 500)).astype(float))
    scores[3] = -np.inf
    keys = rng.permutation(500).astype(str).astype(object)
    best = retrieve.Best(4, 7)
    for at in range(0, 500, 61):
        best.add(scores[:, at : at + 61], keys[at : at + 61])
    got = list(zip(best.rows.tolist(), best.scores.tolist(), best.keys.tolist(), strict=True))
    want = [(n, -s, k) for n in range(4) for s, k in sorted((-scores[n, m], keys[m]) for m in range(500) if scores[n, m] > -np.inf)[:7]]
    assert got == want


def _texts(spark, n=400):
    rng = np.random.default_rng(11)
    rows = [(k, k // 3, " ".join(rng.choice(["the", "a", "steel", "lamp", "é", "frame", "x1", "rod"], size=rng.integers(0, 12)).tolist())) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, home long, text string").repartition(5)


def _plain(rows, query, k1=1.2):
    import math
    from collections import Counter

    own = {k: t.split() for k, _, t in rows}
    df, avg = Counter(w for t in own.values() for w in set(t)), sum(map(len, own.values())) / len(own)
    raw = {w: math.log(len(own) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    asked = [w for w in query.split() if w in df]
    return {k: round(sum(idf[w] * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (0.25 + 0.75 * len(t) / avg)) for w in asked), 6) for k, t in own.items() if set(t) & set(asked)}


def test_scores_where_documents_lie(spark, monkeypatch):
    from findling.functions import text as tx
    from findling.operators.index import build

    monkeypatch.setattr(retrieve, "HELD", 90)  # many parts of a batch
    rows, docs = _texts(spark)
    asked = {1: "steel lamp steel", 2: "the frame zz", 3: "zz", 4: ""}
    queries = retrieve.query_terms(spark.createDataFrame(list(asked.items()), "query_id long, query string"), tx.lower_words(F.col("query")))
    hits = retrieve.bm25(build(docs, tx.counted_words(F.col("text"))), queries, 20)
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
    want = {(q, k): s for q, text in asked.items() for s, k in [(-s, k) for s, k in sorted((-s, k) for k, s in _plain(rows, text).items())[:20]]}
    got = {(r.query_id, r.doc_id): r.score for r in hits.collect()}
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 2e-6 for x in want)

    nested = retrieve.best_passages(build(docs, tx.counted_words(F.col("text")), parent="home"), queries, 15)
    home, best = {k: h for k, h, _ in rows}, {}
    for q, text in asked.items():
        for k, s in sorted(_plain(rows, text).items()):
            if (q, home[k]) not in best or s > best[q, home[k]][0]:
                best[q, home[k]] = (s, k)
    kept = {(q, h): best[q, h] for q in asked for _, h in sorted((-s, h) for (p, h), (s, _) in best.items() if p == q)[:15]}
    found = {(r.query_id, r.doc_id): (r.score, r.passage_id) for r in nested.collect()}
    assert set(found) == set(kept) and all(abs(found[x][0] - kept[x][0]) < 2e-6 and found[x][1] == kept[x][1] for x in kept)


def test_counted_words_are_those_of_the_expressions(spark):
    from findling.functions import text as tx

    odd = ["The Optical-Fiber, fiber don't", "naïve café x1 foo_bar\x1cbaz é", "", None, "İI ࡰa b c\x85d"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(odd)], "k int, x string")
    for plain, counted in ((tx.terms, tx.counted_terms), (tx.lower_words, tx.counted_words)):
        for r in df.select(tx.term_counts(plain(F.col("x"))).alias("p"), F.size(plain(F.col("x"))).alias("n"), counted(F.col("x")).alias("q")).collect():
            assert r.p == r.q.own and r.n == r.q.dl


def test_only_ids_are_numbered_and_few_texts_are_made(spark, monkeypatch):
    from findling.operators import mine
    from findling.plans import queries as q

    real, told = mine.positions, []
    monkeypatch.setattr(mine, "positions", lambda docs, *more: told.append(docs.columns) or real(docs, *more))
    pairs, _ = q.mined(spark, "/root/testdata/sf0.001")
    assert told == [["doc_id"]]
    assert "documents.parquet" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_reranked_texts_are_not_shuffled(spark):
    from findling.operators import rerank

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("steel "), 50).alias("doc_text")).repartition(4)
    first = spark.createDataFrame([(1, 7, 1, 2.0), (1, 9, 2, 1.0)], "query_id long, doc_id long, rank int, score double")
    plan = rerank.rerank(first, spark.createDataFrame([(1, "steel")], "query_id long, query string"), docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [doc_id" in plan and "LeftSemi" in plan


def test_ingest_stream_lands_one_file_for_each_part(spark, monkeypatch, tmp_path):
    from findling.plans import queries as q

    monkeypatch.setattr(q, "fresh_path", lambda _, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(q, "documents", lambda spark, d: spark.range(60, numPartitions=6).select(F.col("id").alias("doc_id"), F.lit("A text.").alias("text")))
    got = {r.doc_id: r.version for r in q.QUERIES["ingest_stream"](spark, "").collect()}
    assert len(list((tmp_path / "landing").glob("part-*"))) == 12
    assert got == {str(k): "second" if k % 5 == 0 else "first" for k in range(60)}
    assert len(list((tmp_path / "log").glob("batch=*"))) == 2


def test_parts_without_an_asked_term(spark):
    from findling.functions import text as tx
    from findling.operators.index import build

    docs = spark.createDataFrame([(k, "steel" if k == 7 else "" if k % 2 else "lamp") for k in range(12)], "doc_id long, text string").repartition(12)
    for parent in (None, "doc_id"):
        index = build(docs, tx.counted_terms(F.col("text")), parent=parent)
        asked = retrieve.query_terms(spark.createDataFrame([(1, "steel"), (2, "none")], "query_id long, query string"), tx.terms(F.col("query")))
        hits = (retrieve.best_passages if parent else retrieve.bm25)(index, asked, 5)
        assert [(r.query_id, r.doc_id, r["rank"]) for r in hits.collect()] == [(1, 7, 1)]
