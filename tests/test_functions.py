"""Text and vector functions and metrics against plain Python and published values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from findling.functions import text as tx
from findling.functions import vectors as vx
from findling.operators import evaluate, retrieve
from findling.operators.index import build


def values(spark, rows, f):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, x string")
    return [r.y for r in df.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def test_terms(spark):
    rows = ["The Optical-Fiber, fiber", "don't can't", "naïve café x1", "foo_bar baz", "", None, "A 1 b2"]
    assert values(spark, rows, tx.terms) == [["optical", "fiber", "fiber"], ["don", "t", "can", "t"], ["x1"], ["baz"], [], [], ["1", "b2"]]


def test_stopwords_are_whole():
    assert len(set(tx.STOPWORDS)) == len(tx.STOPWORDS) == 172 and len(tx.MATCHING_STOPWORDS) == 122


def test_clean_and_counts(spark):
    rows = ["  a \t b\n\n\n\nc ", "", "x y z"]
    assert values(spark, rows, tx.clean) == [re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", x)).strip() for x in rows]
    assert values(spark, rows, tx.word_count) == [len(x.split()) for x in rows]


def test_term_counts(spark):
    got = values(spark, ["b a b c b a", "", "z"], lambda c: tx.term_counts(tx.terms(c, stopwords=False)))
    assert [[tuple(x) for x in y] for y in got] == [[("a", 2), ("b", 3), ("c", 1)], [], [("z", 1)]]


def test_titles(spark):
    rows = ["A widget for making things. More.", "Short. " + "word " * 60, "[12] A long enough first sentence here. x", "x" * 180]
    got = values(spark, rows, tx.title_of)
    assert got[0] == "A widget for making things" and got[1].endswith("...") and got[2] == "A long enough first sentence here" and got[3] == "x" * 180


def test_query_of(spark):
    assert values(spark, ["A method for making the very long and useful widget of steel with nine ten more words"], tx.query_of) == ["making very long useful widget steel nine ten"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vx.norm(F.col("a")).alias("n"), vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.unit(F.col("a")).alias("u")).collect()
    assert [tuple(r) for r in rows] == [(5.0, 0.96, [0.6, 0.8]), (0.0, 0.0, [0.0, 0.0])]
    one = spark.range(1).select(vx.stable_vector(F.lit("x"), 32).alias("v"))
    assert abs(sum(x * x for x in one.first().v) - 1) < 1e-5 and one.first() == one.first()


@pytest.mark.parametrize(("ranks", "mrr", "ndcg"), [([1] * 190 + [2] * 9 + [6], 0.9733333333, 0.9801728748), ([1] * 191 + [2] * 6 + [3] * 3, 0.975, 0.9814278926), ([1] * 198 + [2, 4], 0.99375, 0.9953080316)])
def test_published_summaries(spark, ranks, mrr, ndcg):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(ranks)], "query_id int, rank int")
    row = evaluate.summary(evaluate.metrics(df)).first()
    assert abs(row.mrr - mrr) < 1e-8 and abs(row.ndcg_at_10 - ndcg) < 1e-8 and row.num_queries == 200


def test_missed_rank_scores_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, 21)], "query_id int, rank int")
    a, b = evaluate.metrics(df).orderBy("query_id").collect()
    assert a.mrr == 0 and b.ndcg_at_10 == 0 and abs(b.mrr - 1 / 21) < 1e-12


def test_fusion_values(spark):
    a = spark.createDataFrame([("q", "x", 6), ("q", "y", 1)], "query_id string, doc_id string, rank int")
    b = spark.createDataFrame([("q", "x", 1), ("q", "z", 1)], "query_id string, doc_id string, rank int")
    got = [(r.doc_id, r.score) for r in retrieve.fuse(a, b, 5).orderBy("rank").collect()]
    assert got == [("x", 0.031544958), ("y", 0.016393443), ("z", 0.016393443)]


def test_bm25_against_plain_python(spark):
    texts = ["a b c", "a a b", "a", "", "d d e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    queries = spark.createDataFrame([("q", "a d d")], "query_id string, query string")
    tokens = [t.split() for t in texts]
    n, avg = len(tokens), sum(map(len, tokens)) / len(tokens)
    df = {w: sum(w in t for t in tokens) for t in tokens for w in t}
    raw = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = {}
    for k, t in enumerate(tokens):
        s = sum(idf[w] * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in ("a", "d", "d"))
        if any(w in t for w in "ad"):
            want[k] = round(s, 6)
    index = build(docs, tx.lower_words(F.col("text")))
    got = {r.doc_id: r.score for r in retrieve.bm25(index, retrieve.query_terms(queries, tx.lower_words(F.col("query"))), 10).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(20)] + [("b", 7.0)], "g string, v double")
    assert {r.g: r.p95 for r in evaluate.nearest_rank(df, "v", 0.95, "g").collect()} == {"a": 19.0, "b": 7.0}
