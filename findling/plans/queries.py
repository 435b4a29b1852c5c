"""Registered queries over the given tables, each over all of their rows.

Roles: documents are the corpus (first line: abstract, other lines: summary, title by the usual rule), benchmark items the
queries, embeddings the vectors (vec_id is a doc_id, or an item_id for queries), the first document that holds an item's text
its relevant document. Structured documents are composed of each document's lines.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findling.functions import text as tx
from findling.functions import vectors as vx
from findling.operators import evaluate, lines, mine, rerank, retrieve, segment
from findling.operators.index import Index, build, build_fields
from findling.plans.engine import BOOSTS, CANDIDATES, Engine
from findling.plans.jobs import compare_passages
from findling.sources import tables
from findling.sources.shared import fresh_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.present(F.col("text")).alias("text"))


def corpus(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """doc_id, title, abstract, summary, further columns of documents(), search_text."""
    rows = F.split(F.col("text"), "\n")
    abstract, summary = tx.clean(F.get(rows, F.lit(0))), tx.clean(F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "\n"))
    named = documents(spark, d).select("doc_id", tx.title_of(tx.clean(F.col("text"))).alias("title"), abstract.alias("abstract"), summary.alias("summary"), *more)
    return named.withColumn("search_text", tx.search_text(F.col("title"), F.col("abstract"), F.col("summary")))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tx.present(F.col("text")).alias("query"))


_indexes: dict[tuple[str, ...], Index | dict[str, Index]] = {}


def prepared(spark: SparkSession, d: str, name: str, make: Callable[[], Index | dict[str, Index]]):
    """An index over the tables in d, built and written once in an application and read by all its queries. It is built anew
    when the documents are other files than before."""
    key = (spark.sparkContext.applicationId, d, name, *sorted(table(spark, d, "documents").inputFiles()))
    if key not in _indexes:
        _indexes[key] = make()
    return _indexes[key]


def text_index(spark: SparkSession, d: str) -> Index:
    return prepared(spark, d, "text", lambda: build(documents(spark, d), tx.counted_terms(F.col("text"))))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.query_terms(items(spark, d), tx.terms(F.col("query")))


def lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.bm25(text_index(spark, d), asked(spark, d), k)


def doc_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return own.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return items(spark, d).join(own, "query_id", "left")


def dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    return retrieve.dense(query_vectors(spark, d), doc_vectors(spark, d), k)


def relevant(spark: SparkSession, d: str) -> DataFrame:
    """query_id, relevant_doc_id: the least doc_id whose text holds the item's, null for none. A block of items makes one
    automaton, which goes over each document once; only hits become rows. An empty item is in every document."""
    hits = None
    for block in retrieve.blocks_of(items(spark, d)):
        shared = spark.sparkContext.broadcast([(r["query_id"], r["query"]) for r in block])

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by: dict[str, list[int]] = {}
            for query_id, own in shared.value:
                by.setdefault(own, []).append(query_id)
            always, machine = by.pop("", []), ahocorasick.Automaton()
            for own, ids in by.items():
                machine.add_word(own, ids)
            machine.make_automaton()
            for batch in batches:
                found = set()
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found.update((q, doc) for q in always)
                    if by:
                        found.update((q, doc) for _, ids in machine.iter(text) for q in ids)
                found = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["query_id", "relevant_doc_id"])

        part = documents(spark, d).mapInArrow(find, "query_id long, relevant_doc_id long")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return items(spark, d).select("query_id", F.lit(None).cast("long").alias("relevant_doc_id"))
    return items(spark, d).select("query_id").join(hits.groupBy("query_id").agg(F.min("relevant_doc_id").alias("relevant_doc_id")), "query_id", "left")


def pair_texts(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.col("text").alias("doc_text"))


def specs(spark: SparkSession, d: str) -> DataFrame:
    """Structured documents: an abstract, numbered paragraphs and two claims made of each document's lines."""
    own = F.filter(F.transform(F.split("text", "\n"), tx.strip), lambda x: x != "")
    rows = documents(spark, d).select("doc_id", "text", own.alias("l")).filter(F.size("l") > 0)
    numbered = F.array_join(F.transform("l", lambda x, i: F.concat(F.lit("["), F.lpad((i + 1).cast("string"), 4, "0"), F.lit("] "), x)), "\n")
    first, last = F.get("l", F.lit(0)), F.element_at("l", -1)
    claims = F.concat(F.lit("\n\nCLAIMS\nWhat is claimed is:\n1. A method comprising: "), first, F.lit(";\na second step of it.\n2. The method of claim 1, wherein "), last)
    full = F.concat(F.lit("ABSTRACT\n"), first, F.lit("\n\nBACKGROUND\n"), numbered, claims)
    return rows.select("doc_id", tx.title_of(tx.clean(F.col("text"))).alias("title"), F.lit("").alias("abstract"), full.alias("full_text"))


def spec_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segmented(specs(spark, d))


def plain_segments(spark: SparkSession, d: str) -> DataFrame:
    return segment.segmented(corpus(spark, d, "text").select("doc_id", "title", "abstract", F.col("text").alias("full_text")).filter("doc_id is not null"))


# Text


@query
def tokenize_counts(spark, d):
    t = tx.terms(F.col("text"))
    return documents(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query
def word_counts(spark, d):
    return documents(spark, d).select("doc_id", tx.word_count(F.col("text")).alias("n_words"), F.size(F.array_distinct(tx.lower_words(F.col("text")))).alias("n_distinct"))


@query
def clean_text(spark, d):
    return documents(spark, d).select("doc_id", tx.clean(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


@query
def derive_title(spark, d):
    return corpus(spark, d).select("doc_id", "title")


@query
def heuristic_query(spark, d):
    return corpus(spark, d).select("doc_id", tx.query_of(F.concat(F.lit("A method for "), F.col("title"))).alias("query"))


@query
def stopword_filter(spark, d):
    own = documents(spark, d).select(F.explode(tx.terms(F.col("text"), stopwords=False)).alias("word"))
    return own.filter(F.col("word").isin(*tx.MATCHING_STOPWORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query
def search_texts(spark, d):
    return corpus(spark, d).select("doc_id", F.md5("search_text").alias("search_md5"), F.md5(tx.pair_text(F.col("title"), F.col("abstract"))).alias("pair_md5"))


@query
def summaries(spark, d):
    whole = F.concat(F.lit("Opening.\n\nSUMMARY OF THE INVENTION\n"), F.col("text"), F.lit("\nDETAILED DESCRIPTION\n"), F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(tx.summary_of(tx.clean(whole))).alias("of_header_md5"), F.md5(tx.summary_of(tx.clean(F.col("text")))).alias("of_paragraphs_md5"))


@query
def shape_corpus(spark, d):
    raw = documents(spark, d).select(F.col("doc_id").alias("at"), F.col("text").alias("abstract"), F.col("text").alias("description"))
    return tables.shape_corpus(raw, F.col("at")).select("doc_id", "title", F.md5("summary").alias("summary_md5"))


# Index


@query
def doc_stats(spark, d):
    return documents(spark, d).select("doc_id", F.size(tx.terms(F.col("text"))).alias("dl"))


@query
def term_df_idf(spark, d):
    return text_index(spark, d).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query
def postings(spark, d):
    return text_index(spark, d).postings.select("doc_id", "term", "tf")


@query
def index_size(spark, d):
    return text_index(spark, d).size.select("n_docs", F.round("avgdl", 9).alias("avgdl"))


# Retrieval


def shown(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "doc_id", "rank", "score", *more)


@query
def bm25_top10(spark, d):
    return shown(lexical(spark, d, 10))


@query
def bm25_default_k1(spark, d):
    index = build(documents(spark, d), tx.counted_words(F.col("text")))
    return shown(retrieve.bm25(index, retrieve.query_terms(items(spark, d), tx.lower_words(F.col("query"))), 10, k1=1.5))


@query
def bm25_multifield(spark, d):
    fields = prepared(spark, d, "fields", lambda: build_fields(corpus(spark, d), {c: tx.counted_terms(F.col(c)) for c in BOOSTS}))
    return shown(retrieve.best_field(fields, asked(spark, d), BOOSTS, 10))


@query
def bm25_zero_padded(spark, d):
    odd = items(spark, d).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.col("query")).otherwise("zzqqxx"))
    hits = retrieve.bm25(text_index(spark, d), retrieve.query_terms(odd, tx.terms(F.col("query"))), 10)
    return shown(retrieve.zero_padded(hits, odd, documents(spark, d), 10))


@query
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vx.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vx.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query
def cosine_top10(spark, d):
    return shown(dense(spark, d, 10))


@query
def cosine_pairs(spark, d):
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return own.join(other, "vec_id").select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query
def missing_embeddings(spark, d):
    return tables.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query
def embedded_docs(spark, d):
    return doc_vectors(spark, d).select("doc_id")


@query
def query_embeddings(spark, d):
    return query_vectors(spark, d).select("query_id", F.col("embedding").isNotNull().alias("has_embedding"), F.coalesce(F.size("embedding"), F.lit(0)).alias("size"))


def fused(spark, d, k=CANDIDATES, a=1.0, b=1.0):
    return retrieve.fuse(lexical(spark, d, CANDIDATES), dense(spark, d, CANDIDATES), k, w_lexical=a, w_dense=b)


@query
def rrf_top10(spark, d):
    return shown(fused(spark, d, 10), "bm25_rank", "dense_rank")


@query
def rrf_weighted(spark, d):
    return shown(fused(spark, d, 10, 2.0, 0.5), "bm25_rank", "dense_rank")


@query
def rerank_top10(spark, d):
    out = rerank.rerank(fused(spark, d), items(spark, d), pair_texts(spark, d), 10)
    return shown(out, "raw_logit", "stage1_rank", "stage1_score", "rank_shift")


@query
def rank_shift(spark, d):
    out = rerank.rerank(lexical(spark, d, CANDIDATES), items(spark, d), pair_texts(spark, d), 10)
    return out.groupBy("query_id").agg(F.max("rank_shift").alias("most_up"), F.min("rank_shift").alias("most_down"), F.count_if(F.col("rank_shift") == 0).alias("unmoved"))


@query
def search_pipeline(spark, d):
    engine = Engine(corpus(spark, d), doc_vectors(spark, d), lambda q: query_vectors(spark, d), index=text_index(spark, d))
    return shown(engine.search_all(items(spark, d), "bm25", rerank_hits=False, top_k=10), "title")


# Evaluation


def per_query(spark, d, hits):
    return evaluate.metrics(evaluate.ranks(hits, relevant(spark, d)))


@query
def per_query_metrics(spark, d):
    out = per_query(spark, d, lexical(spark, d, CANDIDATES))
    return out.select("query_id", "relevant_doc_id", "rank", *(F.round(m, 9).alias(m) for m in evaluate.METRICS))


@query
def metrics_summary(spark, d):
    return evaluate.summary(per_query(spark, d, lexical(spark, d, CANDIDATES)))


@query
def metrics_by_type(spark, d):
    out = per_query(spark, d, lexical(spark, d, CANDIDATES)).withColumn("query_type", F.element_at(F.array(*map(F.lit, mine.QUERY_TYPES)), (F.col("query_id") % 4 + 1).cast("int")))
    return evaluate.summary(out, "query_type")


@query
def misses(spark, d):
    return evaluate.misses(per_query(spark, d, lexical(spark, d, CANDIDATES))).select("query_id", "relevant_doc_id", "rank")


@query
def four_way_compare(spark, d):
    known = written(relevant(spark, d), "relevant")
    one, other = written(lexical(spark, d, CANDIDATES), "lexical"), written(dense(spark, d, CANDIDATES), "dense")
    first = written(retrieve.fuse(one, other, CANDIDATES), "fused")
    runs = {"bm25": one, "dense": other, "hybrid": first, "hybrid_rerank": rerank.rerank(first, items(spark, d), pair_texts(spark, d), 10)}
    return evaluate.compare({k: evaluate.metrics(evaluate.ranks(v, known)) for k, v in runs.items()})


@query
def p95_nearest_rank(spark, d):
    return evaluate.nearest_rank(table(spark, d, "events"), "value", 0.95, "event_type")


@query
def p95_interpolated(spark, d):
    return evaluate.interpolated(table(spark, d, "events"), "value", 0.95, "event_type").select("event_type", F.round("p95", 6).alias("p95"))


# Segmentation


@query
def fallback_sections(spark, d):
    return segment.sections_of(plain_segments(spark, d)).select("doc_id", "segment_id", "segment_type", "heading", "start_char", "end_char", "word_count", F.md5("text").alias("text_md5"), "fallback")


@query
def sections(spark, d):
    return segment.sections_of(spec_segments(spark, d)).select("doc_id", "segment_id", "segment_type", "heading", "start_char", "end_char", "word_count", F.md5("text").alias("text_md5"))


@query
def paragraphs(spark, d):
    return segment.paragraphs_of(spec_segments(spark, d)).select("doc_id", "segment_id", "heading", "start_char", "end_char", "section_affinity", "word_count", F.md5("text").alias("text_md5"))


@query
def claims(spark, d):
    return segment.claims_of(spec_segments(spark, d)).select("doc_id", "claim_id", "claim_type", "preamble", "transitional_phrase", "limitations_count", F.md5("text").alias("text_md5"))


@query
def claim_edges(spark, d):
    return segment.claim_edges(spec_segments(spark, d))


@query
def limitations(spark, d):
    return segment.claims_of(spec_segments(spark, d)).select("doc_id", "claim_id", F.posexplode("limitations").alias("n", "limitation")).select("doc_id", "claim_id", "n", F.md5("limitation").alias("limitation_md5"))


@query
def passages(spark, d):
    return segment.passages(spec_segments(spark, d)).select("doc_id", "passage_id", "segment_type", F.md5("text").alias("text_md5"))


@query
def segment_stats(spark, d):
    return spec_segments(spark, d).select("doc_id", "stats.*")


@query
def maxp_top10(spark, d):
    turns = table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("passage_id"), F.col("conv_id").alias("doc_id"), tx.present(F.col("text")).alias("text"))
    index = build(turns, tx.counted_terms(F.col("text")), "passage_id", parent="doc_id")
    return shown(retrieve.best_passages(index, asked(spark, d), 10), "passage_id")


@query
def monolithic_vs_maxp(spark, d):
    asked_of = items(spark, d).join(relevant(spark, d), "query_id")
    return compare_passages(plain_segments(spark, d), asked_of)


@query
def structures(spark, d):
    return segment.structured(documents(spark, d).withColumn("title", F.lit("")))


# Lines


def spec_lines(spark, d):
    return lines.lines(specs(spark, d))


@query
def line_features(spark, d):
    out = lines.features(lines.lines(documents(spark, d).withColumnRenamed("text", "full_text")))
    return out.select("doc_id", "line_no", *(F.round(c, 6).alias(c) for c in lines.FEATURES))


@query
def weak_labels(spark, d):
    return lines.weak_labels(spec_lines(spark, d)).select("doc_id", "line_no", "is_boundary")


@query
def boundary_counts(spark, d):
    return lines.weak_labels(spec_lines(spark, d)).groupBy("is_boundary").agg(F.count(F.lit(1)).alias("n"))


@query
def rf_boundary_metrics(spark, d):
    rows = lines.split(lines.weak_labels(lines.features(spec_lines(spark, d))))
    model = lines.fit(rows.filter("is_train"))
    return evaluate.classification(lines.predict(model, rows.filter("not is_train")), "is_boundary", "prediction", "probability_boundary")


# Mining


def placed(spark, d):
    return mine.positions(table(spark, d, "documents").select("doc_id"))


def targets(spark, d):
    n = table(spark, d, "documents").count()
    return mine.labelled_queries(placed(spark, d), corpus(spark, d).select("doc_id", "title"), n, min(200, n // 4))


@query
def labelled_queries(spark, d):
    return targets(spark, d)


def split_targets(spark, d):
    return mine.stratified(targets(spark, d), order=F.col("query_id"))


@query
def stratified_split_sizes(spark, d):
    return split_targets(spark, d).groupBy("query_type", "split").agg(F.count(F.lit(1)).alias("n"))


def mined(spark, d):
    own = written(split_targets(spark, d), "targets")
    hits = retrieve.bm25(text_index(spark, d), retrieve.query_terms(own, tx.terms(F.col("query"))), 50)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("relevant_doc_id"), "embedding")
    near = retrieve.dense(own.join(vectors, "relevant_doc_id"), doc_vectors(spark, d), 10)
    texts = corpus(spark, d).select("doc_id", tx.pair_text(F.col("title"), F.col("abstract")).alias("doc_text"))
    return mine.training_sets(own, written(mine.negatives(own, hits, near), "negatives"), texts)


@query
def hard_negative_pairs(spark, d):
    return mined(spark, d)[0].select("query_id", "doc_id", "label", "type", "query_type", "split", F.md5("doc_text").alias("text_md5"))


@query
def hard_negative_triples(spark, d):
    return mined(spark, d)[1].select("query_id", "positive_id", "negative_id", "negative_type", "margin", "query_type", "split")


@query
def mining_stats(spark, d):
    return mine.stats(mined(spark, d)[0])


@query
def pair_ranker(spark, d):
    pairs = mined(spark, d)[0].cache()
    model = mine.fit_pair_ranker(pairs.filter("split = 'train'"), mine.pair_features)
    from pyspark.ml.functions import vector_to_array

    val = pairs.filter("split = 'val'")
    rows = val.select("*", *(c.alias(n) for n, c in mine.pair_features(F.col("query"), F.col("doc_text")).items()))
    return mine.ranking_quality(model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1))))


@query
def lsh_recall(spark, d):
    """Share of the exact cosine top 10 that random-projection buckets find."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = doc_vectors(spark, d).select("doc_id", array_to_vector(vx.unit(F.col("embedding"))).alias("v"))
    asked_of = query_vectors(spark, d).filter(F.col("embedding").isNotNull()).select("query_id", array_to_vector(vx.unit(F.col("embedding"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.0, numHashTables=6, seed=7).fit(vectors)

    def hashed(rows, key):
        homes = F.array(*(F.get(vector_to_array(F.get("h", F.lit(n))), F.lit(0)) for n in range(model.getNumHashTables())))
        return model.transform(rows).select(key, vector_to_array("v").alias("v"), homes.alias("buckets"))

    near = retrieve.bucketed(hashed(asked_of, "query_id"), hashed(vectors, "doc_id"), 10, 1.5)
    top = near.select("query_id", "doc_id", F.lit(1).alias("found"))
    return dense(spark, d, 10).join(top, ["query_id", "doc_id"], "left").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("found", F.lit(0))), 4).alias("recall"))


# Sources, sinks and streams


@query
def jsonl_roundtrip(spark, d):
    path = fresh_path(spark, "corpus")
    tables.write_json(corpus(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")), path)
    return tables.read_corpus(spark, path).select("doc_id", "category", F.md5("title").alias("title_md5"), F.md5("search_text").alias("search_md5"))


@query
def embedding_cache(spark, d):
    path = fresh_path(spark, "cache")
    own = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding")
    tables.write_json(own.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(0).cast("float"))), path, "append")
    time.sleep(1.1)  # the later file counts, and some stores keep whole seconds
    tables.write_json(own, path, "append")
    return tables.read_cache(spark, path).select("doc_id", F.size("embedding").alias("size"), F.round(vx.norm(F.col("embedding")), 5).alias("norm"))


def merge_input(spark, d):
    """An old table of all documents, and as new rows all documents again, under keys that are higher by 100."""
    own = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("category"))
    return own, own.select((F.col("doc_id") + 100).alias("doc_id"), F.upper("title").alias("title"), F.upper("category").alias("category"))


@query
def insert_first_wins(spark, d):
    return tables.first_wins(*merge_input(spark, d))


@query
def upsert_last_wins(spark, d):
    return tables.last_wins(*merge_input(spark, d), updated=("title",))


@query
def ingest_stream(spark, d):
    """Streams the documents through ingest in two batches, of all files with first rows and of those with second ones; the
    final table."""
    from findling import schemas
    from findling.streaming.ingest import Table, ingest

    own = documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("first "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("abstract"), F.lit("").alias("summary"), "text")
    landing = fresh_path(spark, "landing")
    own.write.mode("append").json(landing)
    first = len(spark.read.schema(schemas.INGEST).json(landing).inputFiles())
    time.sleep(1.1)  # files are taken by their times, and some stores keep whole seconds
    own.filter("cast(doc_id as long) % 5 = 0").withColumn("title", F.concat(F.lit("second "), F.col("doc_id"))).write.mode("append").json(landing)
    from pyspark.sql import types as T

    stream = spark.readStream.schema(schemas.INGEST).option("maxFilesPerTrigger", first).json(landing).withColumn("seq", F.when(F.col("title").startswith("second"), 1).otherwise(0).cast(T.LongType()))
    result = Table(spark, fresh_path(spark, "table"))
    small = lambda rows: rows.withColumn("embedding", vx.stable_vector(F.col("doc_id"), 8))
    ingest(stream, result, fresh_path(spark, "log"), fresh_path(spark, "checkpoint"), lambda old, new, key: tables.last_wins(old, new, key, ("title", "embedding")), encode=small).awaitTermination()
    return result.read().select("doc_id", F.regexp_extract("title", r"^(\w+)", 1).alias("version"), F.size("embedding").alias("size"))


@query
def windowed_events(spark, d):
    from findling.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, d, "events")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


