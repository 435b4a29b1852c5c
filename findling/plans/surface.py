"""Registered queries over readers, sinks, jobs and the engine's calls, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from findling import schemas
from findling.functions import text as tx
from findling.functions import vectors as vx
from findling.operators import evaluate, mine, retrieve, segment
from findling.operators.index import Index
from findling.plans import jobs
from findling.plans import oracles as o
from findling.plans.engine import CANDIDATES, Engine
from findling.plans.queries import asked, corpus, dense, doc_vectors, documents, items, lexical, mined, per_query, plain_segments, query, query_vectors, relevant, table, targets, text_index
from findling.sources import tables
from findling.sources.shared import fresh_path, written
from findling.streaming.ingest import Table, ingest


def engine_of(spark, d) -> Engine:
    """Whole texts as titles, so that the pair scorer reads all of them."""
    docs = documents(spark, d).select("doc_id", F.col("text").alias("title"), F.lit("").alias("abstract"))
    return Engine(docs, doc_vectors(spark, d), lambda q: query_vectors(spark, d), index=text_index(spark, d))


@query
def persisted_index_top10(spark, d):
    path = fresh_path(spark, "index")
    text_index(spark, d).write(path)
    return retrieve.bm25(Index.read(spark, path), asked(spark, d), 10).select("query_id", "doc_id", "rank", "score")


@query
def search_hybrid_rerank(spark, d):
    return engine_of(spark, d).search_all(items(spark, d), "hybrid", rerank_hits=True, top_k=10).select("query_id", "doc_id", "rank", "score")


@query
def search_dense(spark, d):
    return engine_of(spark, d).search_all(items(spark, d), "dense", rerank_hits=False, top_k=10).select("query_id", "doc_id", "rank", "score")


@query
def strategies_job(spark, d):
    """Evaluates four strategies through the engine, writes the metrics and reads them back."""
    path = fresh_path(spark, "metrics")
    jobs.evaluate_strategies(engine_of(spark, d), items(spark, d).join(written(relevant(spark, d), "relevant"), "query_id"), path)
    return spark.read.json(path)


@query
def mining_job(spark, d):
    """Mines training sets through the engine and reads the written pairs back."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("relevant_doc_id"), "embedding")
    engine = Engine(corpus(spark, d), doc_vectors(spark, d), lambda q: q.join(vectors, "relevant_doc_id", "left"), index=text_index(spark, d))
    path = fresh_path(spark, "mined")
    jobs.mine_training_sets(engine, written(targets(spark, d), "targets"), path)
    pairs = tables.read_pairs(spark, f"{path}/pairs")
    return pairs.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "label", "type", F.md5("doc_text").alias("text_md5"))


@query
def queries_roundtrip(spark, d):
    path = fresh_path(spark, "queries")
    tables.write_json(targets(spark, d).withColumn("relevant_doc_id", F.col("relevant_doc_id").cast("string")).withColumn("irrelevant_doc_id", F.col("irrelevant_doc_id").cast("string")), path)
    return tables.read_queries(spark, path)


@query
def corpus_job(spark, d):
    """Raw Parquet files with a column too many, in the order of doc_id, to a corpus of JSON lines."""
    raw, out = fresh_path(spark, "raw"), fresh_path(spark, "corpus")
    documents(spark, d).orderBy("doc_id").select(F.col("text").alias("abstract"), F.lit(1).alias("more"), F.col("text").alias("description")).write.parquet(raw)
    jobs.build_corpus(spark, raw, out, n=None)
    return tables.read_corpus(spark, out).select("doc_id", "category", "title", F.md5("summary").alias("summary_md5"))


@query
def first_rows(spark, d):
    """The scan with a row limit: the first 500 in an order."""
    return tables.ordered_head(table(spark, d, "documents").select("doc_id", "lang"), 500, "doc_id")


@query
def embed_job(spark, d):
    """Embeds the documents that the cache lacks; keys and vector sizes of the cache afterwards."""
    path = fresh_path(spark, "cache")
    tables.write_json(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "embedding"), path, "append")
    docs = corpus(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    jobs.embed_missing(docs, path, lambda rows: rows.withColumn("embedding", vx.stable_vector(tx.embed_text(F.col("title"), F.col("abstract")), 64)))
    return tables.read_cache(spark, path).select("doc_id", F.size("embedding").alias("size"))


@query
def embed_texts(spark, d):
    t, a = F.col("title"), F.col("abstract")
    return corpus(spark, d).select("doc_id", F.md5(tx.embed_text(t, a)).alias("embed_md5"), F.md5(tx.ingest_text(t, a)).alias("ingest_md5"), F.md5(tx.embed_text(t, a, 40)).alias("cut_md5"))


@query
def imperfect_queries(spark, d):
    hits = written(lexical(spark, d, CANDIDATES), "lexical")
    return evaluate.imperfect(per_query(spark, d, hits), hits).select("query_id", "relevant_doc_id", "rank", "top_doc_id")


@query
def evaluated_function(spark, d):
    """Metrics of a search function."""
    asked_of = items(spark, d).join(relevant(spark, d), "query_id")
    return evaluate.summary(evaluate.evaluate(lambda q, k: dense(spark, d, k), asked_of, CANDIDATES))


@query
def passage_deltas(spark, d):
    """How much better best passages are than whole documents."""
    runs = jobs.compare_passages(plain_segments(spark, d), items(spark, d).join(written(relevant(spark, d), "relevant"), "query_id"))
    return evaluate.deltas(written(runs, "runs"), "monolithic", "passage_maxp")


@query
def corpus_counts(spark, d):
    return documents(spark, d).select(tx.word_count(F.col("text")).alias("n")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_words"), F.round(F.avg("n"), 6).alias("words_per_doc"))


@query
def structures_from_answers(spark, d):
    """Stored answers of three kinds: JSON in code fences, unreadable, none."""
    docs = documents(spark, d).select("doc_id", "text", F.concat(F.lit("title "), F.col("doc_id").cast("string")).alias("title"))
    answer = F.to_json(F.struct(F.col("title").alias("problem_statement"), F.lit("core").alias("inventive_core"), F.array(F.lit("a"), F.lit("b")).alias("technical_elements"), F.lit("claims").alias("claim_summary")))
    kind = F.pmod("doc_id", F.lit(3))
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(kind == 1, F.lit("no answer"))
    return segment.structured(docs, docs.select("doc_id", raw.alias("raw")))


@query
def unix_texts(spark, d):
    """Texts with line ends of all three kinds."""
    mixed = F.concat(F.regexp_replace("text", "\n", "\r\n"), F.lit("\r"), F.col("text"))
    return documents(spark, d).select("doc_id", F.md5(tx.unix_lines(mixed)).alias("text_md5"))


@query
def saved_ranker(spark, d):
    """A fitted pair ranker, saved and loaded, against itself: pairs, and pairs of equal scores."""
    pairs = written(mined(spark, d)[0], "pairs")
    model = mine.fit_pair_ranker(pairs.filter("split = 'train'"), mine.pair_features)
    path = fresh_path(spark, "ranker")
    mine.save_model(model, path)
    rows = pairs.select("query_id", "doc_id", "type", *(c.alias(n) for n, c in mine.pair_features(F.col("query"), F.col("doc_text")).items()))
    one, other = (m.transform(rows).select("query_id", "doc_id", "type", F.col("probability").cast("string").alias(n)) for m, n in ((model, "p"), (mine.load_model(path), "q")))
    return one.join(other, ["query_id", "doc_id", "type"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("q")).alias("n_equal"))


@query
def ingest_log(spark, d):
    """The log of an ingest in which every tenth row lacks its key: rows by status, message and vector size."""
    landing, log = fresh_path(spark, "landing"), fresh_path(spark, "log")
    own = documents(spark, d).select(F.when(F.pmod("doc_id", F.lit(10)) != 3, F.col("doc_id").cast("string")).alias("doc_id"), F.lit("t").alias("title"), F.lit("an abstract").alias("abstract"), F.lit("").alias("summary"), "text")
    own.write.json(landing)
    stream = spark.readStream.schema(schemas.INGEST).json(landing).withColumn("seq", F.lit(0).cast("long"))
    ingest(stream, Table(spark, fresh_path(spark, "table")), log, fresh_path(spark, "checkpoint"), tables.first_wins).awaitTermination()
    return spark.read.parquet(log).groupBy("status", "error", "embedding_dim").agg(F.count(F.lit(1)).alias("n"))


@query
def split_sizes_by_hash(spark, d):
    """The stratified split in the order of a hash: sizes of its parts."""
    return mine.stratified(targets(spark, d)).groupBy("query_type", "split").agg(F.count(F.lit(1)).alias("n"))


_PASSAGES = o.SQL["monolithic_vs_maxp"]
_DENSE_MEANS = o.means(o.measured("den"))
SURFACE_SQL: dict[str, str] = {
    "persisted_index_top10": o.SQL["bm25_top10"],
    "search_hybrid_rerank": f"SELECT query_id, doc_id, rank, score FROM ({o.SQL['rerank_top10']})",
    "search_dense": o.SQL["cosine_top10"],
    "strategies_job": o.SQL["four_way_compare"],
    "mining_job": f"SELECT query_id, doc_id, label, type, text_md5 FROM ({o.SQL['hard_negative_pairs']})",
    "queries_roundtrip": f"SELECT query_id, query, relevant_doc_id::VARCHAR AS relevant_doc_id, irrelevant_doc_id::VARCHAR AS irrelevant_doc_id, query_type, relevant_title, irrelevant_title, verified FROM ({o.SQL['labelled_queries']})",
    "corpus_job": f"SELECT doc_id, 'G' AS category, title, summary_md5 FROM ({o.SQL['shape_corpus']})",
    "first_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 500",
    "embed_job": "SELECT doc_id, 64 AS size FROM (SELECT doc_id::VARCHAR AS doc_id FROM documents UNION SELECT vec_id::VARCHAR FROM embeddings)",
    "embed_texts": f"WITH {o.CORPUS} SELECT doc_id, md5(substr('Title: ' || title || chr(10) || 'Abstract: ' || abstract, 1, 8000)) AS embed_md5, md5(substr(CASE WHEN abstract <> '' THEN title || ' — ' || abstract ELSE title END, 1, 4000)) AS ingest_md5, md5(substr('Title: ' || title || chr(10) || 'Abstract: ' || abstract, 1, 40)) AS cut_md5 FROM corpus",
    "imperfect_queries": f"WITH {o.LEX}, {o.REL} SELECT m.query_id, relevant_doc_id, m.rank::INT AS rank, t.doc_id AS top_doc_id FROM {o.measured('lex')} m LEFT JOIN lex t ON t.query_id = m.query_id AND t.rank = 1 WHERE m.rank IS NULL OR m.rank > 1",
    "evaluated_function": f"WITH {o.DENSE}, {o.REL} {_DENSE_MEANS}",
    "passage_deltas": f"SELECT max(num_queries) AS num_queries, {', '.join(f"round(max({m}) FILTER (strategy = 'passage_maxp') - max({m}) FILTER (strategy = 'monolithic'), 9) AS {m}_delta" for m in evaluate.METRICS)} FROM ({_PASSAGES})",
    "corpus_counts": f"SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words, round(avg(n), 6) AS words_per_doc FROM (SELECT len({o.words("coalesce(text, '')")}) AS n FROM documents)",
    "structures_from_answers": "SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 3 WHEN 0 THEN 'title ' || doc_id WHEN 1 THEN 'Extraction error: unreadable answer' ELSE 'API client not initialized.' END AS problem_statement, CASE doc_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'title ' || doc_id ELSE 'Rule-based fallback representation.' END AS inventive_core, CASE doc_id % 3 WHEN 0 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS technical_elements, CASE doc_id % 3 WHEN 0 THEN 'claims' WHEN 1 THEN 'Fallback representation' ELSE 'Unstructured text.' END AS claim_summary, CASE doc_id % 3 WHEN 1 THEN 'unreadable answer' END AS error FROM documents",
    "unix_texts": "SELECT doc_id, md5(coalesce(text, '') || chr(10) || coalesce(text, '')) AS text_md5 FROM documents",
    "saved_ranker": f"SELECT count(*) AS n, count(*) AS n_equal FROM ({o.SQL['hard_negative_pairs']})",
    "ingest_log": "SELECT CASE WHEN doc_id % 10 = 3 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN doc_id % 10 = 3 THEN 'doc_id is missing' END AS error, 768 AS embedding_dim, count(*) AS n FROM documents GROUP BY ALL",
    "split_sizes_by_hash": o.SQL["stratified_split_sizes"],
}
