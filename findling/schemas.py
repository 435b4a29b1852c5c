"""Schemas of the engine's tables. Missing text is the empty string; a missing rank means "not retrieved"."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "category", "category_name", "title", "abstract", "summary", "search_text")])
RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("abstract", "description")])
LABELLED_QUERY = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("query_id", "query", "relevant_doc_id", "irrelevant_doc_id", "query_type", "relevant_title", "irrelevant_title")]
    + [T.StructField("verified", T.BooleanType())]
)
DOC_EMBEDDING = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
QUERY_EMBEDDING = T.StructType([T.StructField("query", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
STRUCTURE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("doc_id", "problem_statement", "inventive_core")]
    + [T.StructField("technical_elements", T.ArrayType(T.StringType())), T.StructField("claim_summary", T.StringType()), T.StructField("error", T.StringType())]
)
TRAIN_PAIR = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("query_id", "query", "doc_id", "doc_text")]
    + [T.StructField("label", T.DoubleType()), T.StructField("type", T.StringType()), T.StructField("query_type", T.StringType())]
)
INGEST = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "title", "abstract", "summary", "text")])
