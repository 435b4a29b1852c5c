"""Readers and writers. All take schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from findling import schemas
from findling.functions import text as tx


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Abstract and description alone, whatever else the Parquet files hold, and _at, a row's place (file and row in it)."""
    return spark.read.parquet(path).select("abstract", "description", F.struct("_metadata.file_path", "_metadata.row_index").alias("_at"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of documents; missing fields become empty. Blank lines are no rows."""
    rows = spark.read.schema(schemas.DOCUMENT).json(path)
    return rows.select(*(tx.present(F.col(c)).alias(c) for c in rows.columns))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELLED_QUERY).json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAIN_PAIR).json(path)


def latest(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row of each key. One pass, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    o = F.col(order) if isinstance(order, str) else order
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), o).alias("_last"))
    return best.select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def read_cache(spark: SparkSession, path: str, schema=schemas.DOC_EMBEDDING, key: str = "doc_id") -> DataFrame:
    """A cache that only grows: of rows with one key, the last written holds (later file, then later row)."""
    rows = spark.read.schema(schema).json(path)
    names = rows.columns
    order = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return latest(rows.filter(F.col(key).isNotNull()).select(*names, order.alias("_order")), key, "_order").select(*names)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite", *partition: str) -> None:
    """JSON lines in UTF-8, non-ASCII characters as they are; mode `append` adds to a cache."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).json(path)


def first_wins(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of the table, and new rows of keys that it lacks (of equal new keys, one)."""
    fresh = new.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(fresh)


def last_wins(table: DataFrame, new: DataFrame, key: str = "doc_id", updated: tuple[str, ...] = ("title", "embedding")) -> DataFrame:
    """Insert, or update the named columns of keys that are there; other columns keep their values. `new` has one row a key."""
    other = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key), F.lit(True).alias("_is_new"))
    old = table.withColumn("_is_old", F.lit(True))
    joined = old.join(other, key, "full_outer")
    columns = [F.col(key)]
    for c in table.columns:
        if c == key:
            continue
        fresh = F.col(f"_new_{c}") if c in new.columns else F.lit(None).cast(table.schema[c].dataType)
        columns.append((F.when(F.col("_is_new"), fresh) if c in updated else F.when(F.col("_is_old").isNull(), fresh)).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)


def missing(keys: DataFrame, table: DataFrame, key: str = "doc_id") -> DataFrame:
    return keys.join(table.select(key), key, "left_anti")


def ordered_head(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order; a bounded heap in each task, then one merge."""
    return rows.orderBy(*order).limit(n)


def shape_corpus(raw: DataFrame, order: Column, least: int = 100, n: int | None = None) -> DataFrame:
    """Raw (abstract, description) to documents: abstracts longer than `least`, numbered in the order, the first n if given."""
    kept = raw.filter(F.length("abstract") > least)
    if n is not None:
        kept = kept.orderBy(order).limit(n)
    abstract = kept.withColumn("abstract", tx.clean(F.col("abstract"))).withColumn("description", tx.clean(F.col("description")))
    named = abstract.withColumn("title", tx.title_of(F.col("abstract"))).withColumn("summary", tx.summary_of(F.col("description")))
    from findling.operators.mine import positions

    placed = positions(named.withColumn("_order", order), "_order")
    return placed.select(F.format_string("US-G-%06d", F.col("pos") + 1).alias("doc_id"), F.lit("G").alias("category"), F.lit("Physics, Computing & Information Technology").alias("category_name"), "title", "abstract", "summary", tx.search_text(F.col("title"), F.col("abstract"), F.col("summary")).alias("search_text"))


def report(summary: DataFrame, title: str) -> str:
    """Markdown table of a summary of a few rows."""
    rows = summary.collect()
    names = summary.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def numbered(rows: DataFrame, *by: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(order)))
