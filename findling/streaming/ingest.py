"""Streaming ingest: documents are checked, segmented, embedded and merged into tables, one micro-batch at a time.

A batch that is repeated after a failure leaves the same tables: merges are by doc_id, each batch writes a new version of a
table in a folder of its own, and the version file is replaced last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from findling.functions import text as tx
from findling.functions.vectors import stable_vector
from findling.operators.segment import segmented
from findling.sources.shared import delete
from findling.sources.tables import latest

VECTOR_SIZE = 768


def embed(docs: DataFrame, size: int = VECTOR_SIZE) -> DataFrame:
    return docs.withColumn("embedding", stable_vector(F.col("doc_id").cast("string"), size))


def process(docs: DataFrame, encode: Callable[[DataFrame], DataFrame] = embed) -> DataFrame:
    """Result rows of docs(doc_id, title, abstract, summary, text): status, embedding and segment counts. Rows without doc_id
    fail with a message."""
    text = F.coalesce(F.when(tx.strip(tx.present(F.col("text"))) != "", F.col("text")), F.concat_ws("\n\n", *(F.when(tx.present(F.col(c)) != "", F.col(c)) for c in ("title", "abstract", "summary"))))
    good = F.coalesce(tx.strip(F.col("doc_id").cast("string")) != "", F.lit(False))
    ready = docs.withColumn("full_text", text).withColumn("status", F.when(good, "SUCCESS").otherwise("FAILED")).withColumn("error", F.when(~good, "doc_id is missing"))
    return encode(segmented(ready)).withColumn("embedding_dim", F.size("embedding"))


class Table:
    """Versioned Parquet table in a shared folder: merge(new rows) writes a version and then points to it."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id") -> None:
        self.spark, self.path, self.key = spark, path, key

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The highest version that is marked complete."""
        jvm, store = self._fs()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not store.exists(at):
            return None
        names = [x.getPath().getName() for x in store.listStatus(at)]
        whole = [int(n[2:]) for n in names if n.startswith("v=") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return max(whole, default=None)

    def read(self) -> DataFrame | None:
        v = self.version()
        return None if v is None else self.spark.read.parquet(f"{self.path}/v={v}")

    def merge(self, new: DataFrame, batch_id: int, policy: Callable[[DataFrame, DataFrame, str], DataFrame]) -> None:
        """Batch b makes version b + 1 from version b, so that a repeated batch starts from the same rows."""
        v = self.version()
        while v is not None and v > batch_id:
            v -= 1
        old = None if v is None or v < 0 else self.spark.read.parquet(f"{self.path}/v={v}")
        out = new if old is None else policy(old, new, self.key)
        out.write.mode("overwrite").parquet(f"{self.path}/v={batch_id + 1}")


def ingest_batch(rows: DataFrame, batch_id: int, table: Table, log_path: str, rows_path: str, policy: Callable[[DataFrame, DataFrame, str], DataFrame], columns: tuple[str, ...] = ("doc_id", "title", "embedding"), order: str = "seq", encode: Callable[[DataFrame], DataFrame] = embed) -> None:
    """One batch: rows are processed once, into a table of their own, from which the merge and the log read. Rows without doc_id
    are logged as failed, each for itself."""
    spark, at = rows.sparkSession, f"{rows_path}/batch={batch_id}"
    named = F.coalesce(tx.strip(F.col("doc_id").cast("string")) != "", F.lit(False))
    process(latest(rows.filter(named), "doc_id", order).unionByName(rows.filter(~named)), encode).write.mode("overwrite").parquet(at)
    done = spark.read.parquet(at)
    table.merge(done.filter("status = 'SUCCESS'").select(*columns), batch_id, policy)
    done.select("doc_id", "status", "error", "title", "embedding_dim", "stats", F.current_timestamp().alias("completed_at")).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
    delete(spark, at)


def ingest(stream: DataFrame, table: Table, log_path: str, checkpoint: str, policy: Callable[[DataFrame, DataFrame, str], DataFrame], columns: tuple[str, ...] = ("doc_id", "title", "embedding"), order: str = "seq", encode: Callable[[DataFrame], DataFrame] = embed) -> StreamingQuery:
    """Runs over what is there and stops. Of rows with one doc_id in a batch, the last in `order` holds. The log has a row for
    each document and batch, and one for each row without doc_id."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        ingest_batch(rows, batch_id, table, log_path, f"{checkpoint}/rows", policy, columns, order, encode)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by type, with late rows accepted for `lateness`; for streams and batches alike."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
