"""Shared pieces: the folder all executors see, staged tables, packed integer lists, word iteration."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold over one in HOT of all rows, of which there are fewer than HOT, and over TASK rows, which are no load for
#: one task, are joined by broadcast.
HOT, TASK = 10_000, 1 << 20
_own_dirs: dict[str, str] = {}
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only where that is unset (tests, one machine)."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="findling-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables staged inside when the block ends, but those staged with last=True: they go with the block around it,
    if there is one."""
    own: list[str] = []
    token = _passing.set((*_passing.get(), own))
    try:
        yield
    finally:
        _passing.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in own:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def staged(df: DataFrame, name: str, last: bool = False) -> DataFrame:
    """Writes df to the shared folder and returns the written table, so that no lineage is left."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    blocks = _passing.get()
    for own in blocks[-2:-1] if last else blocks[-1:]:
        own.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled(rows: DataFrame, labels: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with labels (key, a label, n_rows), in which n_rows is at least the number of rows that have the key and
    adds up to `total` at most. The rows of a hot key stay where they are, so that they never meet in one task."""
    label, hot = labels.columns[1], (F.col("n_rows") * HOT > total) & (F.col("n_rows") > TASK)
    if total <= TASK:  # none is hot
        return rows.join(labels.select(key, label), key)
    few = labels.filter(hot).select(key, F.struct(label).alias("_hot"))
    marked = rows.join(F.broadcast(few), key, "left")
    rest = marked.filter("_hot is null").drop("_hot").join(labels.filter(~hot).select(key, label), key)
    return marked.filter("_hot is not null").select(*rows.columns, F.col(f"_hot.{label}").alias(label)).unionByName(rest)


def free_name(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores after it as make it a new one."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_bytes(column: str = "text", empty_for_null: bool = True):
    """UTF-8 bytes of a text column."""
    c = F.col(column).cast("string")
    return F.encode(F.coalesce(c, F.lit("")) if empty_for_null else c, "UTF-8")


def volume(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a table: one aggregate row reaches the driver."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0))).first()
    return int(n), int(size)


def spans(data: bytes, size: int = 1 << 20):
    """Slices of about `size` bytes, cut only at ASCII white space, so that no word is split."""
    start, n = 0, len(data)
    while start < n:
        end = start + size
        if end >= n:
            end = n
        else:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        yield data[start:end]
        start = end


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as zstandard-compressed byte planes of their differences."""
    step = values.copy()
    step[1:] -= values[:-1]
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the one of SplitMix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))
