"""The folder that the driver and all executors see, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application under spark.checkpoint.dir; a temporary one, deleted at the end, only where that is unset on
    one machine."""
    app = spark.sparkContext.applicationId
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return f"{told.rstrip('/')}/{app}"
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="findling-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """df as a table in the shared folder, so that what follows reads it instead of computing it again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    (df.write.partitionBy(*partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
