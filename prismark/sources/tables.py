"""Tables written once and read by several consumers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_cleared: set[str] = set()


def _clear(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # else the session was stopped, and its file systems with it
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the folder that the cluster names in spark.checkpoint.dir (in local mode, one of our own where that is unset).

    What reads it doesn't compute df again, and a lost executor costs no earlier stage. Tables go when the driver ends."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="prismark-")
        base = _own[app]
    folder = f"{base.rstrip('/')}/{app}"
    if folder not in _cleared:
        _cleared.add(folder)
        atexit.register(_clear, spark, folder)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
