"""Session settings for local runs, and the shared folder of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "passagework", **conf) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    if cores == "*":
        partitions = os.cpu_count() or 8
    else:
        partitions = int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="passagework-")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shared_files(folder: str):
    """The file system of a shared folder, for tasks that read and write files of their own,
    and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table of the shared folder: made once, however often it is read."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Enough partitions for a costly narrow step on a scan.

    A large input arrives in more partitions than there are cores and is left
    as it is. A small one, or one file that does not split, is redistributed.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *key)
