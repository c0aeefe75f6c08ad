"""The chunk index: one Parquet table, partitioned by embedding model."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from passagework.operators.chunking import METADATA

INDEX_SCHEMA = (
    "chunk_id string, doc_id string, chunk_no int, text string, "
    f"metadata {METADATA}, embedding array<float>, model_name string"
)

MAX_BROADCAST_IDS = 1_000_000


def empty_index(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def load_index(spark: SparkSession, path: str, model_name: str | None = None) -> DataFrame:
    """The stored index, or an empty one where nothing has been stored.

    Vectors of different models do not compare: name the model when the folder
    may hold several, and only its files are read.
    """
    try:
        index = spark.read.schema(INDEX_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        index = empty_index(spark)
    return index if model_name is None else index.where(F.col("model_name") == model_name)


def append_index(rows: DataFrame, path: str, skip_existing: bool = False) -> int:
    """Append index rows and return how many; the commit is all or nothing.

    A plain append shuffles nothing. ``skip_existing`` makes a repeated append
    add nothing: chunk ids come from content, so rows already stored are found
    by id and left out, as are repeats among the new rows.
    """
    if skip_existing:
        rows = _only_new(rows, load_index(rows.sparkSession, path))
    written = Observation("append_index")
    observed = _conform(rows).observe(written, F.count(F.lit(1)).alias("n"))
    observed.write.mode("append").partitionBy("model_name").parquet(path)
    return written.get["n"]


def write_batch(rows: DataFrame, path: str, model_name: str, name: str) -> None:
    """Rows of one model in a folder of their own, in place of what it held.

    Repeats among the rows are left out. The folder lies below the model's, where
    readers find it like any other file of the index.
    """
    own = without_repeats(_conform(rows), ["chunk_id"]).drop("model_name")
    own.write.mode("overwrite").parquet(f"{path.rstrip('/')}/model_name={model_name}/{name}")


def _only_new(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose id is not stored.

    A batch of few ids is broadcast to the stored ids, so these are scanned but
    not shuffled, and at most as many come back. A larger batch is joined.
    """
    key = ["model_name", "chunk_id"]
    ids, present = rows.select(key), stored.select(key)
    if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        present = F.broadcast(present.join(F.broadcast(ids), key, "left_semi").distinct())
    return without_repeats(rows.join(present, key, "left_anti"), key)


def without_repeats(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, as ``dropDuplicates`` gives; rows are moved only if some repeat.

    Ids alone are counted first, so that texts and vectors stay where they are.
    """
    repeats = rows.select(key).groupBy(key).count().where("count > 1")
    return rows if repeats.isEmpty() else rows.dropDuplicates(key)


def _conform(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], INDEX_SCHEMA).unionByName(rows)


def clear_index(spark: SparkSession, path: str) -> None:
    """Replace the stored index by an empty one.

    Overwriting by dynamic partitions would keep the old files, so the mode is
    fixed for this write.
    """
    empty_index(spark).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("model_name").parquet(path)


def index_status(index: DataFrame) -> DataFrame:
    """Number of chunks per embedding model."""
    return index.groupBy("model_name").agg(F.count("*").alias("n_chunks"))


def ingest_summary(added: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks added and the size of the index after it, in one row."""
    sides = added.select(F.lit(True).alias("new")).unionAll(
        index.select(F.lit(False).alias("new"))
    )
    return sides.agg(
        F.count_if("new").alias("chunks_added"), F.count_if(~F.col("new")).alias("total_chunks")
    )
