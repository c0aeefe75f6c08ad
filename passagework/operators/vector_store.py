"""Vectors kept by content: a text that was embedded once is never embedded again.

The store is one Parquet table of (key, embedding), partitioned by model; the key is a
hash of the text. New rows are first cut down to their different texts, those are joined
to the stored keys, and only what is left goes through the model. The vectors then come
back to all rows by key, so neither an unchanged document nor a line that a third of all
documents have costs a second call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.sources.files import is_complete, names


def stored_vectors(spark: SparkSession, path: str, model_name: str) -> DataFrame:
    """key and embedding of what the store has of a model; the same key comes once."""
    folder = f"{path.rstrip('/')}/model={model_name}"
    parts = [f"{folder}/{name}" for name in names(spark, folder)]
    whole = [part for part in parts if is_complete(spark, part)]
    schema = "key string, embedding array<float>"
    if not whole:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*whole).dropDuplicates(["key"])


def embed_once(
    df: DataFrame, embedder, path: str, text: str = "text", out: str = "embedding"
) -> DataFrame:
    """``df`` with the vectors of a text column, ``model_name`` beside them.

    Texts that the store does not have are embedded and added to it; an addition is there
    in full or not at all, and a text that two runs add at once counts once. Null texts
    have no vector. The vectors of one model never meet those of another.
    """
    spark = df.sparkSession
    key = F.sha2(F.col(text), 256)
    different = (
        df.where(F.col(text).isNotNull())
        .select(key.alias("key"), F.col(text).alias("text"))
        .dropDuplicates(["key"])
    )
    known = stored_vectors(spark, path, embedder.name).select("key")
    fresh = different.join(known, "key", "left_anti")
    part = f"{path.rstrip('/')}/model={embedder.name}/{uuid.uuid4().hex}"
    fresh.select("key", embedder.vector("text").alias("embedding")).write.parquet(part)
    vectors = stored_vectors(spark, path, embedder.name).select(
        F.col("key").alias("_key"), F.col("embedding").alias(out)
    )
    joined = df.drop(out).join(vectors, key == F.col("_key"), "left").drop("_key")
    return joined.withColumn("model_name", F.lit(embedder.name))
