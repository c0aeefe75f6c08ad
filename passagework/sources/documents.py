"""Text files and named dataset splits as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.operators.chunking import METADATA

TEXT_FILES = "*.{txt,md}"


def decode_text(content: Column) -> Column:
    """Bytes to text; bytes that are no UTF-8 are dropped.

    Valid content, the usual case, is decoded without leaving the JVM.
    """


    @F.pandas_udf("string")
    def decode_dropping(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    valid = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(
        F.when(valid, content.cast("string")), decode_dropping(F.when(~valid, content))
    )


def read_documents(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    pattern: str = TEXT_FILES,
    source: str | None = None,
    ticker: str | None = None,
) -> DataFrame:
    """One document per text file: ``doc_id, text, metadata``.

    ``path`` is a file or a folder. The source is the file's path unless given,
    the date the file's modification date.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    metadata = F.struct(
        F.lit(source).alias("source") if source else F.col("path").alias("source"),
        F.lit(ticker).cast("string").alias("ticker"),
        F.date_format("modificationTime", "yyyy-MM-dd").alias("date"),
    )
    return files.select(
        F.md5("path").alias("doc_id"),
        decode_text(F.col("content")).alias("text"),
        metadata.cast(METADATA).alias("metadata"),
    )


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a dataset stored by split; other splits' files are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a dataset (with its ``split`` column) one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)
