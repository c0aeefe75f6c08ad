"""Pieces that several of the operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.session import shared_folder

MAX_BROADCAST_ROWS = 500_000
SLICE_ROWS = 256
# The white space of the contracts: space, tab to carriage return.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, **options) -> DataFrame:
    """``df`` written to the shared folder, with options of the writer, and read back.

    Cuts the lineage, so that a lost executor never recomputes what lies before,
    and fixes values that depend on the task that made them.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A stored table of short keys, marked for a broadcast if its count allows it.

    Beyond ``max_rows`` the frame comes back as it is, and the join shuffles.
    """
    return F.broadcast(keys) if keys.count() <= max_rows else keys


def worker_state(key, build: Callable):
    """A value made once per Python worker and kept for its later tasks."""
    states = sys.__dict__.setdefault("_passagework_states", {})
    if key not in states:
        states[key] = build()
    return states[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case of letters."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        free.append(name)
    return free
