"""Conversation messages appended to the log as they come."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from passagework.sources.turn_log import TURN_SCHEMA


def turn_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON-lines files of messages."""
    return spark.readStream.schema(TURN_SCHEMA).json(path)


def stream_turns(turns: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of messages to a log; newest-N views read the log.

    Keeping the newest messages as stream state would hold every conversation
    in memory; the log is small to rank when a prompt is built. A batch has a
    folder of its own in the log, named after the checkpoint and its number: run
    again after a failure it replaces what it had written. Other appends and a
    reset may come in between.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path.rstrip('/')}/stream-{stream}-{number:012d}")

    return (
        turns.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
