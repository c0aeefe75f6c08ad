"""The newest messages of every conversation as a view that is never behind its stream.

Each conversation keeps a list of at most ``n`` messages as state; new ones are merged
in, the oldest fall out, and a conversation that has been silent for a while is
forgotten. Whatever changed in a micro-batch is written as one folder of the view, in
place of what that batch had written before a failure; readers take the newest folder
that knows a conversation, so a prompt is built without ranking the whole log.

The messages of a conversation that arrive in one batch pass one task as a stream, which
holds ``n`` of them however many come.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from passagework.functions.fixed_values import PROMPT_HISTORY

MESSAGES = "turn bigint, role string, content string"
CHANGED = f"conv_id string, {MESSAGES}"
VIEW = f"{CHANGED}, batch bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestMessages(StatefulProcessor):
    """A list of the newest messages by turn, oldest first; of equal turns the last to come."""

    def __init__(self, n: int, forget_after_ms: int | None):
        self.n, self.forget_after_ms = n, forget_after_ms

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", MESSAGES, ttlDurationMs=self.forget_after_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        newest = [(turn, i, role, content) for i, (turn, role, content) in enumerate(self.kept.get())]
        place = len(newest)
        for frame in rows:
            for turn, role, content in zip(frame["turn"], frame["role"], frame["content"]):
                entry = (int(turn), place, role, content)
                place += 1
                if len(newest) < self.n:
                    heapq.heappush(newest, entry)
                else:
                    heapq.heappushpop(newest, entry)
        messages = [(turn, role, content) for turn, _, role, content in sorted(newest)]
        self.kept.put(messages)
        yield pd.DataFrame(
            [(key[0], *m) for m in messages], columns=["conv_id", "turn", "role", "content"]
        )

    def close(self) -> None:
        pass


def stream_history(
    turns: DataFrame,
    view: str,
    checkpoint: str,
    n: int = PROMPT_HISTORY,
    forget_after_ms: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Keeps the newest ``n`` messages of a stream (conv_id, turn, role, content) in ``view``.

    Messages without a conversation or a turn are left out. With ``forget_after_ms`` a
    conversation that has no message for so long starts anew.
    """
    spark = turns.sparkSession
    said = turns.where("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"),
    )
    changed = said.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=NewestMessages(n, forget_after_ms),
        outputStructType=CHANGED,
        outputMode="Update",
        timeMode="None" if forget_after_ms is None else "ProcessingTime",
    )

    def publish(batch: DataFrame, number: int) -> None:
        folder = f"{view.rstrip('/')}/batch-{number:012d}"
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(folder)

    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            changed.writeStream.foreachBatch(publish)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def live_history(spark: SparkSession, view: str) -> DataFrame:
    """conv_id, pos (from 0, oldest first), turn, role, content of the newest messages."""
    rows = spark.read.schema(VIEW).option("recursiveFileLookup", "true").parquet(view)
    newest = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    in_turn = Window.partitionBy("conv_id").orderBy("turn")
    return rows.join(newest, ["conv_id", "batch"]).select(
        "conv_id", (F.row_number().over(in_turn) - 1).alias("pos"), "turn", "role", "content"
    )
