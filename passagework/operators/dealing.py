"""Answering with tasks of equal cost, every different prompt once.

What a prompt costs a model follows its length, and lengths are skewed: tasks with as
many prompts each can differ in work by any factor. Here prompts are sent to buckets by
a hash, the costs of the buckets are summed up (a table of a fixed number of rows), and
buckets are cut into runs of the same cost: one run is one task. Equal prompts for one
agent are asked once and the answer goes to everyone who asked.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.functions.text import whitespace_token_count
from passagework.operators.agents import answer_partitions
from passagework.session import written

BUCKETS = 1 << 14


def dealt_by_cost(
    prompts: DataFrame, tasks: int, cost: str = "cost", agent: str = "agent_used", key: str = "key"
) -> DataFrame:
    """``prompts`` in ``tasks`` partitions of about the same cost, one agent after another.

    A task holds whole buckets, so it is off by one bucket's cost at most; a prompt that
    alone costs more than a task should is a task of its own as far as its bucket allows.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    sums = (
        prompts.groupBy(F.col(agent).alias("_agent"), bucket.alias("_bucket"))
        .agg(F.sum(cost).alias("cost"))
        .toArrow()  # agents x BUCKETS rows at most
        .sort_by([("_agent", "ascending"), ("_bucket", "ascending")])
    )
    costs = np.array(sums.column("cost").to_pylist(), dtype=np.float64)
    middle = np.cumsum(costs) - costs / 2
    task = np.minimum((middle * tasks / max(costs.sum(), 1e-9)).astype(int), tasks - 1)
    rows = list(zip(sums.column("_agent").to_pylist(), sums.column("_bucket").to_pylist(), task.tolist()))
    spark = prompts.sparkSession
    places = spark.createDataFrame(rows, "_agent string, _bucket int, _task int")
    dealt = prompts.withColumn("_bucket_of", bucket).join(
        F.broadcast(places),
        F.col(agent).eqNullSafe(F.col("_agent")) & (F.col("_bucket_of") == F.col("_bucket")),
    )
    return (
        dealt.repartitionById(tasks, "_task")
        .sortWithinPartitions(agent)
        .drop("_agent", "_bucket", "_bucket_of", "_task")
    )


def answer_by_cost(
    queries: DataFrame,
    models,
    prompt: str = "prompt",
    cost: Column | None = None,
    tasks: int | None = None,
    clean: bool = True,
) -> DataFrame:
    """``queries`` with ``answer`` and ``error``, like ``batch_answer``.

    ``cost`` predicts what a prompt costs; its tokens and one more by default. Rows
    without a prompt get the error ``no prompt`` and cost nothing.
    """
    spark = queries.sparkSession
    if tasks is None:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(spark.sparkContext.defaultParallelism, shuffle)
    if cost is None:
        cost = whitespace_token_count(prompt) + 1
    key = F.xxhash64("agent_used", prompt)
    different = written(
        queries.where(F.col(prompt).isNotNull())
        .select("agent_used", F.col(prompt).alias("prompt"), key.alias("key"), cost.alias("cost"))
        .dropDuplicates(["agent_used", "prompt"]),
        "prompts",
    )
    dealt = dealt_by_cost(different, tasks)
    answered = written(
        answer_partitions(dealt, models, "prompt", clean).select(
            F.col("key").alias("_key"), F.col("agent_used").alias("_agent"),
            F.col("prompt").alias("_prompt"), "answer", "error",
        ),
        "answered",
    )
    # The key finds the row, the prompt itself decides.
    same = (
        (key == F.col("_key"))
        & F.col("agent_used").eqNullSafe(F.col("_agent"))
        & (F.col(prompt) == F.col("_prompt"))
    )
    joined = queries.join(answered, same, "left").drop("_key", "_agent", "_prompt")
    no_prompt = F.when(F.col(prompt).isNull(), "no prompt")
    return joined.withColumn("error", F.coalesce(no_prompt, "error"))
