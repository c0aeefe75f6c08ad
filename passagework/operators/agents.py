"""Routing questions to agents and answering them in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.fixed_values import AGENTS, DEFAULT_AGENT, ROUTES
from passagework.functions.routing import route
from passagework.functions.text import strip_think
from passagework.sources.text_store import TextReader, bytes_of

PROMPT_BYTES = 16 << 20  # of the prompts that a worker takes out of a batch at a time


def agents_table(spark: SparkSession, agents=AGENTS) -> DataFrame:
    return spark.createDataFrame(
        agents, "name string, rank int, description string, available boolean"
    )


def route_queries(
    queries: DataFrame,
    agents=AGENTS,
    override: str | None = None,
    rules=ROUTES,
    default: str = DEFAULT_AGENT,
    query: str = "query",
) -> DataFrame:
    """Add ``query_type`` (override or rule) and ``agent_used``.

    An agent that is not available is replaced by the default one. The agents
    are a handful of names and go in as a literal list, so there is no join.
    """
    asked = route(query, rules, default)
    if override is not None:
        asked = F.coalesce(F.nullif(F.col(override), F.lit("")), asked)
    available = [name for name, _, _, ready in agents if ready]
    return queries.withColumn("query_type", asked).withColumn(
        "agent_used",
        F.when(F.col("query_type").isin(available), F.col("query_type")).otherwise(default),
    )


def routing_counts(results: DataFrame, by=(), agent: str = "agent_used") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return results.groupBy(*by, agent).agg(F.count("*").alias("n_queries"))


def routing_map(results: DataFrame, by=(), agent: str = "agent_used") -> DataFrame:
    """Counts per agent as one map per group; a group has as many entries as agents."""
    by = [by] if isinstance(by, str) else list(by)
    counts = routing_counts(results, by, agent)
    entry = F.struct(agent, "n_queries")
    return counts.groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("routing")
    )


def batch_answer(
    queries: DataFrame,
    models: Mapping[str, Callable[[], Callable[[list[str]], list[str]]]],
    prompt: str = "prompt",
    query_id: str = "query_id",
    tasks: int | None = None,
    clean: bool = True,
) -> DataFrame:
    """Add ``answer`` and ``error``; one failing row does not stop the others.

    ``models`` maps an agent to a factory, which loads the model and returns a
    function from prompts to answers. Rows are ranged by agent and a hash of the
    id: a task sees one agent, rarely two, and loads a model once instead of
    swapping for every row, and an agent with most rows fills most tasks. The
    number of ``tasks`` is fixed, as partitions that are small in bytes but long
    to answer must not be merged. Columns other than the prompt pass through as
    they are, without becoming Python objects.
    """
    dealt = deal_by_agent(queries, query_id, tasks)
    return answer_partitions(dealt, models, prompt, clean)


def deal_by_agent(
    queries: DataFrame, query_id: str = "query_id", tasks: int | None = None
) -> DataFrame:
    """Rows ranged by agent and a hash of the id, those of an agent together in a task."""
    spark = queries.sparkSession
    if tasks is None:
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(spark.sparkContext.defaultParallelism, shuffle)
    return (
        queries.withColumn("_salt", F.xxhash64(query_id))
        .repartitionByRange(tasks, "agent_used", "_salt")
        .sortWithinPartitions("agent_used")
        .drop("_salt")
    )


def answer_partitions(
    queries: DataFrame, models: Mapping, prompt: str = "prompt", clean: bool = True,
    marker: str | None = None,
) -> DataFrame:
    """Add ``answer`` and ``error`` to rows as they are dealt; a task loads a model when
    the agent changes. A ``marker`` in a prompt stands for the text at the next of the row's
    ``_places`` in ``_folder``: texts are read, and forgotten, a slice of the rows at a time."""
    fields = list(queries.schema.fields)
    schema = T.StructType(
        fields + [T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())]
    )
    factories = dict(models)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, failure, loaded, reader = None, None, [], None
        for batch in (part for whole in batches for part in _parts(whole, prompt, marker)):
            prompts, answers, errors = batch[prompt].to_pylist(), [], []
            if marker is not None and prompts:
                reader = reader or TextReader(batch["_folder"][0].as_py())
                texts = reader.texts(batch["_places"]).to_pylist()
                prompts = [_filled(p, marker, t) for p, t in zip(prompts, texts)]
            for agent, rows in _runs(batch["agent_used"].to_pylist()):
                if loaded != [agent]:
                    model, failure, loaded = None, None, [agent]
                    try:
                        model = factories[agent]()
                    except Exception as problem:
                        failure = f"{type(problem).__name__}: {problem}"
                for reply, error in _answered(prompts[rows], model, failure):
                    answers.append(reply)
                    errors.append(error)
            added = [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], [*batch.schema.names, "answer", "error"]
            )
        if reader is not None:
            reader.close()

    answered = queries.mapInArrow(answer, schema)
    return answered.withColumn("answer", strip_think("answer")) if clean else answered


def _parts(batch: pa.RecordBatch, prompt: str, marker: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some ``PROMPT_BYTES`` of prompts each: long prompts are not all
    there as Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch[prompt]), 0).to_numpy().astype(np.int64)
    if marker is not None:
        sizes += bytes_of(batch["_places"])
    part = (np.cumsum(sizes) - sizes) // PROMPT_BYTES
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _filled(prompt: str | None, marker: str, texts: list[str]) -> str | None:
    if prompt is None:
        return None
    pieces = prompt.split(marker)
    if len(pieces) != len(texts) + 1:
        raise ValueError(f"{len(texts)} passages for {len(pieces) - 1} places in a prompt")
    return "".join(x for pair in zip(pieces, [*texts, ""]) for x in pair)


def _runs(values: list) -> Iterator[tuple[object, slice]]:
    """Neighbouring equal values and where they are."""
    start = 0
    for value, group in groupby(values):
        stop = start + sum(1 for _ in group)
        yield value, slice(start, stop)
        start = stop


def _answered(prompts: list, model, failure: str | None) -> list[tuple]:
    """Answer and error per prompt; a missing prompt is not put to the model."""
    texts = [text for text in prompts if text is not None]
    replies = iter([(None, failure)] * len(texts) if model is None else _ask(model, texts))
    return [(None, "no prompt") if text is None else next(replies) for text in prompts]


def _ask(model, texts: list[str]) -> list[tuple]:
    """Ask for the whole batch; on failure find the rows at fault."""
    try:
        replies = model(texts) if texts else []
        if len(replies) != len(texts):
            raise ValueError("the model returned another number of answers")
        return [(reply, None) for reply in replies]
    except Exception:
        return [_ask_one(model, text) for text in texts]


def _ask_one(model, text: str) -> tuple:
    try:
        return model([text])[0], None
    except Exception as problem:
        return None, f"{type(problem).__name__}: {problem}"
