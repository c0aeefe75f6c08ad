"""Questions to answers: route, enrich, add history, answer, clean."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.fixed_values import (
    AGENTS,
    BASE_SYSTEM,
    MAX_DISTANCE,
    PROMPT_HISTORY,
    TOP_K,
)
from passagework.functions.prompts import MESSAGE, TURN_TEMPLATE, chat_prompt, messages
from passagework.functions.text import cut_tokens, whitespace_token_count
from passagework.operators.agents import (
    answer_partitions,
    batch_answer,
    deal_by_agent,
    route_queries,
)
from passagework.operators.context import enrich_dealt
from passagework.operators.history import fit_history, prompt_history
from passagework.sources.turn_log import SESSION

ANSWER_COLUMNS = [
    "query_id",
    "query",
    "answer",
    "agent_used",
    "query_type",
    "rag_used",
    "rag_status",
    "rag_status_msg",
    "rag_warning",
    "retrieved_chunks",
    "error",
]

# What has the texts of passages, beside the prompt.
PASSAGE_COLUMNS = {"system_prompt", "context_block", "retrieved_chunks"}


def answer_queries(
    queries: DataFrame,
    index: DataFrame,
    models,
    turns: DataFrame | None = None,
    embedder=None,
    agents=AGENTS,
    override: str | None = None,
    k: int = TOP_K,
    max_distance: float = MAX_DISTANCE,
    history: int = PROMPT_HISTORY,
    budget: int | None = None,
    limit: int | None = None,
    order=None,
    template=TURN_TEMPLATE,
    keep=(),
    columns=ANSWER_COLUMNS,
    **search,
) -> DataFrame:
    """One answered row per question.

    ``queries`` has ``query_id, query`` and may have ``embedding``, ``conv_id``
    (whose newest messages from ``turns`` go into the prompt), an agent override
    column and an ``error`` of an earlier step, which keeps a row unanswered. Rows of
    ``retrieve`` are answered with the passages they have, without a search.
    ``budget`` limits the whole prompt by tokens: the oldest messages go until the
    rest fits beside the system prompt with its passages and the question. ``limit``
    then ends the prompt after so many tokens, whatever it holds. ``columns`` are the
    wanted ones of ``ANSWER_COLUMNS``: only these travel to the models beside the prompt
    (the id, the agent and the error always do).
    """
    in_conversation = "conv_id" in queries.columns
    # Where only the model wants the passages, they are put into the prompt beside it.
    unread = limit is None and not (in_conversation and turns is not None)
    unread = unread and not PASSAGE_COLUMNS & {*columns, *keep}
    marker = f"<{uuid.uuid4().hex}>" if unread else None
    if "system_prompt" in queries.columns:
        enriched, dealt = queries, False
    else:
        enriched, dealt = retrieve(
            queries, index, embedder, agents, override, k, max_distance, deal_by_agent,
            marker=marker, **search
        )
    if in_conversation:
        keep = ["conv_id", *[c for c in keep if c != "conv_id"]]
    if in_conversation and turns is not None:
        if budget is not None:
            turns = fit_history(turns, budget, order=order)
        past = prompt_history(turns, history, order=order)
        enriched, dealt = enriched.join(past, "conv_id", "left"), False
        if budget is not None:
            used = whitespace_token_count("system_prompt") + whitespace_token_count("user_prompt")
            fitting = F.filter("history", lambda m: m["tokens_to_end"] + used <= budget)
            plain = F.transform(fitting, lambda m: m.dropFields("tokens_to_end"))
            enriched = enriched.withColumn("history", plain)
    else:
        enriched = enriched.withColumn("history", F.lit(None).cast(f"array<{MESSAGE}>"))
    listed = messages(F.col("system_prompt"), "history", "user_prompt")
    prompt = chat_prompt(listed, template)
    asked = enriched.withColumn("prompt", prompt if limit is None else cut_tokens(prompt, limit))
    if "error" in queries.columns:
        asked = asked.withColumnRenamed("error", "_earlier")
    else:
        asked = asked.withColumn("_earlier", F.lit(None).cast("string"))
    wanted = {*columns, "query_id", "agent_used"} - {"answer", "error"}
    carried = [c for c in ANSWER_COLUMNS if c in wanted]
    placed = [c for c in ("_places", "_folder") if c in asked.columns]
    asked = asked.select(*carried, *keep, "prompt", "_earlier", *placed)
    if dealt:  # the prompts were made where they are answered
        answered = answer_partitions(asked, models, marker=marker if placed else None)
    else:
        answered = batch_answer(asked, models)
    failed = F.coalesce("_earlier", "error")
    return answered.select(
        *carried,
        *keep,
        F.when(failed.isNull(), F.col("answer")).alias("answer"),
        failed.alias("error"),
    )


def retrieve(
    queries: DataFrame,
    index: DataFrame,
    embedder=None,
    agents=AGENTS,
    override: str | None = None,
    k: int = TOP_K,
    max_distance: float = MAX_DISTANCE,
    deal=None,
    dim: int | None = None,
    base_system: str = BASE_SYSTEM,
    marker: str | None = None,
    **search,
) -> tuple[DataFrame, bool]:
    """Questions routed and enriched, and whether their rows lie as ``deal`` puts them."""
    routed = route_queries(queries, agents, override)
    return enrich_dealt(
        routed, index, embedder, k, max_distance, base_system, dim, deal, marker, **search
    )


def new_turns(answers: DataFrame, ts=None) -> DataFrame:
    """The two messages each answered question adds to its conversation's log.

    All share ``ts``, the time of the batch; ``turn`` orders them by the
    (numeric) ``query_id`` and puts the question before its answer, so a log
    made of batches is ordered by ``ts, turn``.
    """
    ts = F.current_timestamp() if ts is None else ts
    conv = F.col("conv_id") if "conv_id" in answers.columns else F.lit(SESSION)
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    messages_of = answers.where(F.col("answer").isNotNull()).select(
        conv.cast("string").alias("conv_id"), "query_id", F.posexplode(pair).alias("i", "m")
    )
    turn = F.col("query_id").cast("bigint") * 2 + F.col("i")
    return messages_of.select("conv_id", turn.alias("turn"), "m.role", "m.content", ts.alias("ts"))
