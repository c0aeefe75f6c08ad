"""Conversations answered in turn: a question sees the answers given before it.

The questions of a conversation depend on each other, those of different
conversations do not. So they are answered in waves: the n-th open question of every
conversation that has one. What does not depend on the answers, routing and
retrieval, is done for all questions before the first wave, in one search. A wave
reads its questions and the newest messages of their conversations, asks the models,
and writes its answers and the messages for the next wave; conversations without a
further question drop out, so the work of all waves is that of all questions.

Each wave is a folder that is there in full or not at all. A replay that is started
again on its folder goes on after the last full wave and asks no model twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagework.functions.fixed_values import AGENTS, MAX_DISTANCE, PROMPT_HISTORY, TOP_K
from passagework.functions.prompts import TURN_TEMPLATE, chat_prompt, messages
from passagework.functions.text import cut_tokens, whitespace_token_count
from passagework.operators.agents import batch_answer, route_queries
from passagework.operators.context import enrich
from passagework.operators.history import prompt_history
from passagework.plans.answer import ANSWER_COLUMNS
from passagework.sources.files import is_complete

KEPT = "array<struct<role:string,content:string>>"


def replay_conversations(
    queries: DataFrame,
    index: DataFrame,
    models,
    folder: str,
    turns: DataFrame | None = None,
    embedder=None,
    agents=AGENTS,
    override: str | None = None,
    k: int = TOP_K,
    max_distance: float = MAX_DISTANCE,
    history: int = PROMPT_HISTORY,
    budget: int | None = None,
    limit: int | None = None,
    order="query_id",
    turn_order=None,
    template=TURN_TEMPLATE,
    log: str | None = None,
    ts: Column | None = None,
    **search,
) -> DataFrame:
    """One answered row per question, with ``conv_id`` and its ``wave``.

    ``queries`` has ``query_id, query, conv_id`` and the columns of ``order``, by which
    the questions of a conversation follow each other (then by ``query_id``); ``turns``
    are messages that were there before. A prompt holds the newest ``history`` messages;
    the oldest of these go until it fits ``budget`` tokens, and with ``limit`` it ends
    after so many tokens whatever it holds. A question without an answer leaves its
    error and adds no message. A null ``conv_id`` is a conversation of its own.

    ``folder`` keeps the waves. With ``log`` every wave is also appended to that
    conversation log, each in a folder of its own, so a wave that runs again replaces
    what it had logged; ``ts`` is the time written, the time of the wave by default.
    """
    spark = queries.sparkSession
    folder = folder.rstrip("/")
    asked = _prepared(
        queries, index, f"{folder}/questions", embedder, agents, override, k, max_distance,
        [order] if isinstance(order, str) else list(order), search,
    )
    first = _opening(asked, turns, history, turn_order)
    waves = asked.agg(F.max("wave")).first()[0] or 0
    for wave in range(1, waves + 1):
        done = f"{folder}/answers/wave={wave:06d}"
        known = _known(spark, folder, wave, first)
        if not is_complete(spark, done):
            now = asked.where(F.col("wave") == wave)
            answered = _ask(now, known, models, budget, limit, template)
            answered.write.mode("overwrite").parquet(done)
        answered = spark.read.parquet(done)
        if log is not None:
            _logged(answered, ts).write.mode("overwrite").json(
                f"{log.rstrip('/')}/replay-{_name(folder)}-{wave:06d}"
            )
        if wave < waves and not is_complete(spark, f"{folder}/known/{wave + 1:06d}"):
            _remembered(known, answered, history).write.mode("overwrite").parquet(
                f"{folder}/known/{wave + 1:06d}"
            )
    if not waves:
        return _ask(asked, first, models, budget, limit, template).withColumn("wave", F.lit(0))
    return spark.read.parquet(f"{folder}/answers")


def _name(folder: str) -> str:
    from hashlib import md5

    return md5(folder.encode()).hexdigest()[:12]


def _prepared(queries, index, path, embedder, agents, override, k, max_distance, order, search):
    """Questions with their wave, route and passages, made once and kept in ``path``."""
    spark = queries.sparkSession
    if not is_complete(spark, path):
        in_turn = Window.partitionBy("conv_id").orderBy(*order, "query_id")
        place = F.row_number().over(in_turn)
        numbered = queries.withColumns(
            {"wave": place, "more": F.lead("query_id").over(in_turn).isNotNull()}
        )
        routed = route_queries(numbered, agents, override)
        enriched = enrich(routed, index, embedder, k, max_distance, **search)
        carried = [c for c in ANSWER_COLUMNS if c not in ("answer", "error")]
        # Sorted by wave: a wave then reads its own row groups of the files.
        rows = enriched.select(*carried, "system_prompt", "user_prompt", "conv_id", "wave", "more")
        rows.repartitionByRange("wave", F.xxhash64("query_id")).sortWithinPartitions(
            "wave"
        ).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _opening(asked: DataFrame, turns: DataFrame | None, history: int, turn_order) -> DataFrame:
    """Per conversation with a question: its newest messages from before, and their number."""
    conversations = asked.where("wave = 1").select("conv_id")
    if turns is None:
        return conversations.select("conv_id", F.array().cast(KEPT).alias("kept"), _no_turns())
    past = prompt_history(turns, history, order=turn_order).withColumnRenamed("history", "kept")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    known = past.join(sizes, "conv_id").select(F.col("conv_id").alias("_conv"), "kept", "n_turns")
    return conversations.join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        F.coalesce(F.col("kept").cast(KEPT), F.array().cast(KEPT)).alias("kept"),
        F.coalesce("n_turns", F.lit(0).cast("long")).alias("n_turns"),
    )


def _no_turns() -> Column:
    return F.lit(0).cast("long").alias("n_turns")


def _known(spark: SparkSession, folder: str, wave: int, first: DataFrame) -> DataFrame:
    return first if wave == 1 else spark.read.parquet(f"{folder}/known/{wave:06d}")


def _ask(now, known, models, budget, limit, template) -> DataFrame:
    """The questions of a wave, answered beside the messages of their conversations."""
    own = known.select(F.col("conv_id").alias("_conv"), "kept", "n_turns")
    joined = now.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    past = F.col("kept")
    if budget is not None:
        used = whitespace_token_count("system_prompt") + whitespace_token_count("user_prompt")
        past = _fitting(past, F.lit(budget) - used)
    prompt = chat_prompt(messages(F.col("system_prompt"), past, "user_prompt"), template)
    if limit is not None:
        prompt = cut_tokens(prompt, limit)
    asked = joined.withColumn("prompt", prompt).drop("kept", "system_prompt", "user_prompt")
    answered = batch_answer(asked, models).drop("prompt", "wave")
    return answered.withColumn("answer", F.when(F.col("error").isNull(), F.col("answer")))


def _fitting(past: Column, room: Column) -> Column:
    """The newest messages that fit: a message stays if it and all newer ones do."""
    tokens = F.transform(past, lambda m: F.greatest(whitespace_token_count(m["content"]), F.lit(1)))
    return F.filter(
        past,
        lambda m, i: F.aggregate(
            F.slice(tokens, i + 1, F.size(past)), F.lit(0), lambda total, n: total + n
        ) <= room,
    )


def _remembered(known: DataFrame, answered: DataFrame, history: int) -> DataFrame:
    """What the next wave knows: conversations with a further question only."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    ).cast(KEPT)
    new = F.when(F.col("answer").isNotNull(), pair).otherwise(F.array().cast(KEPT))
    said = answered.where("more").select("conv_id", new.alias("new"))
    own = known.select(F.col("conv_id").alias("_conv"), "kept", "n_turns")
    both = F.concat("kept", "new")
    return said.join(own, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id",
        F.slice(both, F.greatest(F.size(both) - history + 1, F.lit(1)), history).alias("kept"),
        (F.col("n_turns") + F.size("new")).alias("n_turns"),
    )


def _logged(answered: DataFrame, ts: Column | None) -> DataFrame:
    """The messages of a wave; ``turn`` goes on from those the conversation had."""
    pair = F.array(
        F.struct(F.lit("user").alias("role"), F.col("query").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")),
    )
    rows = answered.where(F.col("answer").isNotNull())
    said = rows.select("conv_id", "n_turns", F.posexplode(pair).alias("i", "m"))
    return said.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        (F.col("n_turns") + F.col("i")).alias("turn"),
        "m.role",
        "m.content",
        (F.current_timestamp() if ts is None else ts).alias("ts"),
    )
