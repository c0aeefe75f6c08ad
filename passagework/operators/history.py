"""Conversation history: newest messages per conversation.

Every operator cuts in two steps before anything else: the newest ``n`` of every
shard of a conversation, then the newest ``n`` of what is left. A conversation of
any length is read by many tasks, and at most ``SHARDS * n`` rows of it meet in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.fixed_values import MAX_HISTORY, PROMPT_HISTORY, PROMPT_TOKENS
from passagework.functions.text import whitespace_token_count


SHARDS = 64
LOG_ORDER = ("ts", "turn", "line")


def _newest(turns: DataFrame, n: int, conv: str, order: list[str]) -> DataFrame:
    shard = F.pmod(F.xxhash64(*order), F.lit(SHARDS))
    left = turns.withColumn("_shard", shard)
    for keys in ([conv, "_shard"], [conv]):
        newest_first = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        left = left.withColumn("_newest", F.row_number().over(newest_first)).where(
            F.col("_newest") <= n
        )
    return left.drop("_newest", "_shard")


def _order(turns: DataFrame, order) -> list[str]:
    """The columns that order messages; by default those of a log that are there."""
    if order is None:
        return [c for c in LOG_ORDER if c in turns.columns]
    return [order] if isinstance(order, str) else list(order)


def prune_turns(
    turns: DataFrame, n: int = MAX_HISTORY, conv: str = "conv_id", order=None
) -> DataFrame:
    """Newest ``n`` messages of every conversation."""
    return _newest(turns, n, conv, _order(turns, order))


def prompt_history(
    turns: DataFrame,
    n: int = PROMPT_HISTORY,
    conv: str = "conv_id",
    order=None,
    content: str = "content",
) -> DataFrame:
    """Per conversation its newest ``n`` messages, oldest first, role and content only.

    ``tokens_to_end`` of :func:`fit_history` stays with a message where it is given.
    """
    order = _order(turns, order)
    kept = ["tokens_to_end"] if "tokens_to_end" in turns.columns else []
    message = F.struct(*order, "role", F.col(content).alias("content"), *kept)
    sorted_messages = F.sort_array(F.collect_list(message))
    return (
        _newest(turns, n, conv, order)
        .groupBy(conv)
        .agg(sorted_messages.alias("_messages"))
        .select(
            conv,
            F.transform(
                "_messages",
                lambda m: F.struct(*[m[c].alias(c) for c in ("role", "content", *kept)]),
            ).alias("history"),
        )
    )


def fit_history(
    turns: DataFrame,
    budget: int = PROMPT_TOKENS,
    token_count=whitespace_token_count,
    conv: str = "conv_id",
    order=None,
    content: str = "content",
) -> DataFrame:
    """Drop the oldest messages until the rest fits a budget of tokens.

    Adds ``tokens`` and ``tokens_to_end``, the sum from this message to the
    newest. A message counts as one token at least, also where ``token_count``
    gives less, so no more than ``budget`` messages can remain: that limit comes
    first and loses nothing.
    """
    order = _order(turns, order)
    newest_first = Window.partitionBy(conv).orderBy(*[F.col(c).desc() for c in order])
    to_end = newest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    recent = _newest(turns, budget, conv, order)
    counted = recent.withColumn("tokens", F.greatest(token_count(content), F.lit(1)))
    return counted.withColumn("tokens_to_end", F.sum("tokens").over(to_end)).where(
        F.col("tokens_to_end") <= budget
    )
