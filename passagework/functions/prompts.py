"""Prompts, passages and chat texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    CONTEXT_END,
    CONTEXT_INTRO,
    NEWS_INSTRUCTION,
    TWEET_INSTRUCTION,
)

# One turn of the training and inference text; the model's own template is
# passed in by the caller where it differs.
TURN_TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")

MESSAGE = "struct<role:string,content:string>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sentiment_instruction(format_col) -> Column:
    """Tweet wording for records of format ``post``, news wording otherwise."""
    return F.when(_col(format_col) == "post", TWEET_INSTRUCTION).otherwise(NEWS_INSTRUCTION)


def build_prompt(instruction, text) -> Column:
    return F.concat(_col(instruction), F.lit("\nInput: "), _col(text))


def passage(rank, text, source, ticker, date) -> Column:
    """``[i] source=.. ticker=.. date=..`` on one line, the text below it.

    A missing source reads ``unknown``; empty ticker and date are left out.
    """

    def part(name, value):
        value = F.nullif(_col(value), F.lit(""))
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}="), value))

    header = F.concat_ws(
        " ",
        F.concat(F.lit("["), _col(rank).cast("string"), F.lit("]")),
        F.concat(F.lit("source="), F.coalesce(_col(source), F.lit("unknown"))),
        part("ticker", ticker),
        part("date", date),
    )
    return F.concat(header, F.lit("\n"), _col(text))


def system_prompt(context, base: str = BASE_SYSTEM) -> Column:
    """The base prompt, with the context block when there is one."""
    filled = F.concat(F.lit(base + CONTEXT_INTRO), _col(context), F.lit(CONTEXT_END))
    return F.when(_col(context).isNotNull(), filled).otherwise(F.lit(base))


def _turn(role: str, content: Column, template) -> Column:
    start, after_role, end = template
    return F.concat(F.lit(f"{start}{role}{after_role}"), content, F.lit(end))


def chat_text(system, user, assistant, template=TURN_TEMPLATE) -> Column:
    """System, user and assistant turns as one training text."""
    system = F.lit(system) if isinstance(system, str) else system
    return F.concat(
        _turn("system", system, template),
        _turn("user", _col(user), template),
        _turn("assistant", _col(assistant), template),
    )


def messages(system, history, user) -> Column:
    """Message list for a model: system, history (may be null), user."""

    def one(role, content):
        return F.array(F.struct(F.lit(role).alias("role"), _col(content).alias("content")))

    past = F.coalesce(_col(history), F.array().cast(f"array<{MESSAGE}>"))
    return F.concat(one("system", system), past, one("user", user))


def chat_prompt(message_list, template=TURN_TEMPLATE) -> Column:
    """Message list rendered for generation, ending with an open assistant turn."""
    start, after_role, end = template
    turns = F.transform(
        _col(message_list),
        lambda m: F.concat(F.lit(start), m["role"], F.lit(after_role), m["content"], F.lit(end)),
    )
    return F.concat(F.array_join(turns, ""), F.lit(f"{start}assistant{after_role}"))
