"""From examples to training sets: format, filter, tokenize, batch, pack."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    EFFECTIVE_BATCH,
    EPOCHS,
    FORECAST_SYSTEM,
    FORECAST_TOKENS,
    IGNORED_LABEL,
    SFT_TOKENS,
    SPLIT_SEED,
)
from passagework.functions.prompts import TURN_TEMPLATE, build_prompt, chat_text
from passagework.functions.text import (
    is_blank,
    md5_int,
    strip,
    text_or_empty,
    whitespace_token_count,
    whitespace_tokens,
)
from passagework.operators.ordering import global_position, running_total

PAD, END = 0, 1
TOKENIZER_ROWS = 256


def format_examples(
    df: DataFrame,
    user: str = "instruction",
    assistant: str = "output",
    system: str = BASE_SYSTEM,
    include_input: bool = False,
    template=TURN_TEMPLATE,
    required: bool = False,
    max_tokens: int = SFT_TOKENS,
    token_count=whitespace_token_count,
) -> DataFrame:
    """Add ``text``, its ``n_tokens`` and whether the example is ``valid``.

    Missing fields count as empty. ``required`` trims both sides and makes an
    example without a prompt or an answer invalid. ``include_input`` appends the
    ``input`` column to the prompt.
    """
    prompt, answer = text_or_empty(user), text_or_empty(assistant)
    if include_input:
        prompt = build_prompt(prompt, text_or_empty("input"))
    if required:
        prompt, answer = strip(prompt), strip(answer)
    complete = F.lit(True)
    if required:
        complete = (F.length("_prompt") > 0) & (F.length("_answer") > 0)
    return (
        df.withColumns({"_prompt": prompt, "_answer": answer})
        .withColumn("_complete", complete)
        .withColumn("text", chat_text(system, "_prompt", "_answer", template))
        .withColumn("n_tokens", token_count("text"))
        .withColumn(
            "valid",
            F.col("_complete") & (F.col("n_tokens") <= max_tokens) & ~is_blank("text"),
        )
        .drop("_prompt", "_answer", "_complete")
    )


def prepare_sft(df: DataFrame, keep=(), **options) -> DataFrame:
    """Valid examples only: the ``keep`` columns and ``text``."""
    return format_examples(df, **options).where("valid").select(*keep, "text")


def prepare_forecasts(df: DataFrame, keep=(), **options) -> DataFrame:
    """The same for forecaster examples, with their own prompt and limit."""
    settings = dict(
        user="prompt",
        assistant="answer",
        system=FORECAST_SYSTEM,
        required=True,
        max_tokens=FORECAST_TOKENS,
    )
    return prepare_sft(df, keep, **(settings | options))


def dataset_sizes(df: DataFrame, by="dataset") -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"))


def retention(formatted: DataFrame, by=(), valid: str = "valid") -> DataFrame:
    """Rows before and after the filter and the share kept, in percent, in one pass."""
    by = [by] if isinstance(by, str) else list(by)
    kept = F.count_if(valid)
    return formatted.groupBy(*by).agg(
        F.count("*").alias("n_raw"),
        kept.alias("n_kept"),
        (kept / F.nullif(F.count("*"), F.lit(0)) * 100).alias("retention_pct"),
    )


def training_steps(df: DataFrame, batch: int = EFFECTIVE_BATCH, epochs: int = EPOCHS) -> DataFrame:
    """Estimated optimizer steps: full batches per epoch times epochs."""
    rows = F.count("*")
    return df.agg(
        rows.alias("n_rows"),
        (F.floor(rows / F.lit(batch)) * epochs).cast("bigint").alias("training_steps"),
    )


@dataclass(frozen=True)
class HashedTokenizer:
    """Whitespace tokens with hashed ids; ids 0 and 1 are padding and end."""

    vocab: int = 1 << 20

    def ids(self, col, max_len: int | None) -> Column:
        tokens = whitespace_tokens(col)
        if max_len is not None:
            tokens = F.slice(tokens, 1, max_len)
        room = self.vocab - 2
        return F.transform(tokens, lambda t: (md5_int(t, 7) % room + 2).cast("int"))


@dataclass(frozen=True)
class ModelTokenizer:
    """A caller's tokenizer: the factory returns a function from texts to id lists."""

    factory: Callable[[], Callable[[list[str]], list[list[int]]]]

    def ids(self, col, max_len: int | None) -> Column:
        factory = self.factory

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokenizer = factory()
            for batch in batches:
                # A list of ids takes many times the room of its text, so a slice at a time.
                for at in range(0, len(batch), TOKENIZER_ROWS):
                    texts = pc.fill_null(batch.slice(at, TOKENIZER_ROWS), "").to_pylist()
                    ids = [list(one)[:max_len] for one in tokenizer(texts)]
                    yield pa.array(ids, pa.list_(pa.int32()))

        return encode(col)


def tokenize(
    df: DataFrame, tokenizer=None, max_len: int | None = SFT_TOKENS, text: str = "text"
) -> DataFrame:
    """Replace the text by ``input_ids``, cut at ``max_len``, without padding."""
    tokenizer = tokenizer or HashedTokenizer()
    return df.withColumn("input_ids", tokenizer.ids(text, max_len)).drop(text)


def collate(
    df: DataFrame,
    batch_size: int,
    key: str,
    seed: int = SPLIT_SEED,
    pad_id: int = PAD,
    ids: str = "input_ids",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Batches of the seeded order, padded to the longest row of each batch.

    Adds ``batch_id, attention_mask, labels``; labels repeat the ids, with
    padding replaced so that it is left out of the loss.
    """
    placed = global_position(df, key, seed, "_position", bucket_rows)
    batch = F.floor(F.col("_position") / F.lit(batch_size)).cast("bigint")
    width = F.max(F.size(ids)).over(Window.partitionBy("batch_id"))
    short = F.array_repeat(F.lit(0), (F.col("_width") - F.size(ids)).cast("int"))
    real = F.transform(ids, lambda _: F.lit(1))
    return (
        placed.withColumn("batch_id", batch)
        .withColumn("_width", width)
        .withColumn("attention_mask", F.concat(real, short))
        .withColumn(ids, F.concat(ids, F.transform(short, lambda _: F.lit(pad_id))))
        .withColumn(
            "labels",
            F.transform(ids, lambda t: F.when(t == pad_id, IGNORED_LABEL).otherwise(t)),
        )
        .drop("_position", "_width")
    )


def pack_sequences(
    df: DataFrame,
    block: int,
    key: str,
    seed: int = SPLIT_SEED,
    end_id: int = END,
    ids: str = "input_ids",
    drop_last: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """All sequences in seeded order, each closed by ``end_id``, cut into blocks.

    Every sequence gets its exact offset in the whole stream of tokens, so its
    parts can go straight to their blocks; a block gathers at most ``block``
    tokens. The last block may be shorter and is kept unless ``drop_last``.
    """
    closed = df.select(key, F.concat(ids, F.array(F.lit(end_id))).alias("_ids"))
    offset = running_total(closed, key, F.size("_ids"), seed, "_start", bucket_rows)
    last = F.col("_start") + F.size("_ids") - 1
    blocks = F.sequence(
        F.floor(F.col("_start") / F.lit(block)), F.floor(last / F.lit(block))
    )

    def part(block_id):
        """The tokens this sequence puts into one block, with their place."""
        begin = F.greatest(block_id * block, F.col("_start"))
        stop = F.least((block_id + 1) * block, last + 1)
        piece = F.slice(
            "_ids", (begin - F.col("_start") + 1).cast("int"), (stop - begin).cast("int")
        )
        tokens = F.struct(begin.alias("place"), piece.alias("ids"))
        return F.struct(block_id.alias("block_id"), tokens.alias("part"))

    # Cut before exploding: a long sequence is not copied for each of its blocks.
    packed = (
        offset.select(F.inline(F.transform(blocks, part)))
        .groupBy("block_id")
        .agg(F.sort_array(F.collect_list("part")).alias("_parts"))
        .select("block_id", F.flatten(F.transform("_parts", lambda p: p["ids"])).alias(ids))
    )
    return packed.where(F.size(ids) == block) if drop_last else packed
