"""Several sources to one shuffled, tokenized training set."""

from __future__ import annotations

from pyspark.sql import DataFrame

from passagework.functions.fixed_values import SFT_TOKENS, SPLIT_SEED
from passagework.operators.ordering import concat_datasets, seeded_shuffle
from passagework.operators.training import prepare_sft, tokenize


def build_training_set(
    sources: dict[str, DataFrame],
    key: str = "example_id",
    tokenizer=None,
    max_tokens: int = SFT_TOKENS,
    seed: int = SPLIT_SEED,
    position: str | None = None,
    prepare=prepare_sft,
    **options,
) -> DataFrame:
    """Union, format, filter, tokenize, then shuffle: the one exchange comes last.

    ``key`` identifies an example across all sources.
    """
    united = concat_datasets(**sources)
    texts = prepare(united, keep=(key, "dataset"), max_tokens=max_tokens, **options)
    tokens = tokenize(texts, tokenizer, max_tokens)
    return seeded_shuffle(tokens, key, seed, position)
