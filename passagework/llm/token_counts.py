"""Token counts by a table of frequent pre-tokens and a cache of the others.

A byte-level tokenizer cuts a text into pre-tokens and encodes each alone, so the
count of a text is the sum over its pre-tokens. Lengths of the frequent ones are
broadcast; a worker encodes any other once and keeps its length. Pre-tokens are
never shuffled: tasks pass on bounded summaries of the frequent ones only.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, slices, texts_of, worker_state

TABLE_ENTRIES = 1 << 16
TASK_ENTRIES = 1 << 12
TRACKED_ENTRIES = 1 << 17
CACHE_ENTRIES = 1 << 18
MAX_ENTRY_CHARS = 32

# Fixed value: how byte-level tokenizers cut a text.
BYTE_LEVEL = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Where the classes of the regular expression module and of the tokenizer's own,
# which follow different Unicode versions, are known to agree.
COMMON = r"[\x00-\u0557\u2000-\u206f]*"


class Counted:
    """A tokenizer in a worker, with the lengths it has already found."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cut = regex.compile(BYTE_LEVEL).findall
        self.common = regex.compile(COMMON).fullmatch
        added = json.loads(definition).get("added_tokens", [])
        self.special = [t["content"] for t in added]
        self.cache: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or self.common(text):
            return self.cut(text)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in pieces]

    def encode_lengths(self, texts: list[str]) -> list[int]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [len(e.ids) for e in encoded]

    def counts(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """Tokens of each text; a text with a special string is left to the library."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        whole = dict(zip(special, self.encode_lengths([texts[i] for i in special])))
        cut = [[] if i in whole else self.pre_tokens(t) for i, t in enumerate(texts)]
        misses = set().union(*cut)
        misses.difference_update(frequent)
        if len(self.cache) + len(misses) > CACHE_ENTRIES:
            self.cache = {}
        new = [m for m in misses if m not in self.cache]
        self.cache.update(zip(new, self.encode_lengths(new)))
        near = {m: self.cache[m] for m in misses}
        length = _Lengths(frequent)
        length.update(near)
        return [whole.get(i, sum(map(length.__getitem__, p))) for i, p in enumerate(cut)]


class _Lengths(dict):
    """The lengths a slice needs: its misses here, the frequent ones behind them."""

    def __init__(self, frequent: dict[str, int]):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, key: str) -> int:
        self[key] = length = self.frequent[key]
        return length


def _counted(definition: str) -> Counted:
    return worker_state(("token counts", hash(definition)), lambda: Counted(definition))


def check_definition(definition: str) -> None:
    """Only tokenizers whose pre-tokens are encoded alone and cut by the known pattern."""
    found = json.loads(definition)
    cut = found.get("pre_tokenizer") or {}
    fits = (
        found.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
    )
    if not fits:
        raise ValueError("not a byte-level tokenizer with the standard pattern")


def _summaries(definition):
    """The most frequent pre-tokens of a task, with counts that may be a little low."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen = _counted(definition.value), Counter()
        for batch in slices(batches):
            for text in texts_of(batch):
                seen.update(counted.pre_tokens(text))
            if len(seen) > TRACKED_ENTRIES:
                seen = Counter(dict(seen.most_common(TRACKED_ENTRIES // 2)))
        top = [(t, n) for t, n in seen.most_common(TASK_ENTRIES) if len(t) <= MAX_ENTRY_CHARS]
        if top:
            tokens, counts = zip(*top)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(counts, pa.int64())], names=["token", "n"]
            )

    return read


def _lengths(definition):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counted(definition.value)
        for batch in batches:
            lengths = counted.encode_lengths(batch.column("token").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("token"), pa.array(lengths, pa.int32())], names=["token", "length"]
            )

    return read


def frequent_lengths(texts: DataFrame, definition) -> dict[str, int]:
    """Lengths of the pre-tokens that are frequent over all texts, at most TABLE_ENTRIES.

    Which ones these are changes only the time of a count, never the count.
    """
    summaries = texts.select("text").mapInArrow(_summaries(definition), "token string, n long")
    top = (
        summaries.groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(TABLE_ENTRIES)
        .select("token")
    )
    return dict(top.mapInArrow(_lengths(definition), "token string, length int").collect())


def _count(definition, frequent):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counted(definition.value)
        for batch in slices(batches):
            counts = counted.counts(texts_of(batch), frequent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return read


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the tokenizer in the JSON file at ``tokenizer_path`` (read
    on the driver), without added special tokens; special strings in a text count
    as the library counts them. Null and empty texts have no bytes and no tokens.
    Ids are passed through, null and repeated ones too; an empty table gives no
    rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    check_definition(text)
    context = docs.sparkSession.sparkContext
    definition = context.broadcast(text)
    own = id_and_text(docs, id_column, text_column)
    frequent = context.broadcast(frequent_lengths(own, definition))
    sized = own.withColumn(
        "n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    )
    counted = sized.mapInArrow(
        _count(definition, frequent), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
