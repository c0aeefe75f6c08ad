"""Text to vectors: a built-in hashed bag of words, or a caller's model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.fixed_values import HASHED_DIM
from passagework.functions.text import words

VECTOR = T.ArrayType(T.FloatType(), True)
# What a worker holds beside an Arrow batch: dense rows at once, words whose bucket it knows.
SCATTER_ROWS = 1024
KNOWN_WORDS = 200_000


@dataclass(frozen=True)
class HashedEmbedder:
    """Word counts hashed into ``dim`` buckets, scaled to length one.

    Spark finds the words; hashing and the scatter into dense vectors are done in
    slices of an Arrow batch, and a word is hashed once as long as it is remembered.
    Null text and text without a word give null, as there is no direction to compare.
    """

    dim: int = HASHED_DIM

    @property
    def name(self) -> str:
        return f"hashed-words-{self.dim}"

    def vector(self, col) -> Column:
        col = F.col(col) if isinstance(col, str) else col
        dim = self.dim

        @F.arrow_udf(VECTOR)
        def scatter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            buckets: dict[bytes, int] = {}
            for batch in batches:
                for at in range(0, len(batch), SCATTER_ROWS):
                    yield _scattered(batch.slice(at, SCATTER_ROWS), dim, buckets)

        return scatter(words(col))


def _scattered(rows: pa.Array, dim: int, buckets: dict[bytes, int]) -> pa.Array:
    """Vectors of lists of words; ``buckets`` are those of the words met before."""
    lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
    coded = rows.flatten().dictionary_encode()
    words_met = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    if len(buckets) > KNOWN_WORDS:
        buckets.clear()
    for word in set(words_met).difference(buckets):
        buckets[word] = int.from_bytes(md5(word).digest()[:3], "big") % dim
    bucket = np.fromiter(map(buckets.__getitem__, words_met), np.int64, len(words_met))
    row = np.repeat(np.arange(len(rows)), lengths)
    cell = row * dim + bucket[coded.indices.to_numpy()]
    dense = np.bincount(cell, minlength=len(rows) * dim).reshape(len(rows), dim)
    known = lengths > 0
    dense = dense[known].astype(np.float64)
    norm = np.sqrt((dense * dense).sum(axis=1, keepdims=True))
    unit = (dense / norm).astype(np.float32)
    offsets = np.concatenate([[0], np.cumsum(known * dim)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(unit.ravel()), mask=pa.array(~known)
    )


@dataclass(frozen=True)
class ModelEmbedder:
    """A caller's model, loaded once per task, given ``batch_size`` texts at a time.

    ``factories`` are tried in order, the first that loads is used, so that a
    fallback can stand behind the primary model. Vectors of different models do
    not compare, so ``resolve`` settles which one it is, once, on the driver;
    the tasks then load that one and fail if they cannot. A text that the model
    refuses gets a vector of NaN: it is never found, and as a question it has
    status ``error`` while the others are answered.
    """

    factories: Sequence[tuple[str, Callable[[], Callable]]]
    dim: int
    batch_size: int = 256
    _chosen: list = field(default_factory=list, repr=False, compare=False)

    def resolve(self) -> tuple[str, Callable]:
        if not self._chosen:
            for name, factory in self.factories:
                try:
                    factory()
                except Exception as error:  # any failure to load moves on to the next
                    logging.getLogger(__name__).warning("cannot load %s: %s", name, error)
                    continue
                self._chosen.append((name, factory))
                break
            else:
                raise RuntimeError("none of the embedding models could be loaded")
        return self._chosen[0]

    @property
    def name(self) -> str:
        return self.resolve()[0]

    def vector(self, col) -> Column:
        _, factory = self.resolve()
        dim = self.dim

        size = self.batch_size

        @F.arrow_udf(VECTOR)
        def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = factory()

            def vectors_of(texts: list[str]) -> np.ndarray:
                return np.asarray(encode(texts), dtype=np.float32).reshape(len(texts), dim)

            def one(text: str) -> np.ndarray:
                try:
                    return vectors_of([text])
                except Exception as error:
                    logging.getLogger(__name__).warning("no vector for a text: %s", error)
                    return np.full((1, dim), np.nan, dtype=np.float32)

            for batch in batches:
                # Only a slice of the texts is there as Python objects at a time.
                for at in range(0, len(batch), size):
                    texts = batch.slice(at, size).to_pylist()
                    try:
                        vectors = vectors_of(texts)
                    except Exception:  # find the texts at fault; the others keep their vectors
                        vectors = np.concatenate([one(t) for t in texts])
                    offsets = np.arange(len(texts) + 1, dtype=np.int32) * dim
                    yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

        col = F.col(col) if isinstance(col, str) else col
        return F.when(col.isNotNull(), encoded(F.coalesce(col, F.lit(""))))


def embed(df: DataFrame, col: str = "text", embedder=None, out: str = "embedding") -> DataFrame:
    embedder = embedder or HashedEmbedder()
    return df.withColumn(out, embedder.vector(col)).withColumn("model_name", F.lit(embedder.name))


def components(
    df: DataFrame, *keys: str, vector: str = "embedding", pos: str = "pos", value: str = "x"
) -> DataFrame:
    """``keys`` and one row per component of a vector; rows without a vector give none.

    An inner explode has Spark filter its input by the vector's size beforehand, and where
    the vector is a UDF's that filter computes it once more. An outer one does not.
    """
    rows = df.select(*keys, F.posexplode_outer(vector).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())
