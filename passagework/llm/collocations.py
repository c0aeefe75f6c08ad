"""Phrases whose words occur together more often than their parts explain.

Counts are kept as sorted streams. The phrases of every length, with their counts, are
laid out twice: by what they begin with (all words but the last ones) and by what they
end with. Each layout is joined to the shorter phrases by a sort-merge join, so the
count of a first part, of a rest, and the largest count of a phrase one word longer are
read in step from streams in one order; no table of counts is looked up by hash.

Most phrases of a corpus occur once or twice and can have no score, so they are not
spelled out. A phrase that occurs often has parts that occur often: a first pass counts
64-bit hashes of the pairs of words, and only those that are frequent are marked in a
bitmap of fixed size, which longer phrases are tested against. The bitmap only leaves
out; what is counted in the end are the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagework.llm.common import slices, stored
from passagework.llm.substring_dedup import mixed

MAX_WORDS, MIN_COUNT, COVERED, TOP = 3, 10, 50, 2000
UNKNOWN_LANG = "und"
CHUNK_BYTES = 8 << 20
BITMAP_BITS = 27
SHARDS = 64

BREAKS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# 0 for a byte of a word, 1 for a space, 2 for the end of a piece.
KINDS = bytes(2 if b in BREAKS else 1 if b in b" \t" else 0 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts of some CHUNK_BYTES, cut between pieces; one piece is never cut."""
    while len(text) > CHUNK_BYTES:
        at = max(text.rfind(bytes([b]), 0, CHUNK_BYTES) for b in BREAKS)
        if at < 0:
            later = [p for b in BREAKS if (p := text.find(bytes([b]), CHUNK_BYTES)) >= 0]
            if not later:
                break
            at = min(later)
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language at a time, some CHUNK_BYTES together."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for batch in slices(batches):
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            for part in _parts(text or b""):
                waiting.setdefault(lang, []).append(part)
                size += len(part)
                if size >= CHUNK_BYTES:
                    for own, parts in waiting.items():
                        yield own, b"\n".join(parts)
                    waiting, size = {}, 0
    for own, parts in waiting.items():
        yield own, b"\n".join(parts)


def words_of(text: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The words, in lower case, and the piece each stands in."""
    kinds = np.frombuffer(text.translate(KINDS), dtype=np.uint8)
    inside = kinds == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    letters = np.frombuffer(text.translate(LOWER), dtype=np.uint8)[inside]
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())
    )
    return words, np.searchsorted(np.flatnonzero(kinds == 2), starts)


class _Phrases:
    """The phrases of a chunk, length by length: where they start, and their hashes.

    ``marked`` has a bitmap for some lengths; a phrase goes on only if its bit is set,
    and a longer one begins only where the two a word shorter both went on.
    """

    def __init__(self, lang: str, text: bytes, marked: dict[int, np.ndarray]):
        import xxhash

        words, self.pieces = words_of(text)
        encoded = words.dictionary_encode()
        self.words, self.word = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang) & (2**64 - 1)
        own = [xxhash.xxh64_intdigest(w, seed) for w in self.words.to_pylist()]
        self.word_hash = np.array(own, dtype=np.uint64)[self.word]
        self.marked = marked
        self.size = 1
        self.at = np.arange(len(self.word))
        self.hash = self.word_hash

    def longer(self) -> None:
        """From phrases of ``size`` words to those of one more."""
        last = self.at[:-1] + self.size
        both = (np.diff(self.at) == 1) & (self.pieces[self.at[:-1]] == self.pieces[last])
        self.at, last = self.at[:-1][both], last[both]
        self.hash = mixed(self.hash[:-1][both] * _STEP + self.word_hash[last])
        self.size += 1
        if self.size in self.marked:
            bits = self.marked[self.size]
            place = self.hash & np.uint64((1 << BITMAP_BITS) - 1)
            one = bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
            there = (one & np.uint64(1)).astype(bool)
            self.at, self.hash = self.at[there], self.hash[there]


def _hashes(size: int, marked):
    """(hash, n) of the phrases of ``size`` words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _bitmaps(marked)
        for lang, text in _chunks(batches):
            phrases = _Phrases(lang, text, bitmaps)
            while phrases.size < size:
                phrases.longer()
            values, counts = np.unique(phrases.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.view(np.int64)), pa.array(counts)], names=["hash", "n"]
            )

    return read


COUNTS = "lang string, size int, phrase string, n long"


def _spelled(max_words: int, marked):
    """(lang, size, phrase, n) of all words, and of the longer phrases that are left."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _bitmaps(marked)
        for lang, text in _chunks(batches):
            phrases = _Phrases(lang, text, bitmaps)
            texts, number = phrases.words, phrases.word
            counts = np.bincount(number, minlength=len(texts))
            while True:
                if len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(len(texts), dtype=np.int8))),
                         pa.array(np.full(len(texts), phrases.size, dtype=np.int32)),
                         texts, pa.array(counts.astype(np.int64))],
                        names=["lang", "size", "phrase", "n"],
                    )
                if phrases.size == max_words or not len(texts):
                    break
                number_at = np.zeros(len(phrases.word), dtype=np.int64)
                number_at[phrases.at] = number
                phrases.longer()
                last = phrases.word[phrases.at + phrases.size - 1]
                keys, number, counts = np.unique(
                    number_at[phrases.at] << 32 | last, return_inverse=True, return_counts=True
                )
                texts = pc.binary_join_element_wise(
                    texts.take(pa.array(keys >> 32)),
                    phrases.words.take(pa.array(keys & 0xFFFFFFFF)), " "
                )

    return read


def _bitmaps(marked) -> dict[int, np.ndarray]:
    return {size: np.frombuffer(bits.value, dtype=np.uint64) for size, bits in marked.items()}


def _marked(hashes: DataFrame, min_count: int):
    """A bitmap of the hashes that occur often, of one size whatever their number.

    So it may be broadcast; the more hashes there are, the less it leaves out.
    """
    place = F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = (
        hashes.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
        .select(F.shiftright(place, 6).alias("word"),
                F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def phrase_counts(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """lang, size, phrase, n: every word, and every phrase that occurs ``min_count`` times
    (some rarer ones may come along)."""
    texts = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    marked = {}
    for size in range(2, max(max_words, 3)):
        hashes = texts.mapInArrow(_hashes(size, marked), "hash long, n long")
        marked[size] = _marked(hashes, min_count)
    return (
        texts.mapInArrow(_spelled(max_words, marked), COUNTS)
        .groupBy("lang", "size", "phrase")
        .agg(F.sum("n").alias("n"))
    )


def _first(phrase: str, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, k), " ")


def _rest(phrase: str, k: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, size - k), " ")


def _in_step(stream: DataFrame, counts: DataFrame, key: str, name: str) -> DataFrame:
    """``stream`` in the order of ``key`` merged with the counts in the order of phrases."""
    shorter = counts.select("lang", F.col("phrase").alias(key), F.col("n").alias(name))
    return stream.join(shorter.hint("merge"), ["lang", key])


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    covered: int = COVERED, top: int | None = TOP,
    text_column: str = "text", lang_column: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases that hold together best.

    Texts in lower case (A-Z) fall at ``[.,;:!?\\x0A-\\x0D]`` into pieces, and these at
    spaces and tabs into words; a phrase is 2 to ``max_words`` words in a row of a piece.
    ``n`` are all words of a language, ``a`` the occurrences of the phrase (at least
    ``min_count``), overlaps included, ``l`` and ``r`` those of its first part and its
    rest where cutting it gives the least floor(1000000 a a / (l r)), the first such
    cut. A phrase goes if a longer one that holds it occurs in ``covered`` percent of its
    places or more. Ranked by score, ``a``, and the bytes of the phrase; ``top`` of each
    language stay, all if it is None. Null languages are ``und``, null texts empty;
    repeated rows count each; an empty table, or one of short texts, gives no rows.
    """
    counts = stored(phrase_counts(docs, max_words, min_count, text_column, lang_column), "phrases")
    often = stored(counts.filter(F.col("n") >= min_count), "phrases-often")
    size, k = F.col("size"), F.col("k")
    phrases = often.filter("size > 1").withColumnRenamed("n", "a")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "*", _first("phrase", k).alias("first"), _rest("phrase", k, size).alias("rest")
    )
    cuts = _in_step(_in_step(cuts, often, "first", "l"), often, "rest", "r")
    whole = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "l", "r")}
    above = whole["a"] * whole["a"] * F.lit(1_000_000).cast("decimal(8,0)")
    below = whole["l"] * whole["r"]
    score = F.call_function("div", above, below)
    scored = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    # A phrase is inside a longer one of which it is all but the last or the first word;
    # still longer ones are no more frequent than these.
    one_more = phrases.filter("size > 2")
    ends = [_first("phrase", size - 1), _rest("phrase", F.lit(1), size)]
    held = (
        one_more.select("lang", F.explode(F.array(*ends)).alias("phrase"), F.col("a").alias("more"))
        .groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    )
    left = (
        scored.join(held.hint("merge"), ["lang", "phrase"], "left")
        .filter(f"more is null or 100 * more < {int(covered)} * a")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    totals = counts.filter("size = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang").orderBy(*order)
    if top is not None:
        # First inside shards, so that a language of any size is cut by many tasks.
        shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
        inner = Window.partitionBy("lang", "shard").orderBy(*order)
        left = (
            left.withColumn("shard", shard)
            .withColumn("place", F.row_number().over(inner))
            .filter(F.col("place") <= top)
        )
    ranked = left.withColumn("rank", F.row_number().over(by_lang).cast("long"))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
