"""Repeated passages: blocks cut by their words, looked up in an index of all blocks.

This stands in place of a relative Lempel-Ziv parse, which would factor every document
against every reference block: all documents would meet all blocks (see the README).
Here the corpus is its own reference, cut at places that the words decide: a block is
a run of windows with the same anchor, the least hash of the short word runs in the
window. Equal passages are cut alike wherever they stand, so blocks are looked up by
what is in them: neighbouring blocks that an earlier document has are one repeated
span, and every block holds at least a whole window. Spans end inside blocks that are
not repeated as a whole; there, and in every other block whose anchor several
different blocks have, the windows are looked up one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, sized, slices, stored, texts_of

WINDOW = 50
ANCHOR_WORDS = 16
MAX_BROADCAST_SPANS = 1_000_000

_RNG = np.random.default_rng(0xB10C)
BYTE_VALUES = _RNG.integers(0, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
BYTE_STEP, RUN_STEP, HIGH_STEP, LOW_STEP = (int(x) * 2 + 1 for x in _RNG.integers(2**40, 2**63, 4))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without linear structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(step: int, n: int) -> np.ndarray:
    """step ** 0 .. step ** (n - 1), modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(step & (2**64 - 1)))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end) of some texts."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    word = np.cumsum(np.bincount(starts, minlength=len(data))) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    place[space] = 0
    values = BYTE_VALUES[data] * powers(BYTE_STEP, int(place.max()) + 1)[place]
    values[space] = 0
    hashes = mixed(np.add.reduceat(values, starts))
    return hashes, np.concatenate(([0], np.searchsorted(starts, ends)))


def run_hashes(words: np.ndarray, n: int, step: int) -> np.ndarray:
    """A hash of words[i : i + n] for every i; the last n - 1 are not meaningful."""
    out, done, part, length, factor = None, 0, words, 1, step
    while True:
        if n & length:
            out = part if out is None else out + _ahead(part, done) * _power(step, done)
            done += length
        if done == n:
            return mixed(out)
        part = part + _ahead(part, length) * np.uint64(factor)
        length, factor = length * 2, factor * factor % 2**64


def _power(step: int, n: int) -> np.uint64:
    return np.uint64(pow(step, n, 2**64))


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - n)] = x[n:]
    return out


def least_ahead(keys: np.ndarray, n: int) -> np.ndarray:
    """Position of the least of keys[i : i + n] for every i, the leftmost of equals."""
    value, place = keys, np.arange(len(keys))
    done = 1
    while done < n:
        step = min(done, n - done)
        other = np.append(value[step:], np.full(min(step, len(value)), np.uint64(2**64 - 1)))
        other_place = np.append(place[step:], place[len(place) - min(step, len(place)) :])
        less = other < value
        value, place = np.where(less, other, value), np.where(less, other_place, place)
        done += step
    return place


def blocks_of(words: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The blocks of some texts: text, start (word), windows, anchor, content.

    Anchor and content, two hashes of the words, name a block.
    """
    lengths = np.diff(bounds)
    spans = np.maximum(lengths - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(lengths)), spans)
    first = np.repeat(np.cumsum(spans) - spans, spans)
    window = np.arange(len(text)) - first + bounds[text]
    keys = run_hashes(words, ANCHOR_WORDS, RUN_STEP) if len(window) else words
    place = least_ahead(keys, WINDOW - ANCHOR_WORDS + 1)[window] if len(window) else window
    new = np.ones(len(window), dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(text) != 0)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(window)))
    start = window[at]
    return {
        "text": text[at],
        "start": start - bounds[text[at]],
        "windows": count,
        "anchor": keys[place[at]] if len(at) else keys[:0],
        "content": _span_hashes(words, start, start + count + WINDOW - 1, HIGH_STEP),
    }


def _span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    inverse = pow(step, -1, 2**64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(step, len(words)))))
    back = powers(inverse, len(words) + 1)[start]
    return mixed((sums[end] - sums[start]) * back + (end - start).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, bounds = words_of([t.encode("utf-8") for t in texts_of(batch)])
        found = blocks_of(words, bounds)
        rows = pa.array(found["text"])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("version").take(rows),
                pa.array(found["start"].astype(np.int32)),
                pa.array(found["windows"].astype(np.int32)),
                *[_signed(found[c]) for c in ("anchor", "content")],
            ],
            names=["doc_id", "version", "start", "windows", "anchor", "content"],
        )


BLOCKS = "doc_id long, version long, start int, windows int, anchor long, content long"
WINDOWS = "doc_id long, version long, start int, high long, low long"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words, bounds = words_of([t.encode("utf-8") for t in texts_of(batch)])
        if len(words) < WINDOW:
            continue
        spans = batch.column("spans").to_pylist()
        count = np.array([s["windows"] for row in spans for s in row], dtype=np.int64)
        text = np.repeat(np.arange(len(spans)), [len(row) for row in spans])
        first = np.array([s["start"] for row in spans for s in row], dtype=np.int64)
        start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        text = np.repeat(text, count)
        at = start + bounds[text]
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(rows),
                batch.column("version").take(rows),
                pa.array(start.astype(np.int32)),
                _signed(run_hashes(words, WINDOW, HIGH_STEP)[at]),
                _signed(run_hashes(words, WINDOW, LOW_STEP)[at]),
            ],
            names=["doc_id", "version", "start", "high", "low"],
        )


def _with_version(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, every text of an id once): rows that share an id are told apart by a
    hash of their text, which is zero if none do."""
    known = docs.filter("doc_id is not null")
    shared = not known.groupBy("doc_id").count().filter("count > 1").isEmpty()
    version = F.xxhash64(F.coalesce("text", F.lit(""))) if shared else F.lit(0).cast("long")
    versioned = docs.withColumn("version", version)
    known = versioned.filter("doc_id is not null")
    return versioned, known.dropDuplicates(["doc_id", "version"]) if shared else known


def _attach(docs: DataFrame, lists: DataFrame, kind: str) -> DataFrame:
    """Documents with their list of spans; the lists are broadcast if all are short enough."""
    spans = lists.agg(F.sum(F.size("spans"))).first()[0] or 0
    if spans <= MAX_BROADCAST_SPANS:
        lists = F.broadcast(lists)
    return docs.join(lists, ["doc_id", "version"], kind)


def _lists(spans: DataFrame) -> DataFrame:
    """Spans by text of an id: one row with the list of them, never more than it has words."""
    return spans.groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("start", "windows")).alias("spans")
    )


def repeated_spans(known: DataFrame) -> DataFrame:
    """Spans (doc_id, version, start, windows) of windows that a smaller id has too.

    ``known`` has doc_id, text and version, every text of an id once and no null id.
    """
    blocks = stored(known.mapInArrow(_blocks, BLOCKS), "blocks")
    # The index: every different block once, with the first document that has it.
    index = stored(
        blocks.groupBy("anchor", "content")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")),
        "block-index",
    )
    # Different blocks at one anchor may still share windows.
    several = stored(
        index.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("first").alias("least"), F.max("first").alias("most"))
        .filter("n > 1 and least < most")
        .select("anchor", F.lit(True).alias("several")),
        "anchors",
    )
    marks = stored(
        index.join(sized(several), "anchor", "left")
        .filter("first < last or several")
        .select("anchor", "content", "first", F.coalesce("several", F.lit(False)).alias("several")),
        "marks",
    )
    found = stored(
        blocks.join(marks, ["anchor", "content"])
        .withColumn("whole", F.col("first") < F.col("doc_id"))
        .filter("whole or (several and first = doc_id)")
        .select("doc_id", "version", "start", "windows", "whole"),
        "found",
    )
    whole = found.filter("whole").drop("whole")
    open_blocks = stored(_lists(found.filter("not whole").drop("whole")), "open-blocks")
    windows = stored(
        _attach(known, open_blocks, "inner")
        .select("doc_id", "version", "text", "spans")
        .mapInArrow(_windows, WINDOWS),
        "windows",
    )
    earlier = stored(
        windows.groupBy("high", "low")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first < last")
        .select("high", "low", "first"),
        "earlier",
    )
    single = (
        windows.join(earlier, ["high", "low"])
        .filter("first < doc_id")
        .select("doc_id", "version", "start", F.lit(1).alias("windows"))
    )
    return whole.unionByName(single)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans with those that touch each other's words made one."""
    for batch in slices(batches):
        merged = []
        for spans in batch.column("spans").to_pylist():
            runs: list[dict] = []
            for span in sorted(spans, key=lambda s: s["start"]):
                end = span["start"] + span["windows"]
                if runs and span["start"] < runs[-1]["start"] + runs[-1]["windows"] + WINDOW:
                    runs[-1]["windows"] = max(runs[-1]["windows"], end - runs[-1]["start"])
                else:
                    runs.append(dict(span))
            merged.append(runs)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("windows", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("version"), pa.array(merged, kind)],
            names=["doc_id", "version", "spans"],
        )


LISTS = "doc_id long, version long, spans array<struct<start: int, windows: int>>"


def removed_words(spans: list[dict] | None, n_words: int) -> np.ndarray:
    """A flag per word: whether one of the spans of windows covers it."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    for span in spans or ():
        edge[span["start"]] += 1
        edge[span["start"] + span["windows"] + WINDOW - 1] -= 1
    return np.cumsum(edge)[:n_words] > 0


CUT = "doc_id long, n_words long, n_removed long, kept string, n_factors int"


def _cut(digest: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist()):
                words = text.encode("utf-8").split()
                total, gone, factors = len(words), 0, 0
                if spans:
                    flags = removed_words(spans, total)
                    gone = int(flags.sum())
                    factors = int(np.count_nonzero(np.diff(flags.astype(np.int8), prepend=0) == 1))
                    words = [w for w, f in zip(words, flags.tolist()) if not f]
                kept = b" ".join(words)
                kept = hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8")
                rows.append((total, gone, kept, factors))
            total, gone, kept, factors = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.string()), pa.array(factors, pa.int32())],
                names=[f.split()[0] for f in CUT.split(", ")],
            )

    return read


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept, n_factors.

    ``kept`` joins the words that stay by one space, or is their SHA-256. A word
    goes if a window of 50 words around it also starts in a document with a
    smaller id. Null and empty texts have no words; texts under 50 words lose
    none. Rows with a null id lose nothing and take nothing from others; rows with
    one id leave each other whole. An empty table gives no rows.
    """
    own, distinct = _with_version(id_and_text(docs, id_column, text_column))
    spans = stored(_lists(repeated_spans(distinct)).mapInArrow(_merge, LISTS), "spans")
    return (
        _attach(own, spans, "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_cut(digest), CUT)
    )
