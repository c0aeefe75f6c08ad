"""Repeated byte strings, by suffixes that sampled splitters deal to sorted buckets.

Only suffixes that can take part in a repeat are sorted. Every string of ``WINDOW``
bytes has an anchor, the place of the least hash of ``LEAD`` bytes in it, which lies at
the same place wherever the string stands; windows in a row with one anchor are a block.

1. Blocks whose anchor bytes occur once are left out: nothing in them is repeated.
2. Equal blocks are counted once, with their first place; all windows of the others are
   repeats. A block needs no sorting unless a different one shares its anchor.
3. What is left is sorted. A suffix begins at the anchor of a block and carries the
   bytes before it in reverse. Splitters sampled from the suffixes cut them into
   buckets by their leading bytes; where more suffixes share these than a bucket may
   hold, all their bytes and their places decide, so no bucket grows with a group.
4. A bucket is sorted by multikey quicksort, eight bytes a step: once by what follows
   the anchor, once by what precedes it. Suffixes side by side share what both orders
   say they share, which tells for every window whether an earlier one is equal.
5. In such a group, windows whose bytes the first or the last suffix of a bucket has
   too may go on beside it. Those are compared across all boundaries, by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, sized, slices, stored
from passagework.llm.substring_dedup import mixed, powers

WINDOW, LEAD = 100, 32
SPAN = WINDOW - LEAD + 1
PART_BYTES = 1 << 20
BUCKET_ROWS = 1 << 17
# Anchors are single numbers: so many are some 200 MB in every executor.
MAX_BROADCAST_ANCHORS = 2_500_000
# Numbers in the lists of all texts together: 32 MB and what the rows add.
MAX_BROADCAST_SPANS = 4_000_000

_RNG = np.random.default_rng(0x5AFF)
BYTE_VALUES = _RNG.integers(0, 2**64, size=256, dtype=np.uint64) | np.uint64(1)
STEP = int(_RNG.integers(2**40, 2**63)) * 2 + 1
PLACE_BITS = 22
# What a span of windows is: a block, the first of equal blocks, or a repeat.
BLOCK, FIRST, REPEAT = range(3)

KEY = ["late", "doc", "version"]
PLACES = "late int, doc long, version long"
BLOCKS = f"{PLACES}, anchor long, content long, at long"
SUFFIXES = f"{PLACES}, at long, large boolean, suffix binary, before binary"
FOUND = f"{PLACES}, start long, windows int, window binary"


@lru_cache(maxsize=2)
def _step_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(STEP, size), powers(pow(STEP, -1, 2**64), size)


def _least_ahead(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of keys[i : i + n] for every i that has so many."""
    done = 1
    while done < n:
        step = min(done, n - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def blocks_of(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of some texts side by side: text, start, windows, before, anchor, content.

    ``start`` counts from the start of all texts, ``before`` the bytes up to the anchor.
    """
    lengths = np.diff(bounds)
    spans = np.maximum(lengths - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(lengths)), spans)
    if not len(text):
        none = np.zeros(0, dtype=np.int64)
        names = ("text", "start", "windows", "before", "anchor", "content")
        return {name: none for name in names}
    window = np.arange(len(text)) + np.repeat(bounds[:-1] - (np.cumsum(spans) - spans), spans)
    ahead, back = _step_powers(1 << (len(data) + 1).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * ahead[: len(data)], out=sums[1:])
    runs = len(data) - LEAD + 1
    hashes = mixed((sums[LEAD:] - sums[:-LEAD]) * back[:runs])
    low = np.uint64(PLACE_BITS)
    least = _least_ahead((hashes >> low << low) | np.arange(runs, dtype=np.uint64), SPAN)
    place = (least[window] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(window), dtype=bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(text) != 0)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(window)))
    start, place = window[at], place[at]
    end = start + count + WINDOW - 1
    return {
        "text": text[at],
        "start": start,
        "windows": count,
        "before": place - start,
        "anchor": hashes[place].view(np.int64),
        "content": mixed((sums[end] - sums[start]) * back[start]).view(np.int64),
    }


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in turns of some PART_BYTES: rows, offsets, bytes; a longer text is cut so
    that every window is in one part."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(len(text) - WINDOW + 1, 0), PART_BYTES):
            part = text[offset : offset + PART_BYTES + WINDOW - 1]
            rows.append(row)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
            if size >= PART_BYTES:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
    if rows:
        yield rows, offsets, parts


def _bytes_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(c).take(pa.array(rows)) for c in KEY]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for rows, offsets, parts in _parts(_bytes_of(batch)):
            bounds = np.cumsum([0, *map(len, parts)])
            found = blocks_of(np.frombuffer(b"".join(parts), dtype=np.uint8), bounds)
            text = found["text"]
            start = found["start"] - bounds[text] + np.array(offsets)[text]
            at = start << 14 | found["windows"] << 7 | found["before"]
            yield pa.RecordBatch.from_arrays(
                [*_keys(batch, np.array(rows)[text]), pa.array(found["anchor"]),
                 pa.array(found["content"]), pa.array(at)],
                names=_names(BLOCKS),
            )


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, places, large, suffix, before = [], [], [], [], []
        lists = batch.column("blocks").to_pylist()
        for row, (text, blocks) in enumerate(zip(_bytes_of(batch), lists)):
            for code in blocks:
                at = code >> 1
                start, windows, ahead = at >> 14, at >> 7 & 127, at & 127
                content = text[start : start + windows + WINDOW - 1]
                rows.append(row)
                places.append(at)
                large.append(bool(code & 1))
                suffix.append(content[ahead:])
                before.append(content[:ahead][::-1])
        yield pa.RecordBatch.from_arrays(
            [*_keys(batch, np.array(rows, dtype=np.int64)), pa.array(places, pa.int64()),
             pa.array(large, pa.bool_()), pa.array(suffix, pa.binary()), pa.array(before, pa.binary())],
            names=_names(SUFFIXES),
        )


def _matrix(strings: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes filled up with zeros, and their lengths."""
    parts = strings.to_pylist()
    lengths = np.array([len(s) for s in parts], dtype=np.int64)
    out = np.zeros((len(lengths), width), dtype=np.uint8)
    column = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    out[np.repeat(np.arange(len(lengths)), lengths), column] = data
    return out, lengths


def multikey_order(
    rows: np.ndarray, lengths: np.ndarray, runs: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings, and how many bytes each shares with the one before it.

    Multikey quicksort on eight bytes at a time, all runs in one step: rows alike so
    far are parted by the next eight bytes, and only runs of more than one go on.
    ``runs`` parts the rows beforehand; the first of a run shares -1.
    """
    n = len(rows)
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    runs = np.zeros(n, dtype=np.int64) if runs is None else runs
    order = np.argsort(runs, kind="stable")
    alike = np.zeros(n, dtype=bool)
    alike[1:] = runs[order[1:]] == runs[order[:-1]]
    shared = np.full(n, -1, dtype=np.int64)

    def part(values: np.ndarray, says) -> None:
        """Sorts every run by ``values`` of its rows, and splits it where they differ."""
        open_ = alike.copy()
        open_[:-1] |= alike[1:]
        at = np.flatnonzero(open_)
        if not len(at):
            return
        run = np.cumsum(~alike[at])
        own = values[order[at]]
        inner = np.lexsort((own, run))
        order[at], own = order[at][inner], own[inner]
        split = np.flatnonzero((own[1:] != own[:-1]) & alike[at[1:]])
        shared[at[1:][split]] = says(own[split], own[split + 1])
        alike[at[1:][split]] = False

    for depth in range(words.shape[1]):
        part(words[:, depth], lambda a, b: 8 * depth + _shared_bytes(a ^ b))
    part(lengths, np.minimum)
    shared[alike] = lengths[order[alike]]
    within = shared >= 0
    within[:1] = False
    pair = np.minimum(lengths[order], np.roll(lengths[order], 1))
    shared[within] = np.minimum(shared, pair)[within]
    return order, shared


def _shared_bytes(differing: np.ndarray) -> np.ndarray:
    count = np.zeros(len(differing), dtype=np.int64)
    for k in range(1, 8):
        count += differing < np.uint64(1 << (64 - 8 * k))
    return count


def _classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """Rows numbered so that those with the same first ``length`` bytes have one number."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(shared < length)
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: repeated windows inside it, and windows that may go on beside it."""
    waiting = [b for b in batches if b.num_rows]
    if not waiting:
        return
    table = pa.Table.from_batches(waiting).combine_chunks()
    suffix, after = _matrix(table.column("suffix").chunk(0), 104)
    before, ahead = _matrix(table.column("before").chunk(0), 72)
    keys = [table.column(c).to_numpy() for c in KEY]
    at = table.column("at").to_numpy()
    large = table.column("large").to_numpy()
    anchor = (at >> 14) + (at & 127)
    rank = np.lexsort((anchor, *reversed(keys)))
    by_suffix = multikey_order(suffix, after)
    by_before = multikey_order(before, ahead, _classes(*by_suffix, LEAD))
    repeated = np.zeros((len(at), SPAN + 2), dtype=bool)
    open_rows, open_ahead = [], []
    for o in range(SPAN):
        right, left = _classes(*by_suffix, WINDOW - o), _classes(*by_before, o)
        rows = rank[((ahead >= o) & (after >= WINDOW - o))[rank]]
        if not len(rows):
            continue
        same = right[rows] * (len(at) + 1) + left[rows]
        inner = np.argsort(same, kind="stable")
        rows, same = rows[inner], same[inner]
        first = np.ones(len(rows), dtype=bool)
        first[1:] = same[1:] != same[:-1]
        repeated[rows[~first], o + 1] = True
        edge = rows[first & large[rows] & ((right[rows] == 1) | (right[rows] == right.max()))]
        open_rows.append(edge)
        open_ahead.append(np.full(len(edge), o))
    change = np.diff(repeated.astype(np.int8), axis=1)
    row, low = np.nonzero(change == 1)
    high = np.nonzero(change == -1)[1]
    none = pa.nulls(len(row), pa.binary())
    yield _found(keys, row, anchor[row] - (high - 1), high - low, none)
    row, o = np.concatenate(open_rows), np.concatenate(open_ahead)
    for i in range(0, len(row), 1 << 14):
        r, a = row[i : i + (1 << 14)], o[i : i + (1 << 14)]
        both = np.concatenate((before[:, : SPAN - 1][r][:, ::-1], suffix[r][:, :WINDOW]), axis=1)
        columns = (SPAN - 1 - a)[:, None] + np.arange(WINDOW)
        strings = np.take_along_axis(both, columns, axis=1)
        windows = pa.array([s.tobytes() for s in strings], pa.binary())
        yield _found(keys, r, anchor[r] - a, np.ones(len(r)), windows)


def _found(keys, row, start, windows, window) -> pa.RecordBatch:
    arrays = [pa.array(k[row]) for k in keys]
    arrays += [pa.array(start), pa.array(windows.astype(np.int32)), window]
    return pa.RecordBatch.from_arrays(arrays, names=_names(FOUND))


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows, every text of an id once), with columns late, doc, version, doc_id, text.

    Ids that are null come last. Rows that share an id are told apart by a hash of
    their text; if none do, the hash is left out and no row has to be looked for twice.
    """
    late, doc = F.col("doc_id").isNull().cast("int"), F.coalesce("doc_id", F.lit(0).cast("long"))
    keyed = docs.select(late.alias("late"), doc.alias("doc"), "doc_id", "text")
    if keyed.groupBy("late", "doc").count().filter("count > 1").isEmpty():
        keyed = keyed.withColumn("version", F.lit(0).cast("long"))
        return keyed, keyed
    keyed = keyed.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    return keyed, keyed.dropDuplicates(KEY)


def _attach(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Texts with a list of theirs; broadcast if all the lists are short enough."""
    column = next(c for c in lists.columns if c not in KEY)
    total = lists.agg(F.sum(F.size(column))).first()[0] or 0
    return texts.join(F.broadcast(lists) if total <= MAX_BROADCAST_SPANS else lists, KEY, how)


def spans_of_windows(texts: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``texts`` (late, doc, version, text) to late, doc, version, span.

    A span is a block some of whose bytes are repeated, the first of equal blocks, or
    windows that start earlier too; a block that is not the first is repeated in full.
    """
    blocks = stored(texts.mapInArrow(_blocks, BLOCKS), "byte-blocks")
    anchors = stored(
        blocks.groupBy("anchor").count().filter("count > 1").select("anchor"), "byte-anchors"
    )
    several = stored(
        blocks.join(sized(anchors, MAX_BROADCAST_ANCHORS), "anchor", "left_semi"), "byte-several"
    )
    index = stored(
        several.groupBy("anchor", "content").agg(F.min(F.struct(*KEY, "at")).alias("first")),
        "byte-index",
    )
    mixed_anchors = stored(
        index.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "byte-mixed"
    )
    large = F.col("n") > bucket_rows
    lists = stored(
        index.join(sized(mixed_anchors), "anchor")
        .select("first.*", large.cast("long").alias("large"))
        .groupBy(*KEY)
        .agg(F.collect_list(F.shiftleft("at", 1) + F.col("large")).alias("blocks")),
        "byte-open",
    )
    suffixes = stored(
        _attach(texts, lists, "inner").select(*KEY, "text", "blocks").mapInArrow(_suffixes, SUFFIXES),
        "suffixes",
    )
    buckets = max(1, -(-suffixes.count() // bucket_rows))
    whole = [F.when(F.col("large"), F.col(c)) for c in ("suffix", *KEY, "at")]
    found = stored(
        suffixes.repartitionByRange(buckets, F.substring("suffix", 1, LEAD), *whole)
        .mapInArrow(_windows, FOUND),
        "byte-windows",
    )
    edges = found.filter("window is not null")
    spot = F.struct(*KEY, "start")
    firsts = stored(
        edges.groupBy("window").agg(F.min(spot).alias("first"), F.count("*").alias("n"))
        .filter("n > 1").select("window", "first"),
        "byte-edges",
    )
    across = edges.join(sized(firsts), "window").filter(spot != F.col("first"))
    start, windows = F.shiftright("at", 14), F.shiftright("at", 7).bitwiseAND(127)
    return (
        several.select(*KEY, _span(start, windows, BLOCK))
        .unionByName(index.select("first.*").select(*KEY, _span(start, windows, FIRST)))
        .unionByName(
            found.filter("window is null").unionByName(across.select(found.columns))
            .select(*KEY, _span(F.col("start"), F.col("windows"), REPEAT))
        )
    )


def _span(start, windows, kind: int):
    """start, windows and kind as one number."""
    return (F.shiftleft(start, 9) + F.shiftleft(windows.cast("long"), 2) + kind).alias("span")


LISTS = f"{PLACES}, runs array<struct<low: bigint, high: bigint>>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of windows of a text to the runs of bytes they cover."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for batch in slices(batches):
        merged = []
        for spans in batch.column("spans"):
            codes = spans.values.to_numpy()
            low, kind_of = codes >> 9, codes & 3
            gone = (kind_of == REPEAT) | (
                (kind_of == BLOCK) & ~np.isin(low, low[kind_of == FIRST])
            )
            if not gone.any():
                merged.append([])
                continue
            low = low[gone]
            high = low + (codes[gone] >> 2 & 127) + WINDOW - 1
            order = np.argsort(low, kind="stable")
            low, reach = low[order], np.maximum.accumulate(high[order])
            new = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
            ends = np.append(new[1:], len(low)) - 1
            merged.append([{"low": int(a), "high": int(b)} for a, b in zip(low[new], reach[ends])])
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in KEY], pa.array(merged, kind)], names=_names(PLACES) + ["runs"]
        )


def _cut(digest: bool, schema: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, runs in zip(_bytes_of(batch), batch.column("runs").to_pylist()):
                edges = [0, *[e for run in runs or () for e in (run["low"], run["high"])], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), len(runs or ()),
                             hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [pa.int64()] * 3 + [pa.string() if digest else pa.binary()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=_names(schema),
            )

    return read


def without_repeated_bytes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: bool = False,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept.

    ``kept`` are the UTF-8 bytes that stay, or their SHA-256: a byte goes if a string of
    100 bytes around it also starts earlier, in a text with a smaller id or further to
    the front of its own. Matches never cross texts, and what may be cut in two is a
    character, so ``kept`` is binary. Null and empty texts have no bytes; texts under
    100 bytes lose none. Texts of a null id come after all others; texts that share an
    id go by a hash of their text, and rows equal in both are one text, with one result.
    An empty table gives no rows; other columns are not read.
    """
    keyed, distinct = _keyed(id_and_text(docs, id_column, text_column))
    spans = spans_of_windows(distinct.select(*KEY, "text"), bucket_rows)
    lists = stored(
        spans.groupBy(*KEY).agg(F.collect_list("span").alias("spans")).mapInArrow(_runs, LISTS),
        "byte-runs",
    )
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"
    return (
        _attach(keyed, lists, "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(_cut(digest, schema), schema)
    )
