"""Near duplicates by SimHash: fingerprints meet in shards of a vantage-point tree.

The upper levels of the tree cut all fingerprints by their distance to one
vantage point per level; the code of the sides is the shard. A link spans at most
``max_bits``, so by the triangle inequality two linked fingerprints can part at a
level only if the inner one lies that near to the boundary: such inner ones are
also sent to the outer side. Two linked fingerprints then meet in the shard where
each level has the outer of their sides. In a shard the tree goes on, with members
as vantage points, down to small blocks that are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, sized, slices, stored, texts_of
from passagework.llm.components import components, unite

HASH_SEED = 42
SHARD_ROWS = 8192
LEAF_ROWS = 128
BLOCK_PAIRS = 1 << 22


def fingerprint_of(text: str, words: int = 3) -> int:
    """The 64-bit fingerprint of one text; zero for a text without words."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    hashes = np.fromiter(
        map(partial(xxhash.xxh64_intdigest, seed=HASH_SEED), shingles), dtype=np.uint64
    )
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint_of(t, words) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(values.view(np.int64))],
                names=["doc_id", "fp"],
            )

    return read


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    return id_and_text(docs).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def vantage_points(depth: int) -> np.ndarray:
    """One fixed 64-bit word per level."""
    return np.random.default_rng(0x5EED).integers(0, 2**64, size=depth, dtype=np.uint64)


def _distances(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(point)).astype(np.int16)


def _histogram(points: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(points), 65), dtype=np.int64)
        for batch in batches:
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for level, point in enumerate(points):
                total[level] += np.bincount(_distances(values, point), minlength=65)
        level, distance = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(level.astype(np.int32)), pa.array(distance.astype(np.int32)),
             pa.array(total[level, distance])],
            names=["level", "distance", "n"],
        )

    return count


def _radius(counts: np.ndarray, max_bits: int) -> int:
    """Of the radii near the median the one with the thinnest band inside it."""
    inside = np.cumsum(counts) / max(1, counts.sum())
    band = np.convolve(counts, np.ones(max_bits, dtype=np.int64))[: len(counts)]
    near = np.flatnonzero((inside >= 0.35) & (inside <= 0.65))
    if len(near) == 0:
        return int(np.argmin(np.abs(inside - 0.5)))
    return int(near[np.argmin(band[near])])


def _shards(points: np.ndarray, radii: list[int], max_bits: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 14):
            values = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.arange(len(values))
            code = np.zeros(len(values), dtype=np.int64)
            for level, (point, radius) in enumerate(zip(points, radii)):
                d = _distances(values, point)[row]
                side = np.int64(1) << level
                code |= np.where(d > radius, side, 0)
                near = (d <= radius) & (d > radius - max_bits)
                row, code = np.append(row, row[near]), np.append(code, code[near] | side)
            yield pa.RecordBatch.from_arrays(
                [pa.array(code), batch.column("fp").take(pa.array(row)),
                 batch.column("first").take(pa.array(row))],
                names=["shard", "fp", "first"],
            )

    return deal


class Linker:
    """Joins the members of one shard that are linked, pair by pair of blocks."""

    def __init__(self, values: np.ndarray, max_bits: int):
        self.values, self.max_bits = values, max_bits
        self.label = np.arange(len(values))

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, BLOCK_PAIRS // max(1, len(b)))
        for start in range(0, len(a), step):
            part = a[start : start + step]
            away = np.bitwise_count(self.values[part][:, None] ^ self.values[b][None, :])
            i, j = np.nonzero(away <= self.max_bits)
            unite(self.label, part[i], b[j])

    def within(self, members: np.ndarray, tries: int = 4) -> None:
        """All links among ``members``."""
        if len(members) <= LEAF_ROWS:
            return self.compare(members, members)
        for t in range(tries):
            d = _distances(self.values[members], self.values[members[t * len(members) // tries]])
            radius = _radius(np.bincount(d, minlength=65), self.max_bits)
            inner = d <= radius
            if 0.1 < inner.mean() < 0.9:
                self.within(members[inner])
                self.within(members[~inner])
                rim = members[inner & (d > radius - self.max_bits)]
                return self.across(rim, members[~inner & (d <= radius + self.max_bits)])
        self.compare(members, members)

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """All links between two sets, cut by the distance to a member of the first."""
        if len(a) * len(b) <= LEAF_ROWS * LEAF_ROWS:
            return self.compare(a, b)
        point = self.values[a[len(a) // 2]]
        da, db = _distances(self.values[a], point), _distances(self.values[b], point)
        for distance in np.unique(da):
            near = b[np.abs(db - distance) <= self.max_bits]
            if len(near):
                self.compare(a[da == distance], near)


def _linked(max_bits: int):
    def link(table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        first = table.column("first").to_numpy()
        linker = Linker(values, max_bits)
        linker.within(np.arange(len(values)))
        moved = np.flatnonzero(linker.label != np.arange(len(values)))
        return pa.table({"a": first[moved], "b": first[linker.label[moved]]})

    return link


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """``distinct`` (fp, first) to links (a, b) of their ``first`` ids.

    The links span the same components as all pairs at ``max_bits`` differing bits
    or fewer: a shard gives a tree for each of its components, never all pairs.
    """
    rows = distinct.count()
    depth = max(0, (rows // SHARD_ROWS).bit_length())
    points = vantage_points(depth)
    counts = np.zeros((depth, 65), dtype=np.int64)
    if depth:
        found = distinct.select("fp").mapInArrow(
            _histogram(points), "level int, distance int, n long"
        )
        for level, distance, n in found.groupBy("level", "distance").agg(F.sum("n")).collect():
            counts[level, distance] = n
    radii = [_radius(c, max_bits) for c in counts]
    shards = distinct.mapInArrow(
        _shards(points, radii, max_bits), "shard long, fp long, first long"
    )
    return shards.groupBy("shard").applyInArrow(_linked(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id.

    Null texts count as empty; texts without words have fingerprint zero and are
    linked like any other. Equal fingerprints are collapsed before any comparison,
    so copies cost one row. Rows with a null id link with nothing and have a null
    component. Repeated rows come back repeated; an empty table gives no rows.
    """
    found = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(
        found.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")),
        "distinct",
    )
    roots = components(fingerprint_links(distinct, max_bits))
    classes = stored(
        distinct.join(
            roots.select(F.col("node").alias("first"), "root"), "first", "left"
        ).select("fp", F.coalesce("root", "first").alias("component")),
        "classes",
    )
    return found.join(classes, "fp", "left").select(
        "doc_id",
        "fp",
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def hex_fingerprint(column: str = "fp"):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def one_per_group(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component.

    Rows with a null id stay. Rows that share an id have one fate.
    """
    found = near_duplicates(docs, words, max_bits)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    dropped = stored(dropped.join(kept, "doc_id", "left_anti"), "dropped")
    return docs.join(sized(dropped), "doc_id", "left_anti")
