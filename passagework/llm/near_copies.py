"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are found by operator 3: SimHashes of the shingles that differ in few bits meet in
the shards of a vantage-point tree. Pairs near the bound differ in more bits than its shards
can bear (4 to 14 were measured), so MinHash stands beside it: the least values of ``BANDS * ROWS`` hash functions
are cut into bands, and texts that share a band in full are linked. Two texts at
similarity s share none with probability (1 - s^4)^40, under 1e-9 at 0.8. Candidates
only bring texts together: inside a group of linked ones the shingles themselves are
compared, and only pairs that are that similar count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm import simhash
from passagework.llm.common import free_names, sized, slices, stored, texts_of
from passagework.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 4
HASH_SEED = 42
FINGERPRINT_BITS = 3
# Rows of a candidate group, and characters, that one task compares with as many others.
BLOCK_ROWS = 512
BLOCK_CHARS = 1 << 22
_STEP = 512


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, words: int = SHINGLE_WORDS) -> set[bytes]:
    """Runs of ``words`` words; a shorter text is one shingle, one without words has none."""
    tokens = words_of(text)
    if len(tokens) < words:
        return {b" ".join(tokens)} if tokens else set()
    return set(map(b" ".join, zip(*[tokens[i:] for i in range(words)])))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """One number per run of words: word hashes, summed up with odd weights and mixed."""
    import xxhash

    tokens = words_of(text)
    digest = partial(xxhash.xxh64_intdigest, seed=HASH_SEED)
    own = np.fromiter(map(digest, tokens), dtype=np.uint64, count=len(tokens))
    runs = max(1, len(own) - words + 1) if len(own) else 0
    total = np.zeros(runs, dtype=np.uint64)
    for i in range(min(words, len(own))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + own[i : i + runs]
    return _mixed(total)


def hash_functions() -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd weight for each."""
    shape = (2, BANDS * ROWS, 1)
    masks, weights = np.random.default_rng(0xBA2D).integers(0, 2**64, size=shape, dtype=np.uint64)
    return masks, weights | np.uint64(1)


def band_keys(hashes: np.ndarray, masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One key per band, of the least values of its hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(hashes), _STEP):
        values = (hashes[None, start : start + _STEP] ^ masks) * weights
        np.minimum(least, values.min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def _bands(words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = hash_functions()
        for batch in slices(batches):
            nodes = batch.column("node").to_numpy()
            rows, keys = [], []
            for node, text in zip(nodes, texts_of(batch)):
                hashes = shingle_hashes(text, words)
                if len(hashes):
                    rows.append(node)
                    keys.append(band_keys(hashes, *functions))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)),
                     pa.array(np.repeat(np.array(rows, dtype=np.int64), BANDS))],
                    names=["key", "node"],
                )

    return read


def candidates(rows: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """``rows`` (node, text) to (node, root): groups linked by near SimHashes or a shared band.

    Texts that share a band are linked to the least of them, which spans the same
    group as all pairs would. Texts that share none give no row.
    """
    keyed = stored(rows.mapInArrow(_bands(words), "key long, node long"), "bands")
    shared = stored(
        keyed.groupBy("key")
        .agg(F.min("node").alias("root"), F.max("node").alias("last"))
        .filter("root <> last")
        .select("key", "root"),
        "shared",
    )
    links = keyed.join(sized(shared), "key").filter("node <> root")
    banded = links.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(near_fingerprints(rows, words).unionAll(banded))


def near_fingerprints(rows: DataFrame, words: int, max_bits: int = FINGERPRINT_BITS) -> DataFrame:
    """``rows`` (node, text) to links (a, b) of texts whose SimHashes are near, by operator 3.

    Equal fingerprints are linked to the least of their nodes. Fingerprint zero, that of
    texts without words, links nothing.
    """
    found = stored(
        simhash.fingerprints(rows.select(F.col("node").alias("doc_id"), "text"), words)
        .filter("fp <> 0"),
        "fingerprints",
    )
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    equal = found.join(distinct, "fp").filter("doc_id <> first")
    return simhash.fingerprint_links(distinct, max_bits).unionAll(
        equal.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    )


def _similar(words: int, similarity: float):
    """Links that span, in a block of rows, the components of the pairs similar enough.

    From a row only those not reached so far are compared, so a group of copies of
    one text costs little more than one pass.
    """

    def link(table: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        sets = [
            np.array([numbers.setdefault(s, len(numbers)) for s in shingles(t or "", words)])
            for t in table.column("text").to_pylist()
        ]
        rows = table.column("row").to_numpy()
        sizes = np.array([len(s) for s in sets])
        own = np.zeros(len(numbers), dtype=bool)
        waiting, found = np.arange(len(sets)), []
        while len(waiting):
            queue, waiting = [waiting[0]], waiting[1:]
            while queue and len(waiting):
                pivot = queue.pop()
                low = np.minimum(sizes[waiting], sizes[pivot])
                near = waiting[low >= similarity * np.maximum(sizes[waiting], sizes[pivot])]
                own[sets[pivot]] = True
                common = np.array([own[sets[i]].sum() for i in near], dtype=np.int64)
                own[sets[pivot]] = False
                reached = near[common >= similarity * (sizes[near] + sizes[pivot] - common)]
                found += [(rows[pivot], rows[i]) for i in reached]
                queue += reached.tolist()
                waiting = np.setdiff1d(waiting, reached, assume_unique=True)
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def similar_links(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """``members`` (root, row, text) to links (a, b) of their ``row`` numbers.

    A group of many rows, or of long texts, is cut into blocks, and every two blocks
    meet in one task.
    """
    needed = F.greatest(F.count("*") / BLOCK_ROWS, F.sum(F.length("text")) / BLOCK_CHARS)
    blocks = stored(
        members.groupBy("root").agg(F.ceil(needed).cast("int").alias("blocks")), "blocks"
    )
    own, other = F.col("block"), F.col("other")
    dealt = (
        members.join(sized(blocks), "root")
        .withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least(own, other).alias("low"), F.greatest(own, other).alias("high"),
                "row", "text")
    )
    return dealt.groupBy("root", "low", "high").applyInArrow(
        _similar(words, similarity), "a long, b long"
    )


def one_per_group(
    docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns as they are.

    Rows are linked if their shingles have a Jaccard similarity of ``similarity`` or
    more; of all rows linked directly or by others the one with the smallest id stays
    (null ids last, then by a hash of the text). Every row has its own fate by id and
    text, a null id too; rows equal in both stay or go together. Case and white space
    do not count; texts without words stay. An empty table gives no rows.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    node = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("node")
    roots = stored(candidates(docs.select(node, "text"), words), "candidates")
    members = stored(
        docs.select("doc_id", "text", node)
        .join(sized(roots), "node")
        .select("root", "doc_id", digest.alias("digest"), "text",
                F.monotonically_increasing_id().alias("row")),
        "members",
    )
    groups = components(similar_links(members, words, similarity))
    linked = stored(
        members.select(F.col("row").alias("node"), "doc_id", "digest").join(
            groups.select("node", F.col("root").alias("group")), "node"
        ),
        "linked",
    )
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    best = stored(linked.groupBy("group").agg(F.min(order).alias("best")), "best")
    key_id, key_digest = free_names(docs, "_key_id", "_key_digest")
    dropped = stored(
        linked.join(sized(best), "group")
        .filter(order != F.col("best"))
        .select(F.col("doc_id").alias(key_id), F.col("digest").alias(key_digest))
        .distinct(),
        "dropped",
    )
    same = docs["doc_id"].eqNullSafe(F.col(key_id)) & (digest == F.col(key_digest))
    return docs.join(sized(dropped), same, "left_anti")
