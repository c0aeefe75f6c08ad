"""Exact duplicates: sorted, Golomb-coded fingerprints meet at their owners.

Each sender (a bounded run of rows of one task) sorts the distinct fingerprints
of its rows and sends them, coded, to the owners of the fingerprint ranges. An
owner answers every message with a bitmap of the fingerprints that more than one
row has. Only the texts behind the marked fingerprints are shuffled, and their
bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import SPACE_CLASS, free_names, sized, stored

FINGERPRINT_BITS = 48
SENDER_ROWS = 1 << 20
OWNER_ROWS = 1 << 20
MESSAGE = "sender long, owner int, n int, low_bits int, low binary, high binary, repeated binary"


def normalised(text: str | Column) -> Column:
    """The text without white space of the contract; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(column, F.lit("")), SPACE_CLASS, "")


def fingerprint(norm: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - FINGERPRINT_BITS)


def golomb_encode(values: np.ndarray, span: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct numbers in [0, span) as (parameter, remainders, quotients).

    Gaps are split at a power of two near their mean: the remainders are packed
    side by side, the quotients stand in unary in a second run of bits, so both
    are read without a loop over values.
    """
    if len(values) == 0:
        return 0, b"", b""
    gaps = np.diff(values.astype(np.int64), prepend=np.int64(-1)) - 1
    low_bits = max(0, int(span // len(values)).bit_length() - 1)
    low = gaps & ((1 << low_bits) - 1)
    planes = (low[:, None] >> np.arange(low_bits, dtype=np.int64)) & 1
    ends = np.cumsum((gaps >> low_bits) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    return (
        low_bits,
        np.packbits(planes.astype(np.uint8).ravel()).tobytes(),
        np.packbits(unary).tobytes(),
    )


def golomb_decode(n: int, low_bits: int, low: bytes, high: bytes) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, dtype=np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, dtype=np.uint8), count=n * low_bits)
    weights = np.int64(1) << np.arange(low_bits, dtype=np.int64)
    low_values = bits.reshape(n, low_bits).astype(np.int64) @ weights
    return np.cumsum(((quotients << low_bits) | low_values) + 1) - 1


def _sender(owner_bits: int):
    shift = FINGERPRINT_BITS - owner_bits

    def messages(values: np.ndarray, sender: int) -> pa.RecordBatch:
        distinct, counts = np.unique(values, return_counts=True)
        owners = distinct >> shift
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        rows = []
        for start, end in zip(cuts, [*cuts[1:], len(distinct)]):
            owner = int(owners[start])
            code = golomb_encode(distinct[start:end] - (owner << shift), 1 << shift)
            repeated = np.packbits(counts[start:end] > 1).tobytes()
            rows.append((sender, owner, int(end - start), *code, repeated))
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        columns = list(zip(*rows)) or [[]] * len(types)
        names = [field.split()[0] for field in MESSAGE.split(", ")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId() << 32
        waiting, rows = [], 0
        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False))
            rows += batch.num_rows
            if rows >= SENDER_ROWS:
                yield messages(np.concatenate(waiting), sender)
                sender, waiting, rows = sender + 1, [], 0
        if rows:
            yield messages(np.concatenate(waiting), sender)

    return send


def _decoded(table: pa.Table) -> list[np.ndarray]:
    columns = [table.column(c).to_pylist() for c in ("n", "low_bits", "low", "high")]
    return [golomb_decode(*row) for row in zip(*columns)]


def _reply(table: pa.Table) -> pa.Table:
    """Bitmaps for the messages of one owner."""
    lists = _decoded(table)
    flags = [
        np.unpackbits(np.frombuffer(r, dtype=np.uint8), count=len(v))
        for r, v in zip(table.column("repeated").to_pylist(), lists)
    ]
    values, inverse, counts = np.unique(
        np.concatenate(lists), return_inverse=True, return_counts=True
    )
    many = counts > 1
    many[inverse[np.concatenate(flags).astype(bool)]] = True
    bounds = np.cumsum([0, *map(len, lists)])
    bitmaps = [np.packbits(many[inverse[a:b]]).tobytes() for a, b in zip(bounds, bounds[1:])]
    return pa.table(
        {
            "sender": table.column("sender"),
            "owner": table.column("owner"),
            "bitmap": pa.array(bitmaps, pa.binary()),
        }
    )


def _marked(owner_bits: int):
    shift = FINGERPRINT_BITS - owner_bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists = zip(_decoded(table), table.column("owner").to_pylist())
            found = [
                (v + (owner << shift))[np.unpackbits(np.frombuffer(m, np.uint8), count=len(v)) > 0]
                for (v, owner), m in zip(lists, table.column("bitmap").to_pylist())
            ]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["fp"])

    return read


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """The distinct values of a column ``fp`` that more than one row has."""
    owner_bits = max(0, (max(n_rows, 1) // OWNER_ROWS).bit_length())
    messages = stored(
        fingerprints.select("fp").mapInArrow(_sender(owner_bits), MESSAGE), "messages"
    )
    replies = messages.groupBy("owner").applyInArrow(
        _reply, "sender long, owner int, bitmap binary"
    )
    answered = messages.drop("repeated").join(replies, ["sender", "owner"])
    return answered.mapInArrow(_marked(owner_bits), "fp long").distinct()


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, fp, n_chars.

    Texts are equal when they are identical without the white space of
    ``[\\x20\\x09-\\x0D]``; null counts as empty, and empty texts equal each other.
    Of equal texts the row with the most code points stays, then the smallest id
    (null ids last), then one of the identical rows. ``kept`` is true for that one
    row. An empty table gives no rows; other columns are not read.
    """
    norm = normalised(text_column)
    signatures = stored(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.sha2(norm, 256).alias("text_sha256"),
            fingerprint(norm).alias("fp"),
            F.char_length(F.coalesce(text_column, F.lit(""))).alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "signatures",
    )
    suspects = sized(stored(repeated_fingerprints(signatures, signatures.count()), "suspects"))
    verified = stored(
        docs.select(norm.alias("norm"), fingerprint(norm).alias("fp"))
        .join(suspects, "fp", "left_semi")
        .groupBy("norm")
        .agg(F.count("*").alias("rows"))
        .groupBy(F.sha2("norm", 256).alias("text_sha256"))
        .agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"))
        .filter("rows > 1"),
        "verified",
    )
    if not verified.filter("texts > 1").isEmpty():
        raise RuntimeError("two different texts have one SHA-256")
    order = F.struct(
        (-F.col("n_chars")).alias("shorter"),
        F.col("doc_id").isNull().alias("unknown"),
        F.col("doc_id").alias("id"),
        F.col("row").alias("row"),
    )
    groups = stored(
        signatures.join(suspects, "fp", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
        .join(verified.select("text_sha256"), "text_sha256", "left_semi"),
        "groups",
    )
    single = F.col("best").isNull()
    return signatures.join(sized(groups), "text_sha256", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"),
        "text_sha256",
        "fp",
        "n_chars",
    )


def without_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns as they are.

    Of each group of equal texts one row stays. Where several rows of a group share the
    id and the length of the one to stay, any one of them does.
    """
    fields = ["doc_id", "fp", "n_chars"]
    found = exact_duplicates(docs, id_column, text_column).filter("group_size > 1")
    keys = stored(
        found.groupBy(*fields)
        .agg(F.count("*").alias("rows"), F.max("kept").alias("any_kept"))
        .filter("not any_kept or rows > 1"),
        "dropped",
    )
    norm = normalised(text_column)
    *key_names, norm_name = free_names(docs, *[f"_key_{f}" for f in fields], "_norm")

    def matching(rows: DataFrame, kind: str) -> DataFrame:
        own = [docs[id_column], fingerprint(norm),
               F.char_length(F.coalesce(text_column, F.lit("")))]
        keys_side = rows.select(*[F.col(f).alias(k) for f, k in zip(fields, key_names)])
        return docs.join(keys_side, [o.eqNullSafe(F.col(k)) for o, k in zip(own, key_names)], kind)

    kept = matching(sized(keys), "left_anti")
    twice = keys.filter("any_kept")
    if twice.isEmpty():
        return kept
    # Rows alike in these may differ in their white space only: the text without it decides.
    once = matching(sized(twice), "left_semi").withColumn(norm_name, norm)
    return kept.unionByName(once.dropDuplicates([id_column, norm_name]).drop(norm_name))
