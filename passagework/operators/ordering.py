"""Seeded order, exact positions, splits and unions without a global window.

The order of a row is the MD5 of ``seed:key``: it does not depend on how the
data is partitioned, and a lost task recomputes the same one. Hashes are cut
into 65,536 buckets by their first digits. One small table of bucket totals, at
most that many rows, turns positions within buckets into global positions, so
no task ever sees more than a bucket. ``key`` has to identify a row.

Where even a bucket is too much for a task, ``bucket_rows`` bounds it: buckets are then
cut by the next digits, level by level, until the largest is below the bound. Each level
has its own table of totals, summed up inside the buckets of the level above.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework.functions.fixed_values import DEFAULT_TEST_SHARE, SPLIT_SEED
from passagework.functions.text import md5_int

BUCKET_DIGITS = 4  # 16 ** 4 buckets bound the table of totals
HASH_DIGITS = 32


def order_hash(key: str, seed: int = SPLIT_SEED) -> Column:
    return F.md5(_seeded(key, seed))


def _seeded(key: str, seed: int) -> Column:
    return F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Add the order hash and its first digits, which sort like the hash itself."""
    hashed = df.withColumn("_hash", order_hash(key, seed))
    return hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS))


def bucket_offsets(hashed: DataFrame, amount: Column) -> DataFrame:
    """Per bucket the total of ``amount`` in it and in all buckets before it.

    The window has no partition key, but its input is the table of totals,
    never larger than the number of buckets.
    """
    totals = hashed.groupBy("_bucket").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))


def _levels(hashed: DataFrame, bucket_rows: int | None) -> int:
    """How many times BUCKET_DIGITS digits part the rows finely enough."""
    levels, most = 1, HASH_DIGITS // BUCKET_DIGITS
    while bucket_rows is not None and levels < most:
        prefix = F.substring("_hash", 1, BUCKET_DIGITS * levels)
        largest = hashed.groupBy(prefix).count().agg(F.max("count")).first()[0] or 0
        if largest <= bucket_rows:
            break
        levels += 1
    return levels


def _refined_offsets(hashed: DataFrame, levels: int) -> DataFrame:
    """Offsets of the finest buckets: those of the level above, and what lies before in it."""
    offsets = bucket_offsets(hashed, F.col("_amount")).select("_bucket", "_before")
    for level in range(2, levels + 1):
        finer = F.substring("_hash", 1, BUCKET_DIGITS * level)
        totals = hashed.groupBy(finer.alias("_finer")).agg(F.sum("_amount").alias("_total"))
        above = F.substring("_finer", 1, BUCKET_DIGITS * (level - 1))
        earlier = (
            Window.partitionBy("_bucket").orderBy("_finer")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        inside = F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_inside")
        own = totals.withColumn("_bucket", above).select("_bucket", "_finer", inside)
        offsets = own.join(offsets, "_bucket").select(
            F.col("_finer").alias("_bucket"), (F.col("_before") + F.col("_inside")).alias("_before")
        )
    return offsets


def running_total(
    df: DataFrame,
    key: str,
    amount: Column,
    seed: int = SPLIT_SEED,
    out: str = "start",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add the sum of ``amount`` over all rows before this one in the seeded order.

    ``bucket_rows`` bounds the rows that a task ranks; it costs a count per level.
    """
    hashed = _hashed(df.withColumn("_amount", amount.cast("bigint")), key, seed)
    light = _hashed(df.select(key, amount.cast("bigint").alias("_amount")), key, seed)
    levels = _levels(light, bucket_rows)
    offsets = _refined_offsets(light, levels)
    if levels == 1:
        offsets = F.broadcast(offsets)  # as many rows as first digits at most
    else:
        hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, BUCKET_DIGITS * levels))
    earlier = (
        Window.partitionBy("_bucket")
        .orderBy("_hash", key)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    within = F.coalesce(F.sum("_amount").over(earlier), F.lit(0))
    return (
        hashed.join(offsets, "_bucket")
        .withColumn(out, F.col("_before") + within)
        .drop("_hash", "_bucket", "_amount", "_before")
    )


def global_position(
    df: DataFrame,
    key: str,
    seed: int = SPLIT_SEED,
    out: str = "position",
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add the row's place, from 0 and without gaps, in the seeded order."""
    return running_total(df, key, F.lit(1), seed, out, bucket_rows)


def seeded_shuffle(
    df: DataFrame,
    key: str,
    seed: int = SPLIT_SEED,
    position: str | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """The rows in seeded random order.

    With ``position`` the order is added as a column instead of sorting, which
    survives writing and reading.
    """
    if position is not None:
        return global_position(df, key, seed, position, bucket_rows)
    return df.orderBy(order_hash(key, seed), key)


def train_test_split(
    df: DataFrame,
    key: str,
    test_size: float = DEFAULT_TEST_SHARE,
    seed: int = SPLIT_SEED,
    exact: bool = True,
) -> DataFrame:
    """Add ``split``: the first ``ceil(n * test_size)`` rows of the seeded order
    are ``test``, the others ``train``.

    ``exact=False`` cuts the hash range itself, without looking at the data, and
    hits the share only approximately.
    """
    if exact:
        return train_test_splits(df, key, {"split": test_size}, seed)
    _check_share(test_size)
    share = md5_int(_seeded(key, seed), 8) / F.lit(float(16**8))
    return df.withColumn("split", F.when(share < test_size, "test").otherwise("train"))


def train_test_splits(
    df: DataFrame, key: str, shares: Mapping[str, float], seed: int = SPLIT_SEED
) -> DataFrame:
    """Several exact splits of one order: a column per name in ``shares``.

    The keys are read twice now, whatever the number of shares: for the bucket
    totals, which tell the buckets the cuts fall into, and for the rows at the
    cuts, ranked within those buckets. What is returned compares each row with
    the hash and key at each cut, so it moves no rows. A row without a key is
    ``train``.
    """
    for share in shares.values():
        _check_share(share)
    keys = _hashed(df.select(key).where(F.col(key).isNotNull()), key, seed)
    before = dict(keys.groupBy("_bucket").count().orderBy("_bucket").collect())
    total, places, passed = sum(before.values()), {}, 0
    wanted = {name: math.ceil(total * share) for name, share in shares.items()}
    for bucket, n in before.items():
        for name, n_test in wanted.items():
            if passed < n_test <= passed + n:
                places[name] = (bucket, n_test - passed)
        passed += n
    ranked = keys.where(F.col("_bucket").isin(sorted({b for b, _ in places.values()}))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key))
    )
    at_cut = F.lit(False)
    for bucket, rank in places.values():
        at_cut = at_cut | ((F.col("_bucket") == bucket) & (F.col("_rank") == rank))
    cuts = {(r["_bucket"], r["_rank"]): r for r in ranked.where(at_cut).collect()}

    hashed, kind = df.withColumn("_hash", order_hash(key, seed)), df.schema[key].dataType
    for name in shares:
        in_test = F.lit(False)
        if name in places:
            cut = cuts[places[name]]
            in_test = (F.col("_hash") < cut["_hash"]) | (
                (F.col("_hash") == cut["_hash"]) & (F.col(key) <= F.lit(cut[key]).cast(kind))
            )
        hashed = hashed.withColumn(name, F.when(in_test, "test").otherwise("train"))
    return hashed.drop("_hash")


def _check_share(share: float) -> None:
    if not 0.0 < share < 1.0:
        raise ValueError("test_size must lie between 0 and 1")


def concat_datasets(tag: str | None = "dataset", **datasets: DataFrame) -> DataFrame:
    """Datasets below each other, duplicates kept, each tagged with its name."""
    out = None
    for name, df in datasets.items():
        df = df.withColumn(tag, F.lit(name)) if tag else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no datasets")
    return out
