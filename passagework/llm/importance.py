"""Quality by importance resampling.

Two generative models over hashed word n-grams, of a target text and of all raw
text, give every document an importance weight, the log ratio of their
probabilities; Gumbel noise hashed from the id and a global top-k then sample
documents without replacement, in proportion to their weights.

The plain ratio multiplies over all n-grams of a text, so long texts have ratios far
beyond any noise and their length decides. With ``run_grams`` a document is weighed by
the mean log ratio of its n-grams times that number: what is sampled in proportion is
then the ratio a text of so many n-grams would have. None takes the plain ratio.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import id_and_text, sized, slices, stored, texts_of
from passagework.llm.mixing import hashed_uniform
from passagework.llm.substring_dedup import mixed, words_of

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
RUN_GRAMS = 100
BINS = 4096
RANKED_ROWS = 10_000


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of the words and word pairs of some texts, lower-cased."""
    words, bounds = words_of([t.lower().encode("utf-8") for t in texts])
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = np.flatnonzero(text[1:] == text[:-1])
    pairs = mixed(words[pair] * np.uint64(0x9E3779B97F4A7C15) + words[pair + 1])
    grams = np.concatenate((words, pairs)) >> np.uint64(64 - BUCKET_BITS)
    return grams.astype(np.int64), np.concatenate((text, text[pair]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in slices(batches):
        grams, text = grams_of(texts_of(batch))
        target = batch.column("target").to_numpy(zero_copy_only=False)[text]
        total[0] += np.bincount(grams, minlength=BUCKETS)
        total[1] += np.bincount(grams[target], minlength=BUCKETS)
    bucket = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int32)), *[pa.array(t[bucket]) for t in total]],
        names=["bucket", "raw", "target"],
    )


def log_ratios(docs: DataFrame, target_ids: DataFrame) -> np.ndarray:
    """Log of target over raw probability per bucket, from the whole text of all rows."""
    marked = (
        id_and_text(docs)
        .join(sized(target_ids).withColumn("target", F.lit(True)), "doc_id", "left")
        .select("text", F.coalesce("target", F.lit(False)).alias("target"))
    )
    found = marked.mapInArrow(_counts, "bucket int, raw long, target long")
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, target in found.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        counts[:, bucket] = raw, target
    smooth = counts + SMOOTHING
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    return logs[1] - logs[0] if counts[1].any() else np.zeros(BUCKETS)


def _weigh(shared, run_grams: int | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in slices(batches):
            grams, text = grams_of(texts_of(batch))
            count = np.bincount(text, minlength=batch.num_rows)
            total = np.bincount(text, weights=ratio[grams], minlength=batch.num_rows)
            weight = total if run_grams is None else run_grams * total / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(weight)],
                names=["doc_id", "n_grams", "log_weight"],
            )

    return read


def gumbel(seed: str, id_column: str = "doc_id") -> Column:
    """Standard Gumbel noise hashed from seed and id."""
    own = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    uniform = hashed_uniform(F.lit(seed), own) + F.lit(2.0**-53)
    return -F.log(-F.log(uniform))


def kth_largest(keyed: DataFrame, k: int) -> tuple[float, int]:
    """(key, row) of the k-th row by falling ``key`` and then rising ``row``.

    The range of keys that holds it is cut into bins until few rows are left, so
    no task ranks more than these; rows with equal keys are cut by ``row``.
    """
    order = [F.desc("key"), F.asc("row")]
    inside, before = keyed, 0
    for column, falling in (("key", True), ("row", False)):
        while True:
            low, high, n = inside.agg(F.min(column), F.max(column), F.count("*")).first()
            if n <= RANKED_ROWS:
                last = inside.orderBy(*order).limit(k - before).orderBy(
                    F.asc("key"), F.desc("row")
                ).first()
                return last["key"], last["row"]
            width = (high - low) / BINS
            if low == high or low + width == low:
                break
            place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1))
            counts = dict(inside.groupBy(place.alias("bin")).count().collect())
            for bin_ in sorted(counts, reverse=falling):
                if before + counts[bin_] >= k:
                    break
                before += counts[bin_]
            inside = inside.filter(place == bin_)
    raise RuntimeError("rows are not unique")


def resampled(
    docs: DataFrame,
    target_ids: DataFrame,
    share: float,
    seed: str = "quality",
    run_grams: int | None = RUN_GRAMS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_grams, log_weight, key, kept.

    ``target_ids`` (doc_id) names the documents whose text is the target; without
    any of them all weights are zero. ``run_grams`` is the number of n-grams a document
    is weighed by, None for all of its own. ``kept`` marks the ``share`` of rows with the
    largest ``key``, log weight plus noise; of equal keys, as repeated rows have
    them, any rows in the order of the stored table. Null and empty texts have no
    n-grams and log weight zero. Null ids share one noise and are no target. An
    empty table gives no rows.
    """
    own = id_and_text(docs, id_column, text_column)
    ids = stored(target_ids.select("doc_id").filter("doc_id is not null").distinct(), "target")
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(own, ids))
    weighed = own.mapInArrow(
        _weigh(shared, run_grams), "doc_id long, n_grams long, log_weight double"
    )
    keyed = stored(
        weighed.withColumn("key", F.col("log_weight") + gumbel(seed)).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "keys",
    )
    k = round(share * keyed.count())
    if k == 0:
        return keyed.drop("row").withColumn("kept", F.lit(False))
    key, row = kth_largest(keyed.select("key", "row"), k)
    kept = (F.col("key") > key) | ((F.col("key") == key) & (F.col("row") <= row))
    return keyed.withColumn("kept", kept).drop("row")
