"""Toxicity by character n-grams scaled with naive Bayes log-count ratios.

A feature is a hashed n-gram of three to five characters that the whole text has,
or repeats at some rate. Its scale is the log ratio of its document counts in the two classes,
counted over all labelled training rows; a logistic regression on the scaled
features is fitted on a bounded sample of these rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import free_names, id_and_text, sized, slices, stored, texts_of

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
RATES = (0.5, 1.0, 2.0, 4.0, 8.0)
ALL_FEATURES = 2 * BUCKETS
SAMPLE_PER_CLASS = 2000
SMOOTHING = 1.0
PENALTY = 1.0
STEPS = 120
LEAST_RATIO = 0.25
FIT_ROWS = 256
HELD_OUT_FOLD = 2
FOLDS = 4


def features_of(text: str) -> np.ndarray:
    """Distinct features of a text: n-grams that it has, and n-grams that it repeats.

    The second kind tells at which rates, in steps of two, an n-gram with several
    occurrences is reached per thousand characters.
    """
    plain = " " + " ".join(text.lower().split()) + " "
    points = np.frombuffer(plain.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found = []
    state = points
    for order in range(2, max(ORDERS) + 1):
        if len(state) < 2:
            break
        state = state[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :]
        if order in ORDERS:
            mixed = (state ^ (state >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    if not found:
        return np.zeros(0, dtype=np.int32)
    buckets = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1])))
    counts = np.diff(np.append(first, len(buckets)))
    distinct = buckets[first]
    features = [distinct]
    again = counts > 1
    often, rates = distinct[again].astype(np.uint64), counts[again] * (1024.0 / len(points))
    for level, rate in enumerate(RATES):
        reached = often[rates >= rate]
        hashed = (reached * np.uint64(len(RATES)) + np.uint64(level + 1)) * np.uint64(
            0x9E3779B97F4A7C15
        )
        features.append((hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + BUCKETS)
    return np.unique(np.concatenate(features)) if len(often) else distinct


def is_held_out(id_column: str = "doc_id") -> Column:
    """Rows whose label is never learnt; null ids are among them."""
    fold = F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(True))


def training_labels(labels: DataFrame, label_column: str = "toxic") -> DataFrame:
    """(doc_id, label): ids of the training folds with one undisputed label 0 or 1."""
    return (
        labels.filter(~is_held_out())
        .filter(F.col(label_column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label_column).alias("label"), F.max(label_column).alias("other"))
        .filter("label = other")
        .select("doc_id", F.col("label").cast("int").alias("label"))
    )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket and class of a task; bucket -1 counts the documents."""
    total = np.zeros((2, ALL_FEATURES), dtype=np.int64)
    rows = np.zeros(2, dtype=np.int64)
    for batch in slices(batches):
        for text, label in zip(texts_of(batch), batch.column("label").to_pylist()):
            total[label, features_of(text)] += 1
            rows[label] += 1
    bucket = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(bucket, -1).astype(np.int32)),
            pa.array(np.append(total[0, bucket], rows[0])),
            pa.array(np.append(total[1, bucket], rows[1])),
        ],
        names=["bucket", "clean", "toxic"],
    )


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, int, int]:
    """(ratio per bucket, clean rows, toxic rows) from all labelled rows.

    Ratios near zero are set to zero: such a feature tells nothing.
    """
    found = labelled.select("text", "label").mapInArrow(
        _counts, "bucket int, clean long, toxic long"
    )
    counts = np.zeros((2, ALL_FEATURES))
    rows = (0, 0)
    for bucket, clean, toxic in (
        found.groupBy("bucket").agg(F.sum("clean"), F.sum("toxic")).toLocalIterator()
    ):
        if bucket < 0:
            rows = (clean, toxic)
        else:
            counts[:, bucket] = clean, toxic
    smooth = counts + SMOOTHING
    ratio = np.log(smooth[1] / (rows[1] + 2 * SMOOTHING)) - np.log(
        smooth[0] / (rows[0] + 2 * SMOOTHING)
    )
    ratio[np.abs(ratio) < LEAST_RATIO] = 0
    ratio[counts.sum(axis=0) == 0] = 0
    return ratio.astype(np.float32), *rows


def _row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(np.append(values, 0), starts) * (sizes > 0)


def fit_logistic(
    buckets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ratio: np.ndarray
) -> tuple[np.ndarray, float]:
    """(weights with the scale folded in, bias) by accelerated gradient steps."""
    cuts = [0, *np.cumsum(sizes)[FIT_ROWS - 1 :: FIT_ROWS].tolist(), len(buckets)]
    rows = [sizes[at : at + FIT_ROWS] for at in range(0, len(sizes), FIT_ROWS)]
    # Only a part of the rows has its numbers as doubles at a time.
    parts = [(buckets[a:b], ratio[buckets[a:b]], n) for a, b, n in zip(cuts, cuts[1:], rows)]
    row_norm = np.concatenate([_row_sums(scale * scale, n) for _, scale, n in parts])
    step = 4.0 / (row_norm.mean() + 1.0)
    weights, bias = np.zeros(ALL_FEATURES), 0.0
    speed, bias_speed = np.zeros(ALL_FEATURES), 0.0
    n = len(labels)
    for turn in range(1, STEPS + 1):
        momentum = (turn - 1) / (turn + 2)
        ahead, bias_ahead = weights + momentum * speed, bias + momentum * bias_speed
        gradient, error = np.zeros(ALL_FEATURES), np.zeros(n)
        for i, (own, scale, count) in enumerate(parts):
            here = slice(i * FIT_ROWS, i * FIT_ROWS + len(count))
            margin = _row_sums(scale * ahead[own], count)
            error[here] = 1 / (1 + np.exp(-np.clip(margin + bias_ahead, -30, 30))) - labels[here]
            pull = scale * np.repeat(error[here], count)
            gradient += np.bincount(own, weights=pull, minlength=ALL_FEATURES)
        new = ahead - step * (gradient + PENALTY * ahead) / n
        new_bias = bias_ahead - step * error.sum() / n
        speed, bias_speed = new - weights, new_bias - bias
        weights, bias = new, new_bias
    return (weights * ratio).astype(np.float32), float(bias)


def _fit(ratio):
    def fit(sample: pa.Table) -> pa.Table:
        sample = sample.sort_by([("label", "ascending"), ("doc_id", "ascending")])
        found = []
        for batch in slices(sample.to_batches()):
            for text in texts_of(batch):
                features = features_of(text)
                found.append(features[ratio.value[features] != 0])
        sizes = np.array([len(f) for f in found])
        labels = sample.column("label").to_numpy().astype(np.float64)
        buckets = np.concatenate(found)
        found.clear()
        weights, bias = fit_logistic(buckets, sizes, labels, ratio.value)
        return pa.table(
            {"weights": pa.array([weights.tobytes()], pa.binary()), "bias": [bias]}
        )

    return fit


class Model:
    """Weights per bucket, the bias, and the class sizes they were fitted for."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: list[str]) -> np.ndarray:
        margins = [float(self.weights[features_of(t)].sum(dtype=np.float64)) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(margins) + self.bias, -30, 30)))


def train(
    docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS
) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Ratios come from every row of the training folds. The weights come from at most
    ``sample_per_class`` ids of either class, chosen by a hash of the id, each with
    its least text if rows share an id; labels without a document count for nothing.
    The bias is then set to the class sizes of all of them. With one class only, every text
    scores that class's smoothed share.
    """
    ids = id_and_text(docs).select("doc_id")
    known = stored(training_labels(labels).join(ids, "doc_id", "left_semi"), "labels")
    chosen = [
        known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(
            sample_per_class
        )
        for label in (0, 1)
    ]
    labelled = id_and_text(docs).join(sized(known), "doc_id")
    ratio, clean, toxic = log_count_ratios(labelled)
    if not clean or not toxic:
        share = (toxic + SMOOTHING) / (clean + toxic + 2 * SMOOTHING)
        return Model(np.zeros(ALL_FEATURES, dtype=np.float32), float(np.log(share / (1 - share))))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    sample = stored(
        id_and_text(docs)
        .join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text")),
        "sample",
    )
    sizes = dict(sample.groupBy("label").count().collect())
    fitted = (
        sample.withColumn("all", F.lit(0))
        .groupBy("all")
        .applyInArrow(_fit(shared), "weights binary, bias double")
        .first()
    )
    odds = np.log(toxic / clean) - np.log(sizes[1] / sizes[0])
    weights = np.frombuffer(bytes(fitted["weights"]), dtype=np.float32)
    return Model(weights, fitted["bias"] + float(odds))


def _score(shared, beside=()):
    """Scores of the texts; columns named in ``beside`` go through as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ["doc_id", *beside]), pa.array(model.scores(texts_of(batch)))],
                names=["doc_id", *beside, "score"],
            )

    return read


def scored(
    docs: DataFrame,
    model: Model,
    threshold: float = 0.3,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only the text decides a score. Null texts count as empty and get the score of a
    text without n-grams. Null ids are held out; repeated rows score alike; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    own = id_and_text(docs, id_column, text_column)
    return own.mapInArrow(_score(shared), "doc_id long, score double").select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns as they are.

    Every row goes or stays by its own text, also without an id or with one that
    other rows have; null texts score as empty ones. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    found = docs.select("doc_id", "text", digest.alias("digest")).mapInArrow(
        _score(shared, ["digest"]), "doc_id long, digest long, score double"
    )
    key_id, key_digest = free_names(docs, "_key_id", "_key_digest")
    rejected = stored(
        found.filter(F.col("score") >= threshold)
        .select(F.col("doc_id").alias(key_id), F.col("digest").alias(key_digest))
        .distinct(),
        "rejected",
    )
    same = docs["doc_id"].eqNullSafe(F.col(key_id)) & (digest == F.col(key_digest))
    return docs.join(sized(rejected), same, "left_anti")
