"""Scores of the models beside plain versions of the same rules, and SQL on a tiny source."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest

import check
from passagework.llm import importance, mixing, queries, substring_dedup, toxicity

MASK = 2**64 - 1
TEXTS = [
    "You are all so dumb, dumb, dumb!", "A quiet walk by the river.", "", None, "é É\tß  x",
    "dumb river " * 40, "You quiet fool, you fool", "The river, the walk.", "ab", "a",
]


def golden(x):
    return x * 0x9E3779B97F4A7C15 & MASK


def plain_features(text):
    """Hashed n-grams of 3 to 5 characters, and the rates at which some come again."""
    plain = " " + " ".join((text or "").lower().split()) + " "
    counts = Counter()
    for order in (3, 4, 5):
        for i in range(len(plain) - order + 1):
            state = ord(plain[i])
            for letter in plain[i + 1 : i + order]:
                state = golden(state) + ord(letter) & MASK
            counts[((state ^ state >> 29) * 0xBF58476D1CE4E5B9 & MASK) >> 46] += 1
    found = set(counts)
    for bucket, n in counts.items():
        for level, rate in enumerate((0.5, 1.0, 2.0, 4.0, 8.0)):
            if n > 1 and n * (1024.0 / len(plain)) >= rate:
                found.add((golden(bucket * 5 + level + 1) >> 46) + (1 << 18))
    return found


@pytest.mark.parametrize("text", TEXTS)
def test_features(text):
    got = toxicity.features_of(text or "").tolist()
    assert sorted(plain_features(text)) == got


def test_ratios_and_scores(frame, spark):
    texts = [t or "" for t in TEXTS]
    labels = [1, 0, 0, 0, 1, 1, 1, 0, 0, 0]
    docs = frame(TEXTS).join(
        spark.createDataFrame(list(enumerate(labels, 1)), "doc_id long, label int"), "doc_id"
    )
    ratio, clean, toxic = toxicity.log_count_ratios(docs)
    assert (clean, toxic) == (6, 4)
    have = [Counter(), Counter()]
    for text, label in zip(texts, labels):
        have[label].update(plain_features(text))
    for feature in set(have[0]) | set(have[1]):
        want = math.log((have[1][feature] + 1) / 6) - math.log((have[0][feature] + 1) / 8)
        want = 0.0 if abs(want) < 0.25 else want
        assert ratio[feature] == pytest.approx(want, abs=1e-6)
    assert np.count_nonzero(ratio) <= len(set(have[0]) | set(have[1]))
    rng = np.random.default_rng(1)
    weights = rng.normal(size=toxicity.ALL_FEATURES).astype(np.float32)
    scored = toxicity.scored(frame(TEXTS), toxicity.Model(weights, 0.3)).collect()
    for row in scored:
        margin = 0.3 + sum(float(weights[f]) for f in plain_features(texts[row.doc_id - 1]))
        want = 1 / (1 + math.exp(-min(max(margin, -30), 30)))
        assert row.score == pytest.approx(want, abs=1e-9)
        assert row.predicted == (row.score >= 0.3)


def test_fitted_weights_are_at_the_least_loss():
    """The gradient of the penalised loss vanishes at the weights that come back."""
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 6, size=40)
    buckets = rng.integers(0, 30, size=sizes.sum()).astype(np.int32)
    labels = rng.integers(0, 2, size=40).astype(float)
    ratio = np.zeros(toxicity.ALL_FEATURES, dtype=np.float32)
    ratio[:30] = rng.choice([-1.0, 1.0], 30) * rng.uniform(0.5, 2, 30)
    folded, bias = toxicity.fit_logistic(buckets, sizes, labels, ratio)
    x = np.zeros((40, 30))
    np.add.at(x, (np.repeat(np.arange(40), sizes), buckets), ratio[buckets])
    weights = folded[:30] / ratio[:30]

    def loss(w, b):
        margin = x @ w + b
        return np.logaddexp(0, margin).sum() - labels @ margin + w @ w / 2

    least = loss(weights, bias)
    for _ in range(200):
        assert loss(weights + rng.normal(size=30) * 0.02, bias + rng.normal() * 0.02) >= least - 1e-3


def plain_grams(text):
    """Hashed words and pairs of words, lower-cased."""

    def spread(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        return x ^ x >> 31

    values = [int(v) for v in substring_dedup.BYTE_VALUES]
    words = []
    for word in (text or "").lower().encode().split():
        total = sum(values[b] * pow(substring_dedup.BYTE_STEP, i, 2**64) for i, b in enumerate(word))
        words.append(spread(total & MASK))
    pairs = [spread(golden(a) + b & MASK) for a, b in zip(words, words[1:])]
    return [g >> 48 for g in words + pairs]


@pytest.mark.parametrize("run_grams", [None, 100, 7])
def test_importance_weights(frame, spark, run_grams):
    texts = [*TEXTS, "river river walk", "fool"]
    targets = {2, 8, 11}
    grams = [plain_grams(t) for t in texts]
    raw = Counter(g for own in grams for g in own)
    target = Counter(g for i, own in enumerate(grams, 1) if i in targets for g in own)
    size = importance.BUCKETS

    def log(counts, g):
        return math.log((counts[g] + 0.5) / (sum(counts.values()) + 0.5 * size))

    ids = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    rows = importance.resampled(frame(texts), ids, 0.5, run_grams=run_grams).collect()
    assert len(rows) == len(texts)
    for row in rows:
        own = grams[row.doc_id - 1]
        weight = sum(log(target, g) - log(raw, g) for g in own)
        if run_grams is not None:
            weight *= run_grams / max(len(own), 1)
        assert row.n_grams == len(own)
        assert row.log_weight == pytest.approx(weight, abs=1e-9)
    kept = sorted((r.key for r in rows if r.kept), reverse=True)
    assert kept == sorted((r.key for r in rows), reverse=True)[: round(0.5 * len(rows))]


def test_kept_among_ties(frame, spark):
    rows = importance.resampled(frame(["same"] * 20, ids=[4] * 20), spark.range(0).toDF("doc_id"), 0.3)
    assert sum(r.kept for r in rows.collect()) == 6


def test_mixing_sql_with_a_tiny_source(frame):
    """A rate far above 64: the SQL draws in parts as the operator does."""
    texts = ["word " * 400] * 60 + ["x"]
    docs = frame(texts, sources=["big"] * 60 + ["tiny"])
    rates = {r.source: r.rate for r in mixing.target_rates(docs).collect()}
    assert rates["tiny"] > 64
    found = mixing.replicated(docs, mixing.target_rates(docs)).select(
        "row.doc_id", "row.source", "n_copies", "copy", "mix_key", "row.text"
    )
    ours = check.comparable(found.collect(), found.columns)
    documents = docs.select("doc_id", "source", "text").toArrow()  # noqa: F841
    connection = duckdb.connect()
    result = connection.execute(queries.OP6_SQL)
    columns = [d[0] for d in result.description]
    assert ours == check.comparable(result.fetchall(), columns)
