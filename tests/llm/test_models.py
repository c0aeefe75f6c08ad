"""Learnt, sampled and vector operators, the pipeline, and the queries beside their SQL."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import check
import corpus_pipeline
from passagework.llm import embedding_links, importance, mixing, queries, toxicity

SF = "/root/testdata/sf0.001"


def clean_text(rnd):
    return " ".join("".join(rnd.choices("aeioutnrsl", k=rnd.randint(2, 8))) for _ in range(80))


def test_toxicity_on_held_out_rows(frame, spark, odd_texts):
    rnd = random.Random(1)
    texts = [clean_text(rnd) for _ in range(300)]
    toxic = [int(i % 4 == 0) for i in range(300)]
    texts = [t + (" zgrub" + " qux zgrubbing" * 2) * y for t, y in zip(texts, toxic)]
    docs = frame(texts + odd_texts)
    labels = spark.createDataFrame(
        [(i + 1, y) for i, y in enumerate(toxic)] + [(1, 1), (2, None), (None, 1), (9999, 5)],
        "doc_id long, toxic int",
    )
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(texts) + len(odd_texts)
    held = [i for i in range(1, 301) if got[i].held_out]
    assert held and np.mean([got[i].predicted == toxic[i - 1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_learns_nothing_from_held_out_labels(frame, spark):
    labels = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    import zlib

    got = {r.doc_id for r in toxicity.training_labels(labels).collect()}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    model = toxicity.train(frame(["x", "y"]), labels.limit(0))
    assert toxicity.scored(frame(["x"]), model).first().score == 0.5


def test_toxicity_sample_has_only_documents(frame, spark, monkeypatch):
    """Labels without a document, and rows that share an id, do not fill the sample."""
    texts = ["calm words here"] * 40 + ["zgrub zgrub zgrub"] * 40
    docs = frame(texts).unionByName(frame(["zgrub zgrub zgrub"] * 500, ids=[80] * 500))
    labels = spark.range(1, 2000).select(
        F.col("id").alias("doc_id"), (F.col("id") > 40).cast("int").alias("toxic")
    )
    sizes = []
    fit = toxicity._fit

    def watched(ratio):
        def run(sample):
            if sample.num_rows > 10 or len(set(sample.column("label").to_pylist())) != 2:
                raise AssertionError("not a sample of both classes")
            return fit(ratio)(sample)

        sizes.append(1)
        return run

    monkeypatch.setattr(toxicity, "_fit", watched)
    model = toxicity.train(docs, labels, sample_per_class=5)
    assert sizes
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, model).collect()}
    assert got == {i: int(i > 40) for i in range(1, 81)}


def test_importance_prefers_the_target(frame, spark):
    rnd = random.Random(2)
    good = [" ".join(rnd.choices("alpha beta gamma delta".split(), k=60)) for _ in range(100)]
    junk = [" ".join(rnd.choices("!! ?? %% buy".split(), k=60)) for _ in range(100)]
    docs = frame(good + junk + [None, ""])
    ids = spark.range(1, 51).withColumnRenamed("id", "doc_id")
    rows = importance.resampled(docs, ids, 0.5).collect()
    kept = [r.doc_id for r in rows if r.kept]
    assert len(kept) == 101 and sum(i <= 100 for i in kept) >= 99
    assert min(r.key for r in rows if r.kept) >= max(r.key for r in rows if not r.kept)
    assert importance.resampled(docs, ids.limit(0), 0.5).where("log_weight <> 0").count() == 0
    assert importance.resampled(docs.limit(0), ids, 0.5).count() == 0


def test_kth_largest_with_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANKED_ROWS", 5)
    monkeypatch.setattr(importance, "BINS", 4)
    rnd = random.Random(5)
    rows = [(float(rnd.choice([1, 1, 2, 3.5, rnd.random()])), i) for i in range(300)]
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    table = spark.createDataFrame(rows, "key double, row long")
    for k in (1, 77, 150, 300):
        assert importance.kth_largest(table, k) == ordered[k - 1]


def test_mixing_reaches_target_weights(frame, spark):
    sources = ["big"] * 3000 + ["small"] * 300 + [None] * 200 + ["none"] * 10
    docs = frame(["word " * 5] * len(sources), sources=sources)
    weights = spark.createDataFrame([("big", 1.0), ("small", 2.0), (None, 1.0)], "source string, weight double")
    rates = mixing.target_rates(docs, weights)
    size = dict(mixing.mixed(docs, rates).groupBy("source").count().collect())
    total = len(sources)
    assert "none" not in size
    for source, share in (("big", 0.25), ("small", 0.5), (None, 0.25)):
        assert abs(size[source] - total * share) < 5 * math.sqrt(total * share * 9)
    assert mixing.mixed(docs, rates).columns == docs.columns
    assert mixing.mixed(docs.limit(0), mixing.target_rates(docs.limit(0))).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.3, 2.0, 150.0])
def test_draws_are_poisson(spark, rate):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rates = spark.createDataFrame([("s", rate)], "source string, rate double")
    counts = dict(mixing.replicated(docs, rates).groupBy("row.doc_id").count().collect())
    draws = np.array([counts.get(i, 0) for i in range(4000)])
    assert abs(draws.mean() - rate) < 5 * math.sqrt(rate / 4000) + 1e-9
    assert abs(draws.var() - rate) < 0.2 * rate + 1e-9


def plain_links(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    links = {i: set() for i in ids if i is not None}
    ok = [
        r for r in rows
        if r[0] is not None and r[2] is not None and r[1] and None not in r[1]
        and all(map(math.isfinite, r[1])) and any(r[1])
    ]
    for i, u, a in ok:
        for j, v, b in ok:
            if i != j and a == b and len(u) == len(v):
                u64, v64 = np.float32(u).astype(float), np.float32(v).astype(float)
                if u64 @ v64 / math.sqrt(u64 @ u64) / math.sqrt(v64 @ v64) >= threshold:
                    links[i].add(j)
    root = {}
    for i in sorted(links):
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += links[k]
    return {i: (len(links[i]), root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("block, dim", [(512, 8), (16, 8), (16, 3)])
def test_vector_links(spark, monkeypatch, block, dim):
    monkeypatch.setattr(embedding_links, "BLOCK_ROWS", block)
    monkeypatch.setattr(embedding_links, "FAN_OUT", 3)
    if dim == 3:  # beyond the bound of a broadcast
        monkeypatch.setattr(embedding_links, "sized", lambda keys: keys)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(40, dim))
    rows = []
    for i in range(600):
        v = centres[rng.integers(40)] + rng.normal(size=dim) * 0.15
        rows.append((i, v.tolist(), int(rng.integers(3))))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(30)]
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(3000, rows[0][1], None), (3001, [1.0, 2.0], 1), (3002, [2.0, 4.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {
        r.vec_id: (r.n_links, r.component_id, r.kept)
        for r in embedding_links.near_duplicate_vectors(table).collect()
    }
    assert got == plain_links(rows)
    assert embedding_links.near_duplicate_vectors(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
    final = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in final.collect()) == sorted(r.doc_id for r in kept.collect())
    assert final.where("not round_trip").count() == 0
    assert corpus_pipeline.run.__module__ == "corpus_pipeline"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_beside_their_sql(spark, name):
    same, note = check.compare(spark, check.duck(SF), SF, name)
    assert same, note


def test_one_query_per_operator():
    names = entry_points.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
    assert "pipeline" in names
