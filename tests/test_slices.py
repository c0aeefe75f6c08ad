"""Models, tokenizers and the hashed embedder meet a bounded slice of an Arrow batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework import catalog
from passagework.operators import embedding
from passagework.operators.embedding import HashedEmbedder, ModelEmbedder, components, embed
from passagework.operators.nearest import SLICE_BYTES, slices_of
from passagework.operators.training import TOKENIZER_ROWS, ModelTokenizer, tokenize


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def batch_sizes():
    return lambda texts: [[len(texts)] for _ in texts]


@pytest.mark.parametrize("name", ["embed_hashed", "embed_model"])
def test_vectors_are_computed_once(spark, name):
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert plan_of(df).count("ArrowEvalPython") == 1


def test_components_leave_out_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0]), (2, None), (3, [])], "id long, v array<double>")
    rows = components(df, "id", vector="v").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 2.0), (1, 1, 3.0)]


def test_a_tokenizer_gets_a_slice_at_a_time(spark):
    rows = spark.range(3 * TOKENIZER_ROWS).coalesce(1).select("id", F.lit("x").alias("text"))
    sizes = tokenize(rows, ModelTokenizer(batch_sizes), None).select(F.explode("input_ids")).collect()
    assert {r[0] for r in sizes} == {TOKENIZER_ROWS}


def test_a_model_gets_a_slice_at_a_time(spark):
    rows = spark.range(100).coalesce(1).select("id", F.lit("x").alias("text"))
    model = ModelEmbedder([("sizes", batch_sizes)], 1, batch_size=50)
    assert {r.embedding[0] for r in embed(rows, "text", model).collect()} == {50.0}


def test_slices_and_forgotten_words_give_the_same_vectors(spark, monkeypatch):
    texts = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(300)]
    df = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    got = {r.id: r.embedding for r in embed(df, "text", HashedEmbedder(16)).collect()}
    assert got[0] is None and got[40] is None
    monkeypatch.setattr(embedding, "KNOWN_WORDS", 3)
    buckets = {}
    for i, text in texts:
        if text:
            one = embedding._scattered(pa.array([text.split(" ")]), 16, buckets).to_pylist()[0]
            assert np.array_equal(np.float32(one), np.float32(got[i]))


def test_a_search_turns_a_slice_of_a_batch_into_doubles():
    rows = 2 * SLICE_BYTES // (8 * 384) + 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows))], names=["id"])
    parts = list(slices_of(batch, 384))
    assert max(p.num_rows for p in parts) * 8 * 384 <= SLICE_BYTES
    assert [i for p in parts for i in p["id"].to_pylist()] == list(range(rows))
