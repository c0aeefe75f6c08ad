"""Rows that share ids, copies that differ in white space, and columns with odd names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from passagework.llm import (
    exact_dedup,
    near_copies,
    substring_dedup,
    toxicity,
    training_order,
)
from passagework.llm.common import free_names

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_one_row_of_equal_texts_stays(frame):
    df = frame(["a b c", "ab  c", "x", "x ", "y", "y"], ids=[1, 1, 2, 2, None, None])
    kept = exact_dedup.without_copies(df).collect()
    norms = sorted((r.doc_id or 0, r.text.replace(" ", "")) for r in kept)
    assert norms == [(0, "y"), (1, "abc"), (2, "x")]
    agreed = exact_dedup.exact_duplicates(df).filter("kept").count()
    assert agreed == len(kept)


@pytest.mark.parametrize("odd", ["_key_id", "_KEY_DIGEST", "_key_doc_id", "_norm", "digest", "node"])
def test_columns_with_the_names_of_keys(frame, odd):
    text = " ".join(f"w{i}" for i in range(60))
    df = frame([text, text + " ", text + " end", "other"]).withColumn(odd, F.lit(7))
    assert exact_dedup.without_copies(df).columns == df.columns
    assert sorted(r.doc_id for r in exact_dedup.without_copies(df).collect()) == [2, 3, 4]
    assert sorted(r.doc_id for r in near_copies.one_per_group(df).collect()) == [1, 4]
    model = toxicity.Model(np.zeros(toxicity.ALL_FEATURES, dtype=np.float32), -9.0)
    assert toxicity.without_toxic(df, model).count() == 4


def test_names_that_are_free(frame):
    df = frame(["a"]).withColumn("_key", F.lit(1))
    assert free_names(df, "_KEY", "_key", "free") == ["_KEY_", "_key__", "free"]


def test_repeated_rows_take_no_more_windows(frame):
    words = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"w{i}" for i in range(10, 90)) + " end"
    found = {}
    for times in (2, 40):
        df = frame([words] * times + [other], ids=[1] * times + [2])
        _, distinct = substring_dedup._with_version(df.select("doc_id", "text"))
        found[times] = substring_dedup.repeated_spans(distinct).count()
        removed = substring_dedup.without_repeats(df).select("doc_id", "n_removed").collect()
        assert {tuple(r) for r in removed} == {(1, 0), (2, 80)}
    assert found[2] == found[40]


def test_ids_of_the_model(monkeypatch, frame):
    with open(MODEL, "rb") as f:
        assert training_order.special_ids(f.read())[0] == 2
    monkeypatch.setattr(training_order, "MAX_VOCABULARY", 1000)
    with pytest.raises(ValueError, match="16 bits"):
        training_order.training_order(frame(["a"]), MODEL)


def test_long_texts_are_encoded_alike(frame, monkeypatch):
    texts = ["a b  c " * 40, "x" * 300, "word " * 90, "", None, "日本 é"]
    whole = training_order.training_order(frame(texts), MODEL, length=32, shard_slots=4)
    want = sorted((r.sequence, bytes(r.tokens)) for r in whole.collect())
    monkeypatch.setattr(training_order, "LONG_TEXT", 5)
    parts = training_order.training_order(frame(texts), MODEL, length=32, shard_slots=4)
    assert sorted((r.sequence, bytes(r.tokens)) for r in parts.collect()) == want
