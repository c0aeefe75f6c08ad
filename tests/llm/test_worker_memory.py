"""What the toxicity model and the encoder hold in a worker is bounded."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from passagework.llm import sentence_pieces, toxicity


def test_the_fit_has_only_a_part_of_the_rows_as_doubles(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 2)
    rng = np.random.default_rng(3)
    sizes = np.full(3000, 1000)
    sizes[[0, 255, 256, 2999]] = 0
    buckets = rng.integers(0, toxicity.ALL_FEATURES, sizes.sum()).astype(np.int32)
    ratio = rng.normal(size=toxicity.ALL_FEATURES).astype(np.float32)
    labels = (np.arange(len(sizes)) % 2).astype(np.float64)
    tracemalloc.start()
    try:
        toxicity.fit_logistic(buckets, sizes, labels, ratio)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * len(buckets)


def test_parts_of_rows_give_the_fit_of_all_rows(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 30, 101)
    buckets = rng.integers(0, 500, sizes.sum()).astype(np.int32)
    ratio = rng.normal(size=toxicity.ALL_FEATURES).astype(np.float32)
    labels = (np.arange(len(sizes)) % 2).astype(np.float64)
    found = []
    for rows in (1, 7, 101, 1000):
        monkeypatch.setattr(toxicity, "FIT_ROWS", rows)
        found.append(toxicity.fit_logistic(buckets, sizes, labels, ratio))
    for weights, bias in found[:-1]:
        assert np.allclose(weights, found[-1][0], atol=1e-7) and np.isclose(bias, found[-1][1])


def test_an_encoder_keeps_few_segments_between_tasks():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    tables = vars(sentence_pieces.Merges(model))
    shared = type("Shared", (), {"value": (model, tables)})
    texts = [" ".join(f"w{200 * i + j}" for j in range(200)) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    for _ in sentence_pieces._encode(shared, True)(iter([batch])):
        pass
    encoder = sentence_pieces._encoder(shared)
    assert len(encoder.cache) + len(encoder.older) < 220_000
