"""Token streams of op8_training_order beside what the library gives for every text."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from passagework.llm import sentence_pieces, training_order

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "plain words here", "", " leading", "trailing ", "two  blanks", None, "a ▁ mark", "▁", " ",
    "line\nbreaks\tand tabs", "line\n", "日本語 テキスト 😀 é é", "one", "one", "x" * 300,
    " ".join(f"w{i % 97}" for i in range(2000)), "</s> <s> <unk>", "nul\0inside it", "  odd 　",
]


@pytest.mark.parametrize("bounds", [{}, {"PART_BYTES": 40, "RUN_WORDS": 3, "LONG_TEXT": 100}])
def test_ids_are_those_of_the_library(spark, frame, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(training_order, name, value)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(TEXTS).select("doc_id", "text")
    shared = sentence_pieces._shared(docs, PIECES)
    read = training_order._tokens(shared, library.eos_id())
    fields = "doc_id long, tokens binary, n long, part long, inside long"
    rows = docs.mapInArrow(read, fields).collect()
    got = {r.doc_id: np.frombuffer(r.tokens, dtype="<u2").tolist() for r in rows}
    assert got == {
        i: [*library.encode(t or ""), library.eos_id()] for i, t in enumerate(TEXTS, 1)
    }
    for part in {r.part for r in rows}:
        own = sorted((r.inside, r.n) for r in rows if r.part == part)
        assert own[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_parts_hold_whole_texts():
    import pyarrow as pa

    old, training_order.PART_BYTES = training_order.PART_BYTES, 10
    try:
        batch = pa.RecordBatch.from_pydict({"text": ["a" * 25, None, "b" * 4, "c" * 4, "d" * 9, ""]})
        parts = [p.column("text").to_pylist() for p in training_order.parts([batch])]
    finally:
        training_order.PART_BYTES = old
    assert sum(parts, []) == batch.column("text").to_pylist()
    assert len(parts) > 2
