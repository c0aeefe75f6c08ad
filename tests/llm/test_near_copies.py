"""The near-copy stage of the pipeline beside all pairs compared in full."""

import random

import corpus_pipeline
import pytest
from passagework.llm import near_copies


def planted(seed=3):
    """Texts, and copies of some with one to nine of 200 words changed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    texts = [[word() for _ in range(200)] for _ in range(30)]
    for i in range(30):
        copy = list(texts[i % 10])
        for at in rnd.sample(range(200), 1 + i % 9):
            copy[at] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts] + ["one two three", "ONE  two three", "one two", ""]


def plain_kept(texts):
    sets = [near_copies.shingles(t) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return {i + 1 for i, r in enumerate(root) if r == i}


def stage(spark, docs):
    stages = [f for name, f in corpus_pipeline.STAGES if "near-dedup" in name]
    return stages[0](spark, docs, None)


def test_planted_near_copies_go(frame, spark):
    texts = planted()
    want = plain_kept(texts)
    assert 10 < len(texts) - len(want) < 31
    docs = frame(texts)
    kept = stage(spark, docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("bound, size", [("BLOCK_ROWS", 3), ("BLOCK_CHARS", 3000)])
def test_groups_beyond_a_block_and_the_broadcast_bound(frame, spark, monkeypatch, bound, size):
    monkeypatch.setattr(near_copies, bound, size)
    monkeypatch.setattr(near_copies, "sized", lambda keys: keys)
    texts = planted(5)
    assert {r.doc_id for r in stage(spark, frame(texts)).collect()} == plain_kept(texts)


def test_rows_without_an_id_or_with_a_shared_one(frame, spark):
    a, *_, b = planted()[:31]
    docs = frame([a, b, b, "other words"], ids=[5, None, 7, 7])
    got = sorted((r.doc_id, r.text) for r in stage(spark, docs).collect())
    assert got == [(5, a), (7, "other words")]
    assert stage(spark, docs.limit(0)).count() == 0


def test_fingerprints_of_operator_3_bring_texts_together(frame, spark, monkeypatch):
    texts = planted(7)
    monkeypatch.setattr(near_copies, "candidates", by_fingerprints_alone)
    copies = [texts[0].upper(), texts[1].replace(" ", "  ")]
    kept = {r.doc_id for r in stage(spark, frame(texts + copies)).collect()}
    assert kept >= plain_kept(texts) and not {len(texts) + 1, len(texts) + 2} & kept


def by_fingerprints_alone(rows, words):
    return near_copies.components(near_copies.near_fingerprints(rows, words))
