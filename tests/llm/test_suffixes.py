"""Repeated byte strings beside a table of all of them, and the order of suffixes."""

import hashlib
import random

import numpy as np
import pytest

from passagework.llm import suffix_dedup

WINDOW = 100


def plain(texts):
    """{id: (bytes, removed, spans, digest)} of (id, text), ids in order, by all windows."""
    seen, found = set(), {}
    for i, text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for start in range(len(data) - WINDOW + 1):
            window = data[start : start + WINDOW]
            if window in seen:
                gone[start : start + WINDOW] = b"\1" * WINDOW
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        found[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return found


def found_by(df, **options):
    rows = suffix_dedup.without_repeated_bytes(df, digest=True, **options).collect()
    return {r.doc_id: tuple(r)[1:] for r in rows}


def texts_with_passages(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcé\x00 日", k=rnd.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rnd.choices(words, k=rnd.randint(20, 60))) for _ in range(4)]
    texts = []
    for i in range(n):
        if texts and i % 6 == 2:
            texts.append(rnd.choice(texts))
            continue
        own = " ".join(rnd.choices(words, k=rnd.randint(0, 120)))
        if texts and i % 6 == 4:
            own = rnd.choice(texts)
            at = rnd.randint(0, len(own))
            own = own[:at] + "!" + own[at + rnd.randint(0, 3) :]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(own))
            own = own[:at] + rnd.choice(passages) + own[at:]
        texts.append(own)
    return texts


@pytest.mark.parametrize("bucket_rows", [1 << 17, 40])
def test_removed_bytes(frame, bucket_rows):
    texts = texts_with_passages(bucket_rows, 150)
    texts += ["a" * 700, "ab" * 300, "a" * 99, "a" * 100, "aab" * 90, None, "", "x"]
    want = plain(list(enumerate(texts, 1)))
    assert found_by(frame(texts), bucket_rows=bucket_rows) == want


def test_one_passage_in_many_texts_over_many_buckets(frame):
    rnd = random.Random(3)
    passage = "".join(rnd.choices("abcdef", k=150))
    texts = ["".join(rnd.choices("uvwxyz", k=90)) + passage + "".join(rnd.choices("uvwxyz", k=90))
             for _ in range(120)]
    texts += texts[:40] + [texts[7]] * 60
    assert found_by(frame(texts), bucket_rows=25) == plain(list(enumerate(texts, 1)))


def test_texts_longer_than_a_part(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 512)
    texts = texts_with_passages(11, 40)
    texts += ["".join(texts)[:20_000], "-" + "".join(texts)[300:9_000]]
    assert found_by(frame(texts)) == plain(list(enumerate(texts, 1)))


def test_null_and_shared_ids(spark, frame, odd_texts):
    a, b = "first " * 40, "second " * 40
    df = frame([a, a, b, a, b, b], ids=[1, 1, 1, None, None, 2])
    rows = suffix_dedup.without_repeated_bytes(df, digest=True).collect()
    removed = {}
    for r in rows:
        removed.setdefault((r.doc_id, r.n_bytes), []).append(r.n_removed)
    inner = {t: plain([(0, t)])[0][1] for t in (a, b)}
    # Rows equal in id and text are one text; a later text loses all of a repeated one.
    assert removed[1, len(a)] == [inner[a]] * 2
    assert removed[1, len(b)] == [inner[b]]
    assert removed[2, len(b)] == [len(b)]
    assert removed[None, len(a)] == [len(a)] and removed[None, len(b)] == [len(b)]
    want = plain(list(enumerate(odd_texts, 1)))
    assert found_by(frame(odd_texts)) == want
    assert suffix_dedup.without_repeated_bytes(frame(["x"]).limit(0)).collect() == []
    kept = suffix_dedup.without_repeated_bytes(frame(["é" * 80])).first()
    assert bytes(kept.kept) == ("é" * 80).encode()[: 160 - kept.n_removed]


def test_order_of_suffixes():
    rnd = random.Random(2)
    strings = [bytes(rnd.choices(b"\x00ab", k=rnd.randint(0, 20))) for _ in range(400)]
    rows = np.zeros((400, 24), dtype=np.uint8)
    for row, s in zip(rows, strings):
        row[: len(s)] = list(s)
    lengths = np.array([len(s) for s in strings])
    order, shared = suffix_dedup.multikey_order(rows, lengths)
    got = [strings[i] for i in order]
    assert got == sorted(strings) and shared[0] == -1
    for a, b, n in zip(got, got[1:], shared[1:]):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
