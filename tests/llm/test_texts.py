"""Operators on texts beside plain versions of the same rules."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagework.llm import (
    exact_dedup,
    sentence_pieces,
    simhash,
    substring_dedup,
    token_counts,
    training_order,
)

BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_with_copies(seed=1, n=120):
    """Random texts, exact and near copies, and a passage of 60 words in every fifth."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(300)]
    passage = rnd.choices(words, k=60)
    texts = []
    for i in range(n):
        if texts and i % 7 == 3:
            texts.append(rnd.choice(texts))
            continue
        own = rnd.choices(words, k=rnd.randint(0, 250))
        if texts and i % 7 == 5:
            own = rnd.choice(texts).split()
            if own:
                own[rnd.randrange(len(own))] = "changed"
        if i % 5 == 0:
            at = rnd.randint(0, len(own))
            own = own[:at] + passage + own[at:]
        texts.append(rnd.choice([" ", "  ", "\n"]).join(own))
    return texts


def test_exact_duplicates(frame, odd_texts):
    texts = texts_with_copies() + odd_texts + ["a b", "ab ", "ab"]
    groups = defaultdict(list)
    for i, t in enumerate(texts, 1):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[norm].append((-len(t or ""), i))
    want = {}
    for norm, rows in groups.items():
        for _, i in rows:
            digest = hashlib.sha256(norm.encode()).hexdigest()
            want[i] = (min(rows)[1], len(rows), min(rows)[1] == i, digest)
    docs = frame(texts)
    got = {
        r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256)
        for r in exact_dedup.exact_duplicates(docs).collect()
    }
    assert got == want
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[2]}


def test_exact_duplicates_of_repeated_rows_and_null_ids(frame):
    docs = frame(["a", "a", "a", "b", "b"], ids=[1, 1, 2, None, None])
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {3, 2}
    kept = sorted(((r.doc_id or 0), r.text) for r in exact_dedup.without_copies(docs).collect())
    assert kept == [(0, "b"), (1, "a")]


@pytest.mark.parametrize("n, span", [(0, 10), (1, 1), (5, 5), (1000, 1 << 40), (700, 1000)])
def test_golomb_codes(n, span):
    values = np.sort(np.array(random.Random(n).sample(range(span), n), dtype=np.int64))
    assert (exact_dedup.golomb_decode(n, *exact_dedup.golomb_encode(values, span)) == values).all()


def plain_fingerprint(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates(frame, odd_texts):
    texts = texts_with_copies() + odd_texts
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts, 1)}
    root = {i: i for i in prints}
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    docs = frame(texts)
    found = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint())
    got = {r.doc_id: (r.hex, r.component_id) for r in found.collect()}
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert {r.doc_id for r in simhash.one_per_group(docs).collect()} == set(root.values())


@pytest.mark.parametrize("seed", range(3))
def test_vantage_shards_find_every_link(spark, monkeypatch, seed):
    """Dense clouds of fingerprints, many shards, many local levels: against all pairs."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 8)
    rnd = random.Random(seed)
    values = set()
    while len(values) < 900:
        centre = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 30])):
            value = centre
            for _ in range(rnd.randint(0, 3)):
                value ^= 1 << rnd.randrange(64)
            values.add(value)
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long, first long"))
    label = np.arange(len(values))
    array = np.array(values, dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(array[:, None] ^ array[None, :]) <= 2)
    simhash.unite(label, i, j)
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert [got.get(k, k) for k in range(len(values))] == label.tolist()


def test_repeated_passages(frame, odd_texts):
    texts = texts_with_copies() + odd_texts
    words = {i: WORD.findall(t or "") for i, t in enumerate(texts, 1)}
    first = {}
    for i, w in sorted(words.items()):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone.update(range(s, s + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = {
        r.doc_id: (r.n_words, r.n_removed, r.kept)
        for r in substring_dedup.without_repeats(frame(texts), digest=True).collect()
    }
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_repeated_passages_beyond_the_broadcast_bound(frame, monkeypatch):
    docs = frame(texts_with_copies(2))
    near = substring_dedup.without_repeats(docs).select("doc_id", "kept").collect()
    monkeypatch.setattr(substring_dedup, "MAX_BROADCAST_SPANS", 0)
    far = substring_dedup.without_repeats(docs).select("doc_id", "kept").collect()
    assert sorted(near) == sorted(far)


def test_rows_with_one_id_or_none_keep_their_passages(frame):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring_dedup.without_repeats(frame([text, text + " x", text], [5, 5, None])).collect()
    assert all(r.n_removed == 0 for r in got)


def test_token_counts(frame, odd_texts):
    texts = texts_with_copies() + odd_texts + ["it's <|endoftext|> x", "\x1c\u0085  a  b", "ԱԲ՘ ½ ٣"]
    library = Tokenizer.from_file(BPE)
    want = {
        i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t in enumerate(texts, 1)
    }
    got = token_counts.count_tokens(frame(texts), BPE).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)


def test_sentence_pieces(frame, odd_texts):
    rnd = random.Random(3)
    alphabet = "abcdefgh  tion éß日本\n.,!0"
    texts = texts_with_copies() + odd_texts
    texts += ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(300)]
    texts += ["▁ mark", " lead", "trail ", "a   b" + " " * 40, "<s> <0x41>", "aaaaaaaaaaaa"]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(texts)
    coded = sentence_pieces.encode(docs, PIECES, check=True)
    got = {r.doc_id: r for r in coded.collect()}
    assert {i: r.ids for i, r in got.items()} == {
        i: library.encode(t or "") for i, t in enumerate(texts, 1)
    }
    assert all(r.round_trip == ("▁" not in (texts[i - 1] or "")) for i, r in got.items())
    decoded = {r.doc_id: r.text for r in sentence_pieces.decode(coded, PIECES).collect()}
    assert decoded == {i: library.decode(r.ids) for i, r in got.items()}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation(n):
    order = training_order.Permutation(n, "key")
    slots = order.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.sequence(slots) == np.arange(n)).all()


def test_training_order(frame, odd_texts, tmp_path):
    texts = texts_with_copies() + odd_texts
    records = training_order.training_order(frame(texts), PIECES, length=64, shard_slots=16)
    rows = sorted(records.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * 128 for r in rows)
    stream = np.concatenate(
        [np.frombuffer(r.tokens, "<u2") for r in sorted(rows, key=lambda r: r.sequence)]
    ).tolist()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(library.encode(t or "") for t in texts)
    got, now = [], []
    for token in stream:
        if token == 2:
            got.append(now)
            now = []
        else:
            now.append(token)
    assert sorted(got) == want and set(now) <= {0}
    folder = f"file://{tmp_path}/shards"
    # What a second run of a task would write is the same, and takes the place of the first.
    for _ in range(2):
        manifest = {r.shard: r for r in training_order.write_shards(records, folder, 64).collect()}
    assert sum(m.n for m in manifest.values()) == len(rows)
    path_of = lambda shard: f"file://{manifest[shard].path}"
    slots = [0, 17, len(rows) - 1]
    for slot, ids in zip(slots, training_order.read_slots(path_of, slots, 64, 16)):
        assert ids.tobytes() == bytes(rows[slot].tokens)


def test_empty_tables(frame, spark):
    docs = frame(["x"]).limit(0)
    for found in (
        exact_dedup.exact_duplicates(docs),
        exact_dedup.without_copies(docs),
        simhash.near_duplicates(docs),
        simhash.one_per_group(docs),
        substring_dedup.without_repeats(docs),
        token_counts.count_tokens(docs, BPE),
        sentence_pieces.encode(docs, PIECES),
        training_order.training_order(docs, PIECES),
    ):
        assert found.count() == 0
    assert frame(["x"]).where(F.col("fp") == "own").count() == 1
