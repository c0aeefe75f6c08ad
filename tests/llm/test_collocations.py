"""Collocations beside a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passagework.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, max_words=3, min_count=10, covered=50, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    phrases = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    gone = set()
    for (lang, words), more in phrases.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                inner = lang, words[i : i + size]
                if 100 * more >= covered * counts[inner]:
                    gone.add(inner)
    by_lang = {}
    for (lang, words), a in phrases.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((score, a, " ".join(words), left, right))
    found = []
    for lang, own in by_lang.items():
        own.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        for rank, (score, a, phrase, left, right) in enumerate(own[:top], 1):
            found.append((lang, rank, phrase, a, left, right, totals[lang], score))
    return sorted(found)


def frame_of(spark, rows):
    schema = "lang string, text string, n long, phrase string"
    return spark.createDataFrame([(*r, 7, "own") for r in rows], schema).repartition(3)


def random_texts(seed, n):
    rnd = random.Random(seed)
    words = [rnd.choice(["", "É", "X"]) + "".join(rnd.choices("abçD-'", k=rnd.randint(1, 3)))
             for _ in range(25)] + ["日本", " ", "\x00"]
    fixed = [rnd.choices(words, k=rnd.randint(2, 5)) for _ in range(6)]
    rows = []
    for _ in range(n):
        own = []
        for _ in range(rnd.randint(0, 40)):
            own += rnd.choice(fixed) if rnd.random() < 0.3 else [rnd.choice(words)]
            own[-1] += rnd.choice(["", "", "", ".", "!", "\n", ", "])
        rows.append((rnd.choice(["en", "de", None, "und", ""]), rnd.choice([" ", "  ", "\t"]).join(own)))
    return rows + [("en", None), (None, ""), ("xx", "a b"), ("en", " \t"), ("en", "..,")]


@pytest.mark.parametrize(
    "options",
    [{}, {"max_words": 4, "min_count": 3}, {"max_words": 2, "min_count": 2}, {"top": 5},
     {"covered": 100, "min_count": 1}],
)
def test_collocations(spark, options):
    rows = random_texts(4, 250)
    found = collocations.collocations(frame_of(spark, rows), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(rows, **options)


def test_chunks_cut_between_pieces(spark, monkeypatch):
    rows = random_texts(6, 150)
    rows.append(("en", " ".join(t or "" for _, t in rows)))
    rows.append(("en", "no end " * 400))
    want = plain(rows)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 64)
    monkeypatch.setattr(collocations, "BITMAP_BITS", 6)
    assert sorted(map(tuple, collocations.collocations(frame_of(spark, rows)).collect())) == want


def test_products_beyond_64_bits(spark, monkeypatch):
    counts = [("en", 1, "a", 4 * 10**10), ("en", 1, "b", 3 * 10**10), ("en", 2, "a b", 2 * 10**10 + 1)]
    df = spark.createDataFrame(counts, collocations.COUNTS)
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: df)
    a = 2 * 10**10 + 1
    row = collocations.collocations(df).first()
    assert row.score == 1_000_000 * a * a // (12 * 10**20) and row.a == a


def test_empty_table(spark):
    df = frame_of(spark, [("en", "a b")]).filter(F.lit(False))
    assert collocations.collocations(df).collect() == []
