"""Chunking, embedding, search and enrichment against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.functions.fixed_values import BASE_SYSTEM
from passagework.operators import cells, context
from passagework.operators.cells import Cells
from passagework.operators.chunking import (
    chunk_documents,
    chunk_pages,
    index_documents,
    split_pages,
)
from passagework.operators.context import enrich, first_warning
from passagework.operators.embedding import HashedEmbedder, ModelEmbedder, embed
from passagework.operators.search import knn
from passagework.session import written
from passagework.sources.index_store import append_index, empty_index, load_index


def expected_chunks(text, size, overlap):
    starts = range(0, len(text), size - overlap)
    cut = [text[s : s + size].strip() for s in starts]
    return [c for c in cut if c]


@pytest.mark.parametrize(("size", "overlap"), [(512, 64), (10, 0), (10, 4), (10, 8), (7, 6)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size * 100 + overlap)
    alphabet = "ab \t\n \U0001f600é"
    lengths = [0, 1, 9, 10, 11, 447, 448, 449, 512, 513, 2000]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in lengths]
    texts += [" \n\t" * 300, "x" * 448 + "   ", "a" * 447 + "\n\tb" * 20, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for row in chunk_documents(docs, size, overlap).orderBy("doc_id", "chunk_no").collect():
        assert row.chunk_no == len(got.setdefault(row.doc_id, []))
        got[row.doc_id].append(row.text)
    for i, text in enumerate(texts):
        assert got.get(i, []) == expected_chunks(text or "", size, overlap)


def test_chunk_size_is_checked(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="larger than overlap"):
        chunk_documents(docs, 64, 64)


def test_pages_are_chunked_on_their_own(spark):
    docs = spark.createDataFrame([(1, "a" * 500 + "\f" + "b" * 10 + "\f")], "doc_id long, text string")
    got = chunk_pages(split_pages(docs)).orderBy("page_no", "chunk_no").collect()
    assert [(r.page_no, r.chunk_no, len(r.text)) for r in got] == [(0, 0, 500), (0, 1, 52), (1, 0, 10)]


def test_index_rows(spark):
    docs = spark.createDataFrame(
        [(1, "one two " * 100, ("a.txt", "T", None)), (2, "", ("b.txt", None, None))],
        "doc_id long, text string, metadata struct<source:string,ticker:string,date:string>",
    )
    chunked = index_documents(docs, HashedEmbedder()).collect()
    whole = index_documents(docs, HashedEmbedder(), auto_chunk=False).collect()
    assert len(chunked) == 2 and {r.metadata.source for r in chunked} == {"a.txt"}
    assert len(whole) == 2 and {r.text for r in whole} == {"one two " * 100, ""}
    assert len({r.chunk_id for r in chunked}) == 2


def test_hashed_vectors(spark):
    texts = ["the cat, the dog", "THE CAT THE DOG!", "", "...", None, "el niño"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.embedding for r in embed(docs, "text", HashedEmbedder(32)).collect()}
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-6
    assert got[2] is None and got[3] is None and got[4] is None and len(got[5]) == 32


def load_lengths():
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def load_nothing():
    raise OSError("not cached")


def test_model_embedder_falls_back(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "i int, text string")
    embedder = ModelEmbedder([("primary", load_nothing), ("fallback", load_lengths)], 2)
    got = {r.i: (r.embedding, r.model_name) for r in embed(docs, "text", embedder).collect()}
    assert got == {1: ([3.0, 1.0], "fallback"), 2: (None, "fallback"), 3: ([0.0, 1.0], "fallback")}
    with pytest.raises(RuntimeError, match="none of the embedding models"):
        embed(docs, "text", ModelEmbedder([("primary", load_nothing)], 2))


def squared(a, b):
    total = 0.0  # a plain fold: sum() compensates for rounding
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return total


def brute_force(queries, index, k):
    out = set()
    for q, qv in queries:
        scored = sorted((squared(qv, xv), x) for x, xv in index)
        out |= {(q, x, s, rank) for rank, (s, x) in enumerate(scored[:k], 1)}
    return out


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, embedding array<double>")


def search(spark, queries, index, k, **options):
    q, x = vectors(spark, queries, "query_id"), vectors(spark, index, "chunk_id")
    return {
        (r.query_id, r.chunk_id, r.score, r["rank"]) for r in knn(q, x, k, **options).collect()
    }


@pytest.fixture(scope="module")
def clustered():
    """Clusters, plus a third of all rows being copies of one vector."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 5
    points = centres[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8))
    index = [(i, v.tolist()) for i, v in enumerate(points)]
    index += [(1000 + i, points[0].tolist()) for i in range(200)]
    queries = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(30)]
    queries.append((99, points[0].tolist()))
    return queries, index


@pytest.mark.parametrize("k", [1, 5, 700])
@pytest.mark.parametrize(
    "options",
    [{}, {"max_broadcast_bytes": 1, "shard_rows": 50}, {"max_broadcast_bytes": 1, "pivots": 3}],
    ids=["broadcast", "cells", "few pivots"],
)
def test_search_is_exact(spark, clustered, k, options):
    queries, index = clustered
    assert search(spark, queries, index, k, **options) == brute_force(queries, index, k)


def test_far_cells_are_left_out():
    """Two tight cells far apart: a question visits only its own."""
    centres = np.array([[0.0, 0.0], [100.0, 0.0]])
    radii = np.array([[0.0, 0.5, 1.0], [0.0, 0.5, np.inf]])
    cells = Cells(centres, np.array([0, 1]), np.array([3, 2]), np.zeros(2), np.ones(2), radii)
    questions = np.array([[1.0, 1.0], [99.0, 0.0], [50.0, 0.0]])
    assert [c.tolist() for c in cells.reachable(questions, 2)] == [[0], [1], [0, 1]]
    assert cells.reachable(questions, 3)[1].tolist() == [0, 1]  # its own holds only two


def test_questions_meet_a_shard_in_parts_of_bounded_size(spark, clustered, monkeypatch):
    queries, index = clustered
    monkeypatch.setattr(cells, "PART_ROWS", 1)
    q, x = vectors(spark, queries, "query_id"), vectors(spark, index, "chunk_id")
    found = cells.search_cells(
        q.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")),
        x.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v")), 3, 8,
        T.StructType.fromDDL("query_id long, chunk_id long, score double"), shard_rows=10_000,
    )
    assert found.rdd.getNumPartitions() == len(queries)  # one shard, a task per part
    assert search(spark, queries, index, 3, max_broadcast_bytes=1) == brute_force(queries, index, 3)


@pytest.mark.parametrize("size", [1.0, 1e-25, 1e25, 1e150])
def test_distances_of_any_size_and_nearly_equal_ones(spark, size):
    """Beyond what single precision tells apart, and beyond its range."""
    rng = np.random.default_rng(2)
    points = size * (1.0 + 1e-9 * rng.normal(size=(300, 4)))
    index = [(i, v.tolist()) for i, v in enumerate(points)]
    queries = index[:20]
    for options in ({}, {"max_broadcast_bytes": 1}):
        assert search(spark, queries, index, 4, **options) == brute_force(queries, index, 4)


def test_no_plan_multiplies_the_sides(spark, clustered):
    queries, index = clustered
    q, x = vectors(spark, queries, "query_id"), vectors(spark, index, "chunk_id")
    for options in ({}, {"max_broadcast_bytes": 1}):
        plan = knn(q, x, 2, **options)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 1}])
def test_unusable_vectors_take_no_part(spark, options):
    index = [(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 0.0]),
             (6, [1.0, 1.0])]
    queries = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0]), (4, [None, 0.0])]
    got = search(spark, queries, index, 5, **options)
    assert got == {(1, 1, 1.0, 1), (1, 6, 2.0, 2)}


def test_search_does_not_depend_on_partitions(spark, clustered):
    queries, index = clustered
    q, x = vectors(spark, queries, "query_id"), vectors(spark, index, "chunk_id")
    rows = [
        sorted(tuple(r) for r in knn(q.repartition(n), x.repartition(n), 4).collect())
        for n in (1, 7)
    ]
    assert rows[0] == rows[1]


def small_index(spark):
    rows = [
        ("a", "alpha", ("a.txt", "T", "2024-01-01"), [0.0, 0.0]),
        ("b", "beta", (None, "", None), [1.0, 0.0]),
        ("c", "gamma", ("c.txt", None, None), [0.0, 1.5]),
    ]
    return spark.createDataFrame(
        rows,
        "chunk_id string, text string, metadata struct<source:string,ticker:string,date:string>, "
        "embedding array<double>",
    )


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query string, embedding array<double>")


def test_enrich_statuses(spark):
    queries = asked(
        spark,
        [(1, "near", [0.0, 0.0]), (2, "far", [9.0, 9.0]), (3, "null", None), (4, "size", [1.0])],
    )
    got = {r.query_id: r for r in enrich(queries, small_index(spark), max_distance=1.0).collect()}
    assert [got[i].rag_status for i in (1, 2, 3, 4)] == ["ok", "low_confidence", "error", "error"]
    assert [c.chunk_id for c in got[1].retrieved_chunks] == ["a", "b"]  # 1.0 is still in
    assert "[1] source=a.txt ticker=T date=2024-01-01\nalpha\n\n[2] source=unknown\nbeta\n---" in (
        got[1].system_prompt
    )
    assert got[1].rag_used and got[1].n_rejected == 1 and got[1].rag_warning is None
    assert got[2].system_prompt == BASE_SYSTEM and len(got[2].retrieved_chunks) == 3
    assert got[3].retrieved_chunks == [] and not got[3].rag_used
    assert all(got[i].user_prompt == got[i].query for i in got)


def test_enrich_without_index_or_candidates(spark):
    queries = asked(spark, [(1, "q", [0.0, 0.0]), (2, "r", None)])
    empty = enrich(queries, empty_index(spark)).collect()
    assert {r.rag_status for r in empty} == {"empty_index"}
    nothing = enrich(queries, small_index(spark), k=0).collect()
    assert {r.query_id: r.rag_status for r in nothing} == {1: "no_match", 2: "error"}


def test_only_one_notice_per_session(spark):
    rows = [("s", i, "empty_index") for i in range(1000)] + [("t", 5, "ok"), ("u", 3, "empty_index")]
    results = spark.createDataFrame(rows, "session string, turn int, rag_status string")
    got = first_warning(results, "session", "turn").select("session", "turn").collect()
    assert sorted(map(tuple, got)) == [("s", 0), ("u", 3)]


def test_texts_are_joined_without_shuffling_the_index(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.range(200).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("word number "), "id").alias("text")
    )
    append_index(index_documents(docs, HashedEmbedder()), path)
    queries = spark.createDataFrame([(1, "word number 7")], "query_id long, query string")
    plan = enrich(queries, load_index(spark, path), HashedEmbedder())
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin [chunk_id" in text
    assert "BroadcastNestedLoopJoin" not in text


def load_picky():
    def encode(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return encode


def test_a_refused_question_has_status_error_and_the_others_go_on(spark):
    embedder = ModelEmbedder([("picky", load_picky)], 2)
    rows = [("a", "xyz"), ("b", "uvwx")]
    index = index_documents(spark.createDataFrame(rows, "doc_id string, text string"), embedder)
    queries = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "abcd")], "query_id int, query string")
    got = {r.query_id: r.rag_status for r in enrich(queries, index, embedder, k=1).collect()}
    assert got[2] == "error" and got[1] == got[3] != "error"


def test_chunk_ids_do_not_collide(spark):
    embedder = HashedEmbedder(4)
    plain = spark.createDataFrame([("1:2", "same")], "doc_id string, text string")
    paged = spark.createDataFrame([("1", 2, "same")], "doc_id string, page_no int, text string")
    ids = {r.chunk_id for d in (plain, paged) for r in index_documents(d, embedder).collect()}
    assert len(ids) == 2


class CountingModel:
    """A model of two numbers per text that notes how often it is asked for one."""

    def __init__(self, path):
        self.path = path

    def __call__(self):
        def encode(texts):
            with open(self.path, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode


@pytest.mark.parametrize("options", [{}, {"max_broadcast_bytes": 1, "shard_rows": 20}])
def test_a_model_makes_each_vector_once(spark, tmp_path, options):
    embedder = ModelEmbedder([("counting", CountingModel(str(tmp_path / "asked")))], 2)
    metadata = "CAST(NULL AS struct<source:string,ticker:string,date:string>) AS metadata"
    docs = spark.range(90).selectExpr("id AS doc_id", "concat('text ', repeat('x', int(id))) AS text", metadata)
    asked = spark.range(30).selectExpr("id AS query_id", "concat('question ', repeat('x', int(id))) AS query")
    index = index_documents(docs, embedder, auto_chunk=False)
    index = written(index, "index") if not options else index
    if options:
        hits = knn(written(asked.withColumn("embedding", embedder.vector("query")), "q"), index, 3,
                   dim=2, **options)
        assert hits.count() == 90
    else:
        assert enrich(asked, index, embedder, 3, dim=2).collect()
    lines = (tmp_path / "asked").read_text().splitlines()
    assert sorted(lines) == sorted(set(lines)) and len(lines) == 120


def test_questions_with_one_vector_share_their_passages(spark, monkeypatch):
    asked = [(i, ["alpha beta", "beta, ALPHA!", "gamma", "...", None, "nothing of it"][i % 6])
             for i in range(60)]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    docs = spark.createDataFrame(
        [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha")], "doc_id long, text string"
    )
    index = index_documents(docs, HashedEmbedder())
    asked_for = []
    plain = context.knn

    def counted(questions, *rest, **options):
        asked_for.append(questions.count())
        return plain(questions, *rest, **options)

    monkeypatch.setattr(context, "knn", counted)
    each = enrich(queries, index, HashedEmbedder()).orderBy("query_id").collect()
    monkeypatch.setattr(context, "MIN_QUESTIONS", 10)
    together = enrich(queries, index, HashedEmbedder()).orderBy("query_id")
    assert [r.asDict() for r in together.select(each[0].__fields__).collect()] == [
        r.asDict() for r in each
    ]
    monkeypatch.setattr(context, "MAX_BROADCAST_CHARS", 0)
    assert enrich(queries, index, HashedEmbedder()).count() == 60
    assert asked_for == [60, 3, 3]
