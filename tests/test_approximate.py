"""Approximate search beside the exact one: recall, exact scores, and odd inputs."""

import numpy as np
import pytest

from passagework.operators.approximate import approximate_knn, build_cells, load_cells, recall
from passagework.operators.cells import shards_of
from passagework.operators.search import knn

DIM = 16


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, DIM)) * 3
    points = centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, DIM))
    points[:600] = points[0]  # one vector that more than a third of the rows have
    rows = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    odd = [(9001, None), (9002, [1.0]), (9003, [float("nan")] * DIM)]
    schema = "chunk_id long, embedding array<float>"
    return spark.createDataFrame(rows + odd, schema).repartition(4)


@pytest.fixture(scope="module")
def stored(spark, vectors, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('cells')}/index"
    build_cells(vectors, path, 24)
    return path


def hits(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())


def questions(vectors):
    return vectors.withColumnRenamed("chunk_id", "query_id").where("query_id % 3 = 0")


def test_recall_on_few_cells(spark, vectors, stored):
    exact = knn(questions(vectors), vectors, 5)
    found = approximate_knn(questions(vectors), stored, 5, probes=6, shard_rows=100)
    row = recall(found, exact).first()
    assert row.n_exact == 5 * questions(vectors).where("query_id < 9000").count()
    assert row.recall >= 0.9
    scores = {(q, c): s for q, _, c, s in hits(exact)}
    for q, _, c, s in hits(found):
        assert scores.get((q, c), s) == s  # exact whatever the codes say


def test_all_cells_are_exact(spark, vectors, stored):
    few = questions(vectors).where("query_id >= 600")
    found = approximate_knn(few, stored, 5, probes=1000, refine=30)
    assert hits(found) == hits(knn(few, vectors, 5))


def test_cells_hold_every_usable_row(spark, stored):
    cells = load_cells(spark, stored)
    assert cells.rows.sum() == 1500 and len(cells.centres) <= 24
    points = np.random.default_rng(5).normal(size=(50, DIM))
    place = cells.place(points)
    inside = np.stack([cells.decode(cells.code(p[None], c), int(c[0])) for p, c in
                       zip(points, place[:, None])])[:, 0]
    low, high = cells.centres[place] + cells.low, cells.centres[place] + cells.low + 255 * cells.step
    assert (np.abs(inside - np.clip(points, low, high)) <= cells.step / 2 + 1e-9).all()


def test_nothing_to_search(spark, vectors, stored, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    assert build_cells(none, str(tmp_path / "empty")) is None
    odd = questions(vectors).where("query_id > 9000")
    assert approximate_knn(odd, stored, 5).collect() == []


def test_an_index_finds_how_many_cells_its_vectors_need(spark, tmp_path):
    """Vectors without clusters: a fixed number of cells misses most of the nearest."""
    points = np.random.default_rng(11).normal(size=(1500, 32)).astype(np.float32)
    rows = spark.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(points)], "chunk_id long, embedding array<float>"
    )
    path = f"file://{tmp_path}/index"
    cells = build_cells(rows, path, 150)
    assert cells.probes > 16 and load_cells(spark, path).probes == cells.probes
    asked = questions(rows)
    exact = knn(asked, rows, 5)
    assert recall(approximate_knn(asked, path, 5), exact).first().recall >= 0.9
    assert recall(approximate_knn(asked, path, 5, probes=16), exact).first().recall < 0.9


def test_a_question_is_sent_once_to_a_shard_of_many_cells():
    assert shards_of([3, 4, 25, 2, 9, 0], 10) == [(0, 0), (0, 0), (1, 3), (4, 4), (5, 5), (5, 5)]
