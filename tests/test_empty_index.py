"""With an empty index there is nothing to search for: no vector is made."""

from test_costs import counting, seen

from passagework.operators.context import enrich
from passagework.operators.embedding import ModelEmbedder
from passagework.sources.index_store import empty_index

QUESTIONS = [(1, "one?"), (2, None), (3, "...")]


def test_an_empty_index_needs_no_vectors(spark, tmp_path):
    record = str(tmp_path / "seen")
    embedder = ModelEmbedder([("m", counting(record, lambda t: [1.0, 2.0]))], 2)
    questions = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    found = enrich(questions, empty_index(spark), embedder)
    rows = found.orderBy("query_id").collect()
    assert seen(record) == []
    assert [(r.query_id, r.user_prompt) for r in rows] == QUESTIONS
    assert {(r.rag_status, r.rag_used, r.n_hits, r.n_passing, r.n_rejected, r.best_score)
            for r in rows} == {("empty_index", False, 0, 0, 0, None)}
    assert all(r.retrieved_chunks == [] for r in rows)


def test_given_vectors_give_the_same_columns(spark):
    questions = spark.createDataFrame(QUESTIONS, "query_id long, query string")
    vectors = spark.createDataFrame(
        [(1, "one?", [1.0, 2.0]), (2, None, None), (3, "...", [1.0])],
        "query_id long, query string, embedding array<float>",
    )
    embedder = ModelEmbedder([("m", lambda: lambda texts: [[1.0, 2.0]] * len(texts))], 2)
    made = enrich(questions, empty_index(spark), embedder)
    given = enrich(vectors, empty_index(spark))
    assert made.dtypes == given.dtypes
    assert sorted(map(repr, made.collect())) == sorted(map(repr, given.collect()))
