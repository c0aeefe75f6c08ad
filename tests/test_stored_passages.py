"""Many questions: passages and vectors are written once, however many questions meet them."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagework.operators import agents, cells, context
from passagework.operators.context import enrich
from passagework.operators.nearest import Best
from passagework.plans.answer import answer_queries
from passagework.sources import text_store
from passagework.sources.text_store import store_texts, texts_at
from passagework.sources.vector_blocks import read_block, write_blocks


class Numbers:
    """Embeds a text by the number at its end."""

    dim, name = 1, "numbers"

    def vector(self, col):
        number = f"try_cast(element_at(split({col}, ' '), -1) as float)"
        return F.expr(f"if({number} is null, null, array({number}))")


@pytest.fixture
def index(spark):
    rows = [
        (f"c{i}", None if i == 7 else f"passage {'x' * (50 * i)} é {i}", ("s", "T" * (i % 2), None), [float(i)])
        for i in range(30)
    ]
    rows += [rows[3], ("c40", "", ("t", "", "d"), [40.0]), (None, "lost", None, [12.0])]
    return spark.createDataFrame(
        rows,
        "chunk_id string, text string, metadata struct<source:string,ticker:string,date:string>, "
        "embedding array<float>",
    )


@pytest.fixture
def questions(spark):
    rows = [(i, f"what is near {i / 2}") for i in range(90)]
    rows += [(7, "again 3.5"), (None, "who 1"), (95, "none")]
    return spark.createDataFrame(rows, "query_id long, query string")


def rows_of(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in df.collect())


def test_stored_passages_give_the_same_rows(spark, index, questions, monkeypatch):
    def found():
        return rows_of(enrich(questions, index, Numbers(), k=3, max_distance=2.0, dim=1))

    wanted = found()
    assert {json.loads(r)["rag_status"] for r in wanted} == {"ok", "low_confidence", "error", "no_match"}
    monkeypatch.setattr(context, "MIN_QUESTIONS", 10)
    assert found() == wanted
    monkeypatch.setattr(context, "MAX_BROADCAST_HITS", 0)  # all texts are stored
    assert found() == wanted


def echo():
    return lambda prompts: list(prompts)


def test_passages_are_read_where_the_prompts_are_answered(spark, index, questions, monkeypatch):
    def answered(columns):
        return answer_queries(questions, index, {"sentiment": echo, "multitask": echo},
                              embedder=Numbers(), dim=1, columns=columns)

    wanted = {columns: rows_of(answered(columns)) for columns in (("answer",), ("answer", "retrieved_chunks"))}
    monkeypatch.setattr(context, "MIN_QUESTIONS", 10)
    for columns, rows in wanted.items():
        df = answered(columns)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # What is shuffled has places: the texts come in above, with the model or before it.
        read = "ArrowEvalPython" if len(columns) > 1 else "MapInArrow"
        assert plan.index("MapInArrow") <= plan.index(read) < plan.index("Exchange")
        assert "place" in plan and plan.count("ArrowEvalPython") == len(columns) - 1
        assert rows_of(df) == rows


def test_texts_come_back_by_their_places(spark, monkeypatch):
    texts = ["", "a", None, "é" * 3000, "long " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    placed, folder = store_texts(df, "texts")
    assert placed.columns == ["id", "place"]
    places = {r.id: r.place for r in placed.collect()}
    assert places[2] is None
    asked = [[0, 1, 2, 3, 4], [4, 4, 3], [], None, [2]]
    rows = [(i, None if a is None else [places[j] for j in a]) for i, a in enumerate(asked)]
    lists = spark.createDataFrame(rows, f"i long, places array<{text_store.PLACE}>").coalesce(1)
    got = {r.i: r.t for r in lists.select("i", texts_at(F.col("places"), folder).alias("t")).collect()}
    wanted = {i: None if a is None else [texts[j] for j in a] for i, a in enumerate(asked)}
    assert got == wanted
    # The same with nothing kept, one file open and a row at a time.
    for name in ("KEPT_BYTES", "SLICE_BYTES"):
        monkeypatch.setattr(text_store, name, 0)
    monkeypatch.setattr(text_store, "OPEN_FILES", 1)
    batch = pa.array([p for _, p in rows], pa.list_(pa.struct(list(text_store.PARTS.items()))))
    reader = text_store.TextReader(folder)
    parts = [reader.texts(part) for part in text_store._slices(batch)]
    assert pa.concat_arrays(parts).to_pylist() == list(wanted.values())
    assert len(reader.files) == 1 and not reader.kept
    reader.close()


def test_vectors_are_written_once_for_all_meetings(spark, tmp_path, monkeypatch):
    """Three shards and five blocks of questions: neither side is copied for the other."""
    rng = np.random.default_rng(3)
    points = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))]
    df = spark.createDataFrame(points, "id long, v array<double>")
    monkeypatch.setattr(cells, "PART_ROWS", 32)
    monkeypatch.setattr(cells, "shared_folder", lambda spark, purpose: f"file://{tmp_path}/{purpose}")
    schema = T.StructType.fromDDL("query_id long, chunk_id long, score double")
    found = cells.search_cells(df.where("id < 40"), df, 3, 4, schema, shard_rows=50)
    store, root = cells.shared_files(f"file://{tmp_path}/search-blocks")
    held = [sum(b.num_rows for b in read_block(store, root, f, 7)) for f in os.listdir(root)]
    assert sum(held) == 160 and len(held) > 5
    best = {r.query_id: r.chunk_id for r in found.orderBy("query_id", F.desc("score")).collect()}
    assert best == {i: i for i in range(40)}


def test_a_block_file_has_rows_of_one_block(spark, tmp_path):
    rows = [(b, i, [float(i)]) for b in (2, 5) for i in range(25)]
    df = spark.createDataFrame(rows, "block int, id long, v array<double>").coalesce(1)
    files = write_blocks(df, f"file://{tmp_path}/b", 10)
    assert sorted((f.block, f.n) for f in files) == [(2, 5), (2, 10), (2, 10), (5, 5), (5, 10), (5, 10)]
    store, root = cells.shared_files(f"file://{tmp_path}/b")
    ids = [i for f in files if f.block == 5 for b in read_block(store, root, f.file, 4) for i in b["id"].to_pylist()]
    assert sorted(ids) == list(range(25))


def test_rows_nearer_than_all_before_are_not_all_compared(monkeypatch):
    rng = np.random.default_rng(4)
    asked = rng.normal(size=(40, 8))
    far, near = 100 + rng.normal(size=(200, 8)), rng.normal(size=(2000, 8))
    compared = []
    merge = Best._merge
    monkeypatch.setattr(Best, "_merge", lambda self, rows, *a: (compared.append(len(rows)), merge(self, rows, *a)))
    best = Best(list(range(40)), asked, 3)
    best.add(list(range(200)), far)
    best.add(list(range(200, 2200)), near)
    distances = ((asked[:, None] - near[None]) ** 2).sum(axis=2)
    assert (best.hits == 200 + np.argsort(distances, axis=1)[:, :3]).all()
    assert sum(compared) < 40 * 50  # 40 x 2,000 rows are nearer than the first 200


def test_long_prompts_become_python_objects_in_parts(monkeypatch):
    monkeypatch.setattr(agents, "PROMPT_BYTES", 1000)
    prompts = ["x" * 100] * 50 + [None, "y" * 5000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(prompts)], names=["prompt"])
    parts = [p["prompt"].to_pylist() for p in agents._parts(batch, "prompt")]
    assert sum(parts, []) == prompts and len(parts[0]) == 10 and parts[-1] == ["z"]
    assert [p.num_rows for p in agents._parts(batch.slice(0, 0), "prompt")] == [0]
