"""Streams against the batch results of the same files."""

import pytest

from passagework.catalog import ingestion
from passagework.operators.chunking import index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.operators.history import prompt_history
from passagework.sources.documents import read_documents
from passagework.sources.index_store import (
    append_index,
    clear_index,
    load_index,
    without_repeats,
)
from passagework.sources.turn_log import append_turns, load_turns, reset_turns
from passagework.streaming.index_stream import document_files, stream_index
from passagework.streaming.turn_stream import stream_turns, turn_files

EMBEDDER = HashedEmbedder(16)


def rows(df):
    return sorted(
        (r.chunk_id, r.doc_id, r.chunk_no, r.text, r.metadata.source, r.embedding)
        for r in df.collect()
    )


def test_documents_in_two_drops(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        stream_index(document_files(spark, source), index, checkpoint, EMBEDDER).awaitTermination()

    (tmp_path / "in/a.txt").write_text("alpha beta " * 100)
    run()
    assert load_index(spark, index).select("doc_id").distinct().count() == 1
    (tmp_path / "in/sub").mkdir()
    (tmp_path / "in/sub/b.md").write_text("gamma")
    (tmp_path / "in/c.bin").write_bytes(b"skipped")
    run()
    run()  # nothing new: nothing added
    batch = index_documents(read_documents(spark, source, recursive=True), EMBEDDER)
    assert rows(load_index(spark, index, EMBEDDER.name)) == rows(batch)


def test_messages_in_two_drops(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    (tmp_path / "in").mkdir()

    def drop(name, turns):
        lines = [f'{{"conv_id": "c", "turn": {t}, "role": "user", "content": "m{t}"}}' for t in turns]
        (tmp_path / "in" / name).write_text("\n".join(lines))
        stream_turns(turn_files(spark, source), log, checkpoint).awaitTermination()

    drop("one.json", range(3))
    drop("two.json", range(3, 30))
    history = prompt_history(load_turns(spark, log)).first().history
    assert [m.content for m in history] == [f"m{t}" for t in range(10, 30)]
    assert load_turns(spark, log).count() == 30


def test_a_streamed_index_is_appended_to_and_cleared(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    (tmp_path / "in").mkdir()

    def arrive(name, text):
        (tmp_path / "in" / name).write_text(text)
        stream_index(document_files(spark, source), index, checkpoint, EMBEDDER).awaitTermination()

    arrive("a.txt", "alpha")
    more = spark.createDataFrame([("z", "omega")], "doc_id string, text string")
    assert append_index(index_documents(more, EMBEDDER), index) == 1
    arrive("b.txt", "beta")
    assert {r.text for r in load_index(spark, index).collect()} == {"alpha", "omega", "beta"}
    clear_index(spark, index)
    assert load_index(spark, index).count() == 0
    arrive("c.txt", "gamma")
    assert {r.text for r in load_index(spark, index).collect()} == {"gamma"}


def test_a_streamed_log_is_appended_to_and_reset(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("in", "log", "checkpoint"))
    (tmp_path / "in").mkdir()

    def arrive(name):
        line = f'{{"conv_id": "c", "turn": 1, "role": "user", "content": "{name}"}}'
        (tmp_path / "in" / name).write_text(line)
        stream_turns(turn_files(spark, source), log, checkpoint).awaitTermination()

    arrive("a.json")
    append_turns(spark.createDataFrame([("c", 2, "user", "more")], "conv_id string, turn int, role string, content string"), log)
    arrive("b.json")
    assert {r.content for r in load_turns(spark, log).collect()} == {"a.json", "more", "b.json"}
    reset_turns(spark, log)
    arrive("c.json")
    assert {r.content for r in load_turns(spark, log).collect()} == {"c.json"}


@pytest.mark.parametrize("files", [1, 3])
def test_tables_stream_as_one_file_or_as_a_folder_of_files(spark, tmp_path, files):
    conversations = [(c, t, "user", f"said {c} {t}") for c in range(4) for t in range(3)]
    documents = [(i, f"text {i} of some words", "src") for i in range(5)]
    for name, rows_of, schema in (
        ("conversations", conversations, "conv_id bigint, turn bigint, role string, text string"),
        ("documents", documents, "doc_id bigint, text string, source string"),
    ):
        table = spark.createDataFrame(rows_of, schema).repartition(files)
        folder = tmp_path / f"{name}.parquet"
        if files > 1:
            table.write.parquet(str(folder))
        else:
            table.toPandas().to_parquet(folder)
    turns = ingestion.q_stream_turns(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.content) for r in turns) == sorted((c, m) for c, _, _, m in conversations)
    index = ingestion.q_stream_index(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in index) == [text for _, text, _ in documents]


def test_rows_without_repeats_stay_where_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    index = index_documents(rows, EMBEDDER)
    key = ["model_name", "chunk_id"]
    plan = without_repeats(index, key)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    assert without_repeats(index.unionAll(index), key).count() == 50
    twice = index.unionAll(index)
    assert append_index(twice, str(tmp_path / "a"), skip_existing=True) == 50
    assert append_index(twice, str(tmp_path / "a"), skip_existing=True) == 0
