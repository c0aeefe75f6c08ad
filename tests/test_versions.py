"""The versioned index: replaced and deleted documents, and changes seen whole or not at all."""

import pytest

from passagework.operators.chunking import index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.sources import index_versions as iv
from passagework.sources.files import exists, names, publish, read_text
from passagework.streaming.index_stream import document_files, stream_documents

EMBEDDER = HashedEmbedder(8)


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    return index_documents(docs, EMBEDDER)


def ids(spark, *doc_ids):
    return spark.createDataFrame([(i,) for i in doc_ids], "doc_id string")


def texts_in(spark, path, version=None):
    found = iv.load_version(spark, path, version=version).collect()
    return sorted((r.doc_id, r.text) for r in found)


def test_replace_delete_and_go_back(spark, tmp_path):
    path = str(tmp_path / "index")
    assert texts_in(spark, path) == []
    assert iv.put_documents(rows_of(spark, {"a": "one", "b": "two", "c": "x" * 600}), path) == 1
    assert iv.put_documents(rows_of(spark, {"b": "new", "d": "four"}), path) == 2
    assert iv.delete_documents(ids(spark, "a", "zzz"), path) == 3
    now = texts_in(spark, path)
    assert [d for d, _ in now] == ["b", "c", "c", "d"] and ("b", "new") in now
    assert texts_in(spark, path, 1)[:2] == [("a", "one"), ("b", "two")]
    iv.put_documents(rows_of(spark, {"a": "back"}), path)
    assert ("a", "back") in texts_in(spark, path)
    with pytest.raises(ValueError):
        iv.load_version(spark, path, version=9)
    assert iv.load_version(spark, path, "another").count() == 0


def test_a_failed_change_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    iv.put_documents(rows_of(spark, {"a": "one"}), path)

    def stopped(*_):
        raise RuntimeError("stopped before the swap")

    with monkeypatch.context() as m:
        m.setattr(iv, "publish", stopped)
        with pytest.raises(RuntimeError):
            iv.put_documents(rows_of(spark, {"a": "two", "b": "new"}), path)
    assert texts_in(spark, path) == [("a", "one")] and len(names(spark, f"{path}/rows")) == 2
    iv.put_documents(rows_of(spark, {"a": "two"}), path)
    assert texts_in(spark, path) == [("a", "two")]
    assert iv.vacuum(spark, path, keep=1) >= 1
    assert texts_in(spark, path) == [("a", "two")] and iv.versions(spark, path) == [2]


def test_writers_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    iv.put_documents(rows_of(spark, {"a": "one"}), path)
    taken = []

    def late(spark, file, text):
        if not taken:  # another writer gets the number first
            taken.append(1)
            iv.put_documents(rows_of(spark, {"b": "two"}), path)
        return publish(spark, file, text)

    monkeypatch.setattr(iv, "publish", late)
    assert iv.put_documents(rows_of(spark, {"c": "three"}), path) == 3
    assert [d for d, _ in texts_in(spark, path)] == ["a", "b", "c"]


def test_compaction_keeps_later_changes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    iv.put_documents(rows_of(spark, {"a": "one", "b": "two"}), path)
    iv.put_documents(rows_of(spark, {"b": "new"}), path)
    between = []

    def late(spark, file, text):
        if not between:
            between.append(1)
            iv.delete_documents(ids(spark, "a"), path)
        return publish(spark, file, text)

    with monkeypatch.context() as m:
        m.setattr(iv, "publish", late)
        iv.compact(spark, path)
    assert texts_in(spark, path) == [("b", "new")]
    version = iv.compact(spark, path)
    assert texts_in(spark, path, version) == [("b", "new")]
    assert iv.compact(spark, path) == version
    assert iv.clear_versions(spark, path) == version + 1 and texts_in(spark, path) == []
    iv.put_documents(rows_of(spark, {"a": "again"}), path)
    assert texts_in(spark, path) == [("a", "again")]


def test_stream_replaces_and_repeats_nothing(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / n) for n in ("in", "index", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        stream_documents(document_files(spark, source), index, checkpoint, EMBEDDER).awaitTermination()

    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "in/b.txt").write_text("beta")
    run()
    (tmp_path / "in/c.txt").write_text("gamma")
    run()
    run()
    assert sorted(t for _, t in texts_in(spark, index)) == ["alpha", "beta", "gamma"]
    assert len(iv.versions(spark, index)) == 2
    rows = rows_of(spark, {"a": "other"})
    stream = sorted(iv._manifest(spark, index, None)[1]["streams"].items())[0]
    assert iv.put_documents(rows, index, stream=stream) == 2  # put before: no new version


def test_ticker_refresh_is_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "doc_id string, text string, metadata struct<source:string,ticker:string,date:string>"

    def profiles(*rows):
        return spark.createDataFrame([(d, t, ("m", d.split("/")[0], None)) for d, t in rows], schema)

    def tickers(*names):
        return spark.createDataFrame([(n,) for n in names], "ticker string")

    def make(docs):
        return index_documents(docs, EMBEDDER, auto_chunk=False)

    old = profiles(("A/quarterly/1", "a1"), ("A/quarterly/2", "a2"), ("B/news/1", "b"))
    iv.refresh_tickers(tickers("A", "B"), old, path, make)
    before = texts_in(spark, path)
    new = profiles(("A/quarterly/2", "a2!"), ("A/quarterly/3", "a3"), ("B/news/1", "b!"))
    with pytest.raises(iv.TickerSectionMissing, match="C"):
        iv.refresh_tickers(tickers("A", "C"), new, path, make)
    assert texts_in(spark, path) == before
    iv.refresh_tickers(tickers("A"), new, path, make)
    assert texts_in(spark, path) == [("A/quarterly/2", "a2!"), ("A/quarterly/3", "a3"), ("B/news/1", "b")]


def test_publish(spark, tmp_path):
    path = str(tmp_path / "x" / "1.json")
    assert publish(spark, path, "é") and not publish(spark, path, "b")
    assert read_text(spark, path) == "é" and exists(spark, path)
    assert names(spark, str(tmp_path / "x")) == ["1.json"] and names(spark, str(tmp_path / "y")) == []


def test_wanted_tickers_are_made_once(spark, tmp_path):
    path, made = str(tmp_path / "tickers"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "doc_id string, text string, metadata struct<source:string,ticker:string,date:string>"
    profiles = spark.createDataFrame([("A/news/1", "a", ("m", "A", None))], schema)
    wanted = spark.createDataFrame([("A",)], "ticker string").mapInArrow(counted, "ticker string")
    iv.refresh_tickers(
        wanted, profiles, path, lambda docs: index_documents(docs, EMBEDDER, auto_chunk=False)
    )
    assert texts_in(spark, path) == [("A/news/1", "a")] and made.value == 1
