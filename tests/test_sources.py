"""Files, the index store, logs, reports and ticker profiles."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from passagework.operators.chunking import index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.operators.history import prompt_history
from passagework.operators.tickers import ticker_profiles
from passagework.plans.answer import answer_queries, new_turns
from passagework.plans.batch import run_batch
from passagework.session import shared_folder, spread
from passagework.sources.documents import read_documents, read_split, write_splits
from passagework.sources.index_store import (
    append_index,
    clear_index,
    empty_index,
    index_status,
    ingest_summary,
    load_index,
)
from passagework.sources.query_files import read_queries, write_results
from passagework.sources.reports import read_report, write_report
from passagework.sources.turn_log import (
    append_turns,
    count_bad_turns,
    load_turns,
    reset_turns,
)


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def json_lines(folder):
    lines = []
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                lines += [json.loads(line) for line in f]
    return lines


def test_read_documents(spark, tmp_path):
    write(tmp_path / "a.txt", "one\ntwo\r\n")
    write(tmp_path / "deep/er/b.md", "# é")
    write(tmp_path / "deep/c.csv", "not read")
    bad = b"x\xff\xfey \xef\xbf\xbd \xc3"
    write(tmp_path / "bad.txt", bad)
    write(tmp_path / "empty.txt", "")
    flat = {os.path.basename(r.metadata.source): r for r in read_documents(spark, str(tmp_path)).collect()}
    assert set(flat) == {"a.txt", "bad.txt"}  # Spark lists no empty files; they hold no chunk
    assert flat["a.txt"].text == "one\ntwo\r\n"
    assert flat["bad.txt"].text == bad.decode("utf-8", "ignore")  # its own U+FFFD stays
    deep = read_documents(spark, str(tmp_path), recursive=True).collect()
    assert {os.path.basename(r.metadata.source) for r in deep} == {*flat, "b.md"}
    one = read_documents(spark, str(tmp_path / "a.txt"), source="given", ticker="T").first()
    assert (one.metadata.source, one.metadata.ticker) == ("given", "T")
    datetime.date.fromisoformat(one.metadata.date)


def docs(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return index_documents(spark.createDataFrame(rows, "doc_id int, text string"), HashedEmbedder(8))


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "index")
    assert load_index(spark, path).isEmpty()
    first = docs(spark, "alpha " * 100, "beta")
    assert append_index(first, path) == 3
    assert append_index(first, path, skip_existing=True) == 0
    more = docs(spark, "alpha " * 100, "beta", "gamma")
    assert append_index(more, path, skip_existing=True) == 1
    stored = load_index(spark, path)
    assert stored.count() == 4 and stored.select("chunk_id").distinct().count() == 4
    assert [tuple(r) for r in index_status(stored).collect()] == [("hashed-words-8", 4)]
    assert load_index(spark, path, "another model").isEmpty()
    assert tuple(ingest_summary(first, stored).first()) == (3, 4)
    clear_index(spark, path)
    assert load_index(spark, path).isEmpty()
    assert append_index(docs(spark, "again"), path) == 1
    assert load_index(spark, path).count() == 1


def test_a_failed_append_leaves_the_index_unchanged(spark, tmp_path):
    path = str(tmp_path / "index")
    append_index(docs(spark, "alpha"), path)
    broken = docs(spark, "beta").withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        append_index(broken, path)
    assert load_index(spark, path).count() == 1


def test_splits(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    write_splits(df, path)
    train = read_split(spark, path, "train")
    assert sorted(r.id for r in train.collect()) == [1, 3] and train.columns == ["id"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_read_queries(spark, tmp_path):
    write(tmp_path / "q.txt", "first\n\n  second \n\t\nthird")
    got = read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()
    assert [(r.query, r.error) for r in got] == [("first", None), ("second", None), ("third", None)]
    write(tmp_path / "q.jsonl", '{"query": "a"}\n\n{"query": \n{"other": 1}\n{"query": " "}\n{"query": "é"}\n')
    got = read_queries(spark, str(tmp_path / "q.jsonl")).orderBy("query_id").collect()
    assert [r.query for r in got] == ["a", None, None, None, "é"]
    assert [r.error is None for r in got] == [True, False, False, False, True]
    with pytest.raises(ValueError, match="unknown kind"):
        read_queries(spark, str(tmp_path), "csv")


def test_write_results_keeps_null_fields(spark, tmp_path):
    rows = [("q", "a", "sentiment", "ok", None, None), ("r", "half", "multitask", "ok", "w", "boom")]
    df = spark.createDataFrame(
        rows, "query string, answer string, agent_used string, rag_status string, "
        "rag_warning string, error string")
    path = str(tmp_path / "out")
    write_results(df, path)
    lines = {line["query"]: line for line in json_lines(path)}
    assert lines["q"] == {"query": "q", "answer": "a", "agent_used": "sentiment",
                          "rag_status": "ok", "rag_warning": None, "error": None}
    assert lines["r"] == {"query": "r", "answer": None, "agent_used": None,
                          "rag_status": None, "rag_warning": None, "error": "boom"}


def echo():
    return lambda prompts: [f"<think>x</think>{len(p)}" for p in prompts]


def picky():
    def answer(prompts):
        if any("poison" in p for p in prompts):
            raise ValueError("poison")
        return ["fine" for _ in prompts]

    return answer


def test_batch_of_a_file(spark, tmp_path):
    write(tmp_path / "in.jsonl",
          '{"query": "what is the tone of alpha"}\nnot json\n{"query": "poison"}\n{"query": "beta"}\n')
    out = str(tmp_path / "out")
    run_batch(spark, str(tmp_path / "in.jsonl"), out, docs(spark, "alpha beta"),
              {"sentiment": echo, "multitask": picky}, embedder=HashedEmbedder(8))
    lines = json_lines(out)
    assert len(lines) == 4 and all(set(line) == {
        "query", "answer", "agent_used", "rag_status", "rag_warning", "error"} for line in lines)
    by_query = {line["query"]: line for line in lines}
    assert by_query["beta"]["answer"] == "fine" and by_query["beta"]["error"] is None
    assert by_query["what is the tone of alpha"]["agent_used"] == "sentiment"
    assert by_query["poison"]["error"] == "ValueError: poison"
    assert by_query["poison"]["answer"] is None and by_query["poison"]["rag_status"] is None
    assert by_query[None]["error"] == "line is not a JSON object with a query"


def test_turn_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert load_turns(spark, path).isEmpty() and count_bad_turns(spark, path).first().n_bad == 0
    write(tmp_path / "log/old.jsonl",
          '{"role": "user", "content": "hi", "ts": "2024-01-01T00:00:00+00:00"}\n\n'
          '{"role": "assistant", "content": "ho", "ts": "2024-01-01T00:00:01.5+00:00"}\n')
    turns = load_turns(spark, path, on_bad="empty")
    history = prompt_history(turns, order=["ts", "line"]).first()
    assert history.conv_id == "session"
    assert [tuple(m) for m in history.history] == [("user", "hi"), ("assistant", "ho")]
    write(tmp_path / "log/new.jsonl", '{"role": "user", \n{"role": "user", "content": "later"}\n')
    assert load_turns(spark, path).count() == 3
    assert load_turns(spark, path, on_bad="empty").count() == 0
    assert count_bad_turns(spark, path).first().n_bad == 1
    reset_turns(spark, path)
    assert load_turns(spark, path).count() == 0
    with pytest.raises(ValueError, match="on_bad"):
        load_turns(spark, path, on_bad="ignore")


def test_answers_become_history(spark, tmp_path):
    path = str(tmp_path / "log")
    index = docs(spark, "alpha beta", "gamma")
    embedder = HashedEmbedder(8)
    models = {"sentiment": echo, "multitask": echo}

    def ask(rows, turns=None):
        queries = spark.createDataFrame(rows, "query_id long, conv_id string, query string")
        answers = answer_queries(queries, index, models, turns, embedder, order=["ts", "turn"])
        return answers.withColumn("query", F.col("query")).cache()

    first = ask([(1, "c", "alpha"), (2, "c", "beta"), (3, "d", "gamma")])
    append_turns(new_turns(first, F.lit("2024-01-01").cast("timestamp")), path)
    turns = load_turns(spark, path)
    said = {r.conv_id: [tuple(m) for m in r.history]
            for r in prompt_history(turns, order=["ts", "turn"]).collect()}
    answered = {r.query_id: r.answer for r in first.collect()}
    assert said == {
        "c": [("user", "alpha"), ("assistant", answered[1]), ("user", "beta"), ("assistant", answered[2])],
        "d": [("user", "gamma"), ("assistant", answered[3])],
    }
    fresh = {r.conv_id: int(r.answer) for r in ask([(9, "c", "alpha"), (8, "e", "alpha")]).collect()}
    later = {r.conv_id: int(r.answer) for r in ask([(9, "c", "alpha"), (8, "e", "alpha")], turns).collect()}
    assert later["e"] == fresh["e"] and later["c"] > fresh["c"]


def test_reports(spark, tmp_path):
    path = str(tmp_path / "report")
    results = spark.createDataFrame([("FPB", 0.5), ("QA", 0.1)], "task string, score double")
    write_report(results, path, "20250101_100000", {"FPB": "first"})
    write_report(results.where("task = 'QA'"), path, "20250102_100000")
    assert [r.task for r in read_report(spark, path).collect()] == ["QA"]
    old = {r.task: r.dataset_note for r in read_report(spark, path, "20250101_100000").collect()}
    assert old == {"FPB": "first", "QA": None}


def facts(spark, tickers):
    snapshot = spark.createDataFrame(
        [(t, 10.0, None, 1e9, 12.345, 9.0, 1.0, 1.1) for t in tickers],
        "ticker string, price double, pe_ratio double, market_cap double, high_52w double, "
        "low_52w double, forward_eps double, trailing_eps double")
    quarterly = spark.createDataFrame(
        [(t, datetime.date(2020 + q // 4, q % 4 * 3 + 3, 28), 1.0, 2.0, 3.0, 0.5)
         for t in tickers for q in range(10)],
        "ticker string, period_end date, revenue double, net_income double, eps double, "
        "profit_margin double")
    annual = spark.createDataFrame(
        [(t, y, 1.0, 2.0, 3.0) for t in tickers for y in range(2015, 2024)],
        "ticker string, fiscal_year int, revenue double, ebitda double, free_cash_flow double")
    news = spark.createDataFrame(
        [(t, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), f"h{d}", None, "s")
         for t in tickers for d in range(15)],
        "ticker string, published timestamp, headline string, publisher string, summary string")
    return snapshot, quarterly, annual, news


def test_ticker_profiles(spark):
    snapshot, quarterly, annual, news = facts(spark, ["AAA", "BBB"])
    quarterly = quarterly.where("ticker = 'AAA'")  # BBB lacks a section
    got = {r.doc_id: r for r in ticker_profiles(snapshot, quarterly, annual, news).collect()}
    assert len(got) == 1 + 8 + 4 + 10 and all(r.metadata.ticker == "AAA" for r in got.values())
    assert "market_cap: 1000000000.00" in got["AAA/snapshot"].text
    assert "pe_ratio: n/a" in got["AAA/snapshot"].text
    assert {d for d in got if "/quarterly/" in d} == {
        f"AAA/quarterly/{2020 + q // 4}-{q % 4 * 3 + 3:02d}-28" for q in range(2, 10)}
    assert got["AAA/news/1"].text == "AAA news 1\nh14\nPublisher: unknown\ns"
    assert got["AAA/news/1"].metadata.date == "2024-01-15"
    assert "AAA/annual/2023" in got and "AAA/annual/2019" not in got


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert a != b and a.startswith(root) and b.startswith(root)


def test_spread_leaves_large_inputs_alone(spark):
    many, few = spark.range(0, 100, 1, 64), spark.range(0, 100, 1, 1)
    assert spread(many, "id") is many
    assert spread(few, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert empty_index(spark).columns[0] == "chunk_id"
