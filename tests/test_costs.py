"""What must not be done twice or unevenly: embedding, answering, batches that were stopped."""

import json
import os
import statistics

import pytest
from pyspark.sql import functions as F

from passagework.operators.dealing import answer_by_cost, dealt_by_cost
from passagework.operators.embedding import HashedEmbedder, ModelEmbedder
from passagework.operators.metrics import graded
from passagework.operators.vector_store import embed_once, stored_vectors
from passagework.plans.batch import resume_batch
from passagework.plans.evaluate import cases_result, evaluate_cases
from passagework.sources.index_store import empty_index
from passagework.sources.turn_log import load_turns


def counting(record, reply):
    """A model factory that writes down every text it is given."""

    def factory():
        def model(texts):
            with open(record, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return [reply(t) for t in texts]

        return model

    return factory


def seen(record):
    if not os.path.exists(record):
        return []
    with open(record, encoding="utf-8") as f:
        return sorted(json.loads(line) for line in f)


def test_texts_are_embedded_once(spark, tmp_path):
    record, path = str(tmp_path / "seen"), str(tmp_path / "vectors")
    embedder = ModelEmbedder([("m", counting(record, lambda t: [float(len(t)), 1.0]))], 2)
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "id long, text string")
    first = embed_once(df, embedder, path)
    got = {r.id: r.embedding for r in first.collect()}
    assert got == {1: [2.0, 1.0], 2: [1.0, 1.0], 3: [2.0, 1.0], 4: None}
    assert seen(record) == ["aa", "b"]
    more = df.unionByName(spark.createDataFrame([(5, "new")], df.schema))
    assert {r.id: r.embedding for r in embed_once(more, embedder, path).collect()}[5] == [3.0, 1.0]
    assert seen(record) == ["aa", "b", "new"]
    other = ModelEmbedder([("n", counting(record, lambda t: [0.0, 0.0]))], 2)
    embed_once(df, other, path)
    assert seen(record) == ["aa", "aa", "b", "b", "new"]
    assert stored_vectors(spark, path, "m").count() == 3
    assert embed_once(df.limit(0), embedder, path).collect() == []


def test_tasks_cost_alike(spark):
    rows = [("a" if i % 3 else "b", i, 1 + (i % 97) ** 2 // 40) for i in range(20_000)]
    df = spark.createDataFrame(rows, "agent_used string, key long, cost long")
    dealt = dealt_by_cost(df, 8).groupBy(F.spark_partition_id().alias("task")).agg(
        F.sum("cost").alias("cost"), F.count_distinct("agent_used").alias("agents")
    )
    costs = {r.task: r for r in dealt.collect()}
    assert len(costs) == 8
    total = [r.cost for r in costs.values()]
    assert max(total) <= 1.5 * statistics.median(total)
    assert sum(r.agents > 1 for r in costs.values()) <= 1


def test_equal_prompts_are_asked_once(spark, tmp_path):
    record = str(tmp_path / "seen")

    def reply(prompt):
        if "bad" in prompt:
            raise ValueError("bad prompt")
        return prompt.upper()

    def factory():
        def model(texts):
            answers = [reply(t) for t in texts]
            with open(record, "a", encoding="utf-8") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return answers

        return model

    rows = [(i, "a", "same") for i in range(50)] + [(90, "b", "same"), (91, "a", "bad"), (92, "a", None),
                                                    (93, "missing", "x")]
    df = spark.createDataFrame(rows, "query_id long, agent_used string, prompt string")
    found = {r.query_id: r for r in answer_by_cost(df, {"a": factory, "b": factory}).collect()}
    assert len(found) == len(rows)
    assert {found[i].answer for i in range(50)} == {"SAME"} and found[90].answer == "SAME"
    assert "bad prompt" in found[91].error and found[92].error == "no prompt"
    assert "KeyError" in found[93].error
    assert seen(record) == ["same", "same"]
    assert answer_by_cost(df.limit(0), {"a": factory}).collect() == []


def test_a_batch_goes_on(spark, tmp_path, monkeypatch):
    record, asked = str(tmp_path / "seen"), tmp_path / "q.jsonl"
    lines = [json.dumps({"query": f"q{i % 12}"}) for i in range(20)] + ["", "{bad", '{"x": 1}']
    asked.write_text("\n".join(lines))

    def reply(prompt):
        return prompt.split("<|im_start|>user\n")[1].split("<|im_end|>")[0].upper()

    models = {n: counting(record, reply) for n in ("multitask", "sentiment")}
    answers, log = str(tmp_path / "answers"), str(tmp_path / "log")

    def run():
        resume_batch(spark, str(asked), answers, empty_index(spark), models, log=log, slices=3,
                     embedder=HashedEmbedder(8))

    from passagework.plans import batch

    answer, calls = batch.answer_queries, []

    def stops(*args, **options):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return answer(*args, **options)

    with monkeypatch.context() as m:
        m.setattr(batch, "answer_queries", stops)
        with pytest.raises(RuntimeError):
            run()
    before = len(seen(record))
    assert 0 < before < 12 and not os.path.exists(answers)
    run()
    assert len(seen(record)) == len(set(seen(record))) == 12
    got = [json.loads(r.value) for r in spark.read.text(answers).collect()]
    assert sorted(r["answer"] for r in got if r["answer"]) == sorted(f"Q{i % 12}" for i in range(20))
    assert sum(r["error"] is not None for r in got) == 2 and len(got) == 22
    asked.write_text("\n".join([*lines, json.dumps({"query": "later"})]))
    run()
    assert len(seen(record)) == 13 and spark.read.text(answers).count() == 23
    assert load_turns(spark, log).count() == 2 * 21


def test_graded_cases(spark):
    df = spark.createDataFrame([("Alpha beta",), (None,), ("",)], "t string")
    case = lambda q, *w: F.struct(F.lit(q).alias("q"), F.array(*map(F.lit, w)).alias("keywords"))
    cases = F.array(case("x", "ALPHA", "gamma"), case("y", "beta"))
    rows = df.select("t", F.inline(graded("t", cases))).collect()
    assert [(r.q, r.keywords_hit, r.score) for r in rows if r.t == "Alpha beta"] == [
        ("x", ["ALPHA"], 0.5), ("y", ["beta"], 1.0)]
    assert {r.score for r in rows if r.t == ""} == {0.0}
    per_case = evaluate_cases(
        spark.createDataFrame([(1, ["a"], "core"), (2, ["b"], "core")],
                              "example_id long, keywords array<string>, difficulty string"),
        spark.createDataFrame([(1, "has A", "multitask")],
                              "example_id long, answer string, agent_used string"),
    )
    got = {r.example_id: r for r in per_case.collect()}
    assert got[1].keywords_hit == ["a"] and got[2].response == "" and got[2].score == 0.0
    result = cases_result(per_case).first()
    assert result.avg_keyword_score == 0.5 and result.routing == {"multitask": 1}
