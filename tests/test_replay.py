"""Conversations answered in waves: what a question sees, and going on after a stop."""

import pytest

from passagework.functions.text import cut_tokens
from passagework.plans.answer import answer_queries
from passagework.plans.replay import replay_conversations
from passagework.sources.index_store import empty_index
from passagework.sources.turn_log import load_turns


def shown(prompt):
    """The messages of a prompt after the system prompt, role and text."""
    parts = prompt.split("<|im_start|>")[2:-1]
    return [tuple(p.removesuffix("<|im_end|>\n").split("\n", 1)) for p in parts]


def echo_factory(record):
    def factory():
        def answer(prompts):
            replies = []
            for prompt in prompts:
                turns = shown(prompt)
                with open(record, "a", encoding="utf-8") as f:
                    f.write(turns[-1][1] + "\n")
                if "fail" in turns[-1][1]:
                    raise ValueError("refused")
                replies.append("saw " + "|".join(t for _, t in turns))
            return replies

        return answer

    return factory


def asked(record):
    with open(record, encoding="utf-8") as f:
        return sorted(f.read().split("\n")[:-1])


@pytest.fixture
def record(tmp_path):
    path = tmp_path / "asked.txt"
    path.write_text("")
    return str(path)


def models(record):
    return {"multitask": echo_factory(record), "sentiment": echo_factory(record)}


QUESTIONS = [(1, 1, "q1"), (2, 1, "q2"), (3, 1, "q3"), (4, 2, "r1"), (5, None, "n1"), (6, None, "n2")]
SCHEMA = "query_id long, conv_id long, query string"


def test_later_questions_see_earlier_answers(spark, record, tmp_path):
    queries = spark.createDataFrame(QUESTIONS, SCHEMA)
    past = spark.createDataFrame([(1, 0, "user", "old")], "conv_id long, turn long, role string, content string")
    log = str(tmp_path / "log")
    found = replay_conversations(
        queries, empty_index(spark), models(record), str(tmp_path / "replay"), past, log=log,
        history=3, embedder=_embedder(),
    )
    answers = {r.query_id: (r.wave, r.answer) for r in found.collect()}
    a1 = "saw old|q1"
    a2 = f"saw old|q1|{a1}|q2"
    assert answers == {
        1: (1, a1), 2: (2, a2), 3: (3, f"saw {a1}|q2|{a2}|q3"), 4: (1, "saw r1"),
        5: (1, "saw n1"), 6: (2, "saw n1|saw n1|n2"),
    }
    logged = load_turns(spark, log).where("conv_id = '1'").orderBy("turn")
    assert [(r.turn, r.role, r.content) for r in logged.collect()][:4] == [
        (1, "user", "q1"), (2, "assistant", a1), (3, "user", "q2"), (4, "assistant", a2)]
    assert load_turns(spark, log).count() == 12


def _embedder():
    from passagework.operators.embedding import HashedEmbedder

    return HashedEmbedder(8)


def test_a_replay_goes_on_where_it_stopped(spark, record, tmp_path, monkeypatch):
    queries = spark.createDataFrame(QUESTIONS + [(7, 1, "fail"), (8, 1, "q5")], SCHEMA)
    folder, log = str(tmp_path / "replay"), str(tmp_path / "log")

    def run():
        return replay_conversations(
            queries, empty_index(spark), models(record), folder, embedder=_embedder(), log=log
        )

    from passagework.plans import replay

    remembered = replay._remembered
    calls = []

    def stops(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return remembered(*args)

    monkeypatch.setattr(replay, "_remembered", stops)
    with pytest.raises(RuntimeError, match="stopped"):
        run()
    before = asked(record)
    assert before == ["n1", "n2", "q1", "q2", "r1"]
    monkeypatch.setattr(replay, "_remembered", remembered)
    rows = {r.query_id: r for r in run().collect()}
    assert sorted(set(asked(record)) - set(before)) == ["fail", "q3", "q5"]
    assert rows[7].answer is None and "refused" in rows[7].error
    assert rows[8].wave == 5 and rows[8].answer.endswith("|q5")
    assert "fail" not in rows[8].answer and "q3" in rows[8].answer
    kept = load_turns(spark, log).where("conv_id = '1'")
    assert kept.count() == kept.select("turn", "role").distinct().count() == 8
    once = asked(record)
    assert len(run().collect()) == 8 and asked(record) == once


def test_budget_drops_the_oldest_and_limit_cuts_the_end(spark, record, tmp_path):
    queries = spark.createDataFrame([(1, 1, "one two"), (2, 1, "three")], SCHEMA)
    empty = empty_index(spark)
    for name, budget in (("wide", 10_000), ("tight", 1)):
        rows = replay_conversations(queries, empty, models(record), str(tmp_path / name),
                                    embedder=_embedder(), budget=budget).collect()
        seen = {r.query_id: r.answer for r in rows}
        assert seen[2] == ("saw one two|saw one two|three" if budget > 1 else "saw three")
    from passagework.functions.fixed_values import BASE_SYSTEM

    system = len(BASE_SYSTEM.split())

    def keep():
        return lambda prompts: [str(len(p.split())) for p in prompts]

    agents = {"multitask": keep, "sentiment": keep}
    cut = answer_queries(queries.select("query_id", "query"), empty, agents, embedder=_embedder(),
                         limit=system)
    assert {r.answer for r in cut.collect()} == {str(system)}


def test_cut_tokens(spark):
    rows = spark.createDataFrame([(" a  b\nc d ",), ("a b",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(cut_tokens("t", 3)).collect()]
    assert got == [" a  b\nc", "a b", "", None]


def test_no_question(spark, record, tmp_path):
    queries = spark.createDataFrame([], SCHEMA)
    rows = replay_conversations(queries, empty_index(spark), models(record), str(tmp_path / "r"),
                                embedder=_embedder())
    assert rows.collect() == [] and "answer" in rows.columns
