"""History, routing, answering and scores against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.functions.fixed_values import PUBLISHED_SCORES, QA_CASES
from passagework.operators.agents import (
    agents_table,
    batch_answer,
    route_queries,
    routing_counts,
    routing_map,
)
from passagework.operators.history import fit_history, prompt_history, prune_turns
from passagework.operators.metrics import (
    align,
    avg_keyword_score,
    classification_metrics,
    compare_scores,
    keyword_scores,
)
from passagework.plans import evaluate


@pytest.fixture(scope="module")
def said(spark):
    rng = random.Random(3)
    rows = []
    for conv, n in (("a", 1), ("b", 30), ("hot", 600)):
        for turn in range(n):
            words = " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 9)))
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", words))
    return rows, spark.createDataFrame(
        rows, "conv_id string, turn int, role string, content string"
    ).repartition(5).cache()


def by_conv(rows):
    out = {}
    for conv, turn, role, content in rows:
        out.setdefault(conv, []).append((turn, role, content))
    return out


def test_prune_turns(said):
    rows, df = said
    kept = {(r.conv_id, r.turn) for r in prune_turns(df).collect()}
    assert kept == {(c, t) for c, ts in by_conv(rows).items() for t, _, _ in ts[-500:]}


def test_prompt_history(said):
    rows, df = said
    got = {r.conv_id: [tuple(m) for m in r.history] for r in prompt_history(df).collect()}
    assert got == {c: [(role, text) for _, role, text in ts[-20:]] for c, ts in by_conv(rows).items()}


@pytest.mark.parametrize("budget", [1, 7, 40, 512])
def test_fit_history(said, budget):
    rows, df = said
    expected = set()
    for conv, ts in by_conv(rows).items():
        total = 0
        for turn, _, content in reversed(ts):
            total += max(len(content.split()), 1)
            if total > budget:
                break
            expected.add((conv, turn))
    assert {(r.conv_id, r.turn) for r in fit_history(df, budget).collect()} == expected


@pytest.mark.parametrize("n", [5, 1500])
def test_hot_conversation_is_cut_in_shards_first(said, n):
    """At any n: the first shuffle deals a conversation to shards, the second what is left."""
    _, df = said
    plan = prune_turns(df, n)._jdf.queryExecution().executedPlan().toString()
    last, first = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "_shard" in first and "_shard" not in last
    between = plan[plan.index(last) : plan.index(first)]
    assert "_newest" in between and f"<= {n}" in between


def test_messages_without_tokens_count_as_one(said):
    _, df = said
    free = fit_history(df, 3, token_count=lambda c: F.lit(0))
    assert free.groupBy("conv_id").count().agg({"count": "max"}).first()[0] == 3


def test_history_of_two_batches_and_of_a_log_without_turns(spark):
    schema = "conv_id string, turn int, role string, content string, ts string, line string"
    rows = [("c", 14, "user", "q1", "1", "a"), ("c", 15, "assistant", "a1", "1", "b"),
            ("c", 0, "user", "q2", "2", "c"), ("c", 1, "assistant", "a2", "2", "d"),
            ("d", None, "user", "q", "1", "a"), ("d", None, "assistant", "a", "1", "b")]
    got = prompt_history(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id: [m.content for m in r.history] for r in got} == {
        "c": ["q1", "a1", "q2", "a2"], "d": ["q", "a"]}


def test_missing_answers_count_as_wrong(spark):
    targets = spark.createDataFrame([(i, "positive") for i in range(4)], "example_id int, target string")
    answers = spark.createDataFrame([(0, "positive")], "example_id int, prediction string")
    aligned = align(answers, targets)
    assert aligned.count() == 4 and aligned.where("prediction is null").count() == 3


def test_routing_and_fallback(spark):
    rows = [(1, "any sentiment?", None), (2, "predict it", None), (3, "hello", "sentiment"),
            (4, "sentiment", "forecaster"), (5, "bullish", ""), (6, "x", "unheard of")]
    queries = spark.createDataFrame(rows, "query_id int, query string, wish string")
    routed = route_queries(queries, override="wish").cache()
    assert {r.query_id: r.agent_used for r in routed.collect()} == {
        1: "sentiment", 2: "multitask", 3: "sentiment", 4: "multitask", 5: "sentiment", 6: "multitask",
    }
    assert {r.query_id: r.query_type for r in routed.collect()}[2] == "forecaster"
    assert {r.agent_used: r.n_queries for r in routing_counts(routed).collect()} == {
        "sentiment": 3, "multitask": 3,
    }
    assert routing_map(routed).first().routing == {"sentiment": 3, "multitask": 3}
    assert agents_table(spark).where("available").count() == 2


def shouting():
    def answer(prompts):
        if any(p.startswith("bad") for p in prompts):
            raise ValueError("refused")
        return [f"<think>hm</think> {p.upper()} " for p in prompts]

    return answer


def broken():
    raise OSError("no weights")


def test_batch_answer_keeps_going(spark):
    rows = [(i, "sentiment", f"q{i}") for i in range(50)]
    rows += [(50, "sentiment", "bad one"), (51, "multitask", "x"), (52, "ghost", "y")]
    queries = spark.createDataFrame(rows, "query_id int, agent_used string, prompt string")
    got = {
        r.query_id: (r.answer, r.error)
        for r in batch_answer(queries, {"sentiment": shouting, "multitask": broken}).collect()
    }
    assert all(got[i] == (f"Q{i}", None) for i in range(50))
    assert got[50] == (None, "ValueError: refused") and got[51] == (None, "OSError: no weights")
    assert got[52][0] is None and "ghost" in got[52][1]


def test_a_hot_agent_fills_many_tasks(spark):
    queries = spark.range(4000).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") % 10 == 0, "multitask").otherwise("sentiment").alias("agent_used"),
        F.lit("p").alias("prompt"),
    )
    answered = batch_answer(queries, {"sentiment": shouting, "multitask": shouting}, tasks=8)
    spread = answered.groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n"), F.count_distinct("agent_used").alias("agents")
    ).collect()
    assert len(spread) == 8 and max(r.n for r in spread) < 1000
    assert sum(r.agents for r in spread) <= 9


def scores(pairs, pos=None):
    labels = sorted({x for p in pairs for x in p})
    n, hits = len(pairs), sum(t == p for t, p in pairs)
    f1, support = {}, {}
    for label in labels:
        tp = sum(t == p == label for t, p in pairs)
        support[label] = sum(t == label for t, _ in pairs)
        predicted = sum(p == label for _, p in pairs)
        f1[label] = 2 * tp / (support[label] + predicted)
    return {
        "n_samples": n,
        "accuracy": hits / n,
        "f1_weighted": sum(f1[x] * support[x] for x in labels) / n,
        "f1_macro": sum(f1.values()) / len(labels),
        "f1_micro": hits / n,
        "f1_binary": f1.get(pos, 0.0),
    }


def test_metrics(spark):
    rng = random.Random(11)
    groups = {
        "mixed": [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)],  # d only predicted
        "wrong": [("a", "b"), ("b", "c")],
        "right": [("a", "a")] * 3,
        "targets only": [("a", "b"), ("c", "b"), ("b", "b")],
    }
    rows = [(g, t, p) for g, pairs in groups.items() for t, p in pairs]
    df = spark.createDataFrame(rows, "g string, t string, p string").repartition(4)
    got = classification_metrics(df, "t", "p", "g", pos_label="a").collect()
    for row in got:
        for name, value in scores(groups[row.g], "a").items():
            assert row[name] == pytest.approx(value, abs=1e-12), (row.g, name)
    whole = classification_metrics(df, "t", "p").first()
    assert whole.f1_weighted == pytest.approx(scores([r[1:] for r in rows])["f1_weighted"])


RECORDED = [
    "Bond Price", "price-to-earnings ratio", "market trend", "tool", "industry: emerging markets",
    "The yield curve is a line graph that plots the yields of bonds with different maturities, "
    "such as short-term, 5-year and long ones, shown by the government.",
    "type: definition", "industry: DCF, financial modeling",
]
RECORDED_HITS = [
    "inverse, fall, rise, price", "earnings, price, overvalued, undervalued", "fall, bull, bear",
    "money, supply, central bank, bonds, inflation", "liquidity", "short, long, invert, term",
    "market, diversif, specific, company", "cash flow, present value, rate, future",
]


@pytest.mark.parametrize(("answers", "average"), [(RECORDED, 0.1161), (RECORDED_HITS, 0.5618)])
def test_recorded_keyword_scores(spark, answers, average):
    rows = [(a, words, level) for a, (_, words, level) in zip(answers, QA_CASES)]
    df = spark.createDataFrame(rows, "answer string, keywords array<string>, difficulty string")
    scored = keyword_scores(df)
    assert round(avg_keyword_score(scored).first().avg_keyword_score, 4) == average
    by_level = {r.difficulty: r.n_samples for r in avg_keyword_score(scored, "difficulty").collect()}
    assert by_level == {"core": 3, "intermediate": 2, "advanced": 3}


def test_evaluation_of_all_tasks(spark):
    fpb = spark.createDataFrame([(1, "s", 0), (2, "t", 1), (3, "u", 2)],
                                "example_id int, sentence string, label int")
    fiqa = spark.createDataFrame([(1, "s", 0.4, "post"), (2, "t", -0.4, "headline")],
                                 "example_id int, sentence string, sentiment_score double, format string")
    tweets = spark.createDataFrame([(1, "s", 1)], "example_id int, text string, label int")
    seven = spark.createDataFrame([(1, "n", " Mildly Positive")],
                                  "example_id int, news string, label string")
    heads = spark.createDataFrame([(1, "Does this headline say up?", "h", "Yes"),
                                   (2, "Does this headline say up?", "h", "No")],
                                  "example_id int, instruction string, input string, output string")
    examples = (
        evaluate.phrasebank_examples(fpb)
        .unionByName(evaluate.scored_examples(fiqa))
        .unionByName(evaluate.tweet_examples(tweets))
        .unionByName(evaluate.seven_class_examples(seven))
        .unionByName(evaluate.headline_examples(heads))
    )
    told = {(r.task, r.example_id): (r.query, r.target) for r in examples.collect()}
    assert told[("FiQA-SA", "1")][0].startswith("What is the sentiment of this tweet?")
    assert told[("TFNS", "1")][1] == "positive" and told[("NWGI", "1")][1] == "neutral"
    assert told[("Headline", "1")] == ("Does this headline say up?\nInput: h", "1")

    routed = route_queries(examples)
    answers = routed.select(
        "task", "example_id", "agent_used",
        F.when(F.col("task") == "Headline", "yes").otherwise("Positive!").alias("answer"),
    )
    published = spark.createDataFrame(PUBLISHED_SCORES, "task string, system string, score double")
    results = {r.task: r for r in evaluate.evaluate_tasks(examples, answers, published).collect()}
    assert results["FPB"].accuracy == 0.3333 and results["FPB"].routing == {"sentiment": 3}
    assert results["Headline"].routing == {"multitask": 2}
    assert results["Headline"].f1_binary == 0.6667 and results["Headline"].f1_macro is None
    assert results["TFNS"].f1_weighted == 1.0 and results["FPB"].f1_binary is None
    by_system = {c.system: c for c in results["TFNS"].published}
    assert by_system["published"].delta == pytest.approx(1 - 0.903)
    assert by_system["BloombergGPT"].delta is None
    unknown = spark.createDataFrame([("QA", 0.5)], "task string, f1_weighted double")
    assert compare_scores(unknown, published).first().delta is None
