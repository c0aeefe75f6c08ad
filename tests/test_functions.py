"""Column functions, one case per branch."""

import pytest
from pyspark.sql import functions as F

from passagework.functions import labels, prompts, status, text
from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    NEWS_INSTRUCTION,
    PHRASEBANK_LABELS,
    SEVEN_CLASS_LABELS,
    TWEET_INSTRUCTION,
    TWEET_LABELS,
)
from passagework.functions.forecast import parse_forecast
from passagework.functions.routing import route
from passagework.operators.metrics import keyword_hits


def apply(spark, values, make, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_}")
    return [r[0] for r in rows.orderBy("i").select(make("x")).collect()]


def test_strip_removes_what_python_removes(spark):
    values = [" a ", "\t\n a b \r\n", "　 x ", "", " \n\t ", "f", "\x0cf\x0b"]
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


@pytest.mark.parametrize(
    ("query", "agent"),
    [
        ("Will it RISE? please Predict", "forecaster"),
        ("forecast the sentiment", "forecaster"),
        ("Is this BULLISH?", "sentiment"),
        ("classify this headline", "sentiment"),
        ("does this headline matter", "multitask"),
        ("what is a bond", "multitask"),
        ("", "multitask"),
    ],
)
def test_route(spark, query, agent):
    assert apply(spark, [query], route) == [agent]


def test_normalizers(spark):
    answers = ["Positive and negative", "it is NEGATIVE", "mixed", "not positive"]
    assert apply(spark, answers, labels.normalize_sentiment) == [
        "positive", "negative", "neutral", "positive",
    ]
    assert apply(spark, ["Yes", "yesterday", "no", None], labels.normalize_yes_no) == [1, 1, 0, 0]
    scores = [-0.11, -0.1, 0.0, 0.0999, 0.1]
    assert apply(spark, scores, labels.score_to_label, "double") == [
        "negative", "neutral", "neutral", "neutral", "positive",
    ]


def test_label_maps_differ_in_order(spark):
    assert apply(spark, [0, 1, 2, 3], lambda c: labels.map_labels(c, PHRASEBANK_LABELS), "int") == [
        "negative", "neutral", "positive", None,
    ]
    assert apply(spark, [0, 1, 2], lambda c: labels.map_labels(c, TWEET_LABELS), "int") == [
        "negative", "positive", "neutral",
    ]
    raw = [" Strong Negative\n", "mildly positive", "MILDLY NEGATIVE", "moderately positive", "odd", None]
    mapped = apply(
        spark, raw, lambda c: labels.map_labels(c, SEVEN_CLASS_LABELS, "neutral", clean=True)
    )
    assert mapped == ["negative", "neutral", "neutral", "positive", "neutral", "neutral"]


def test_strip_think(spark):
    values = ["plain ", "a</think> b ", "a</think>b</think>c", "end</think>", "<think>open", ""]
    assert apply(spark, values, text.strip_think) == ["plain", "b", "b</think>c", "", "<think>open", ""]


def test_preview(spark):
    values = ["x" * 200, "x" * 201, ""]
    assert apply(spark, values, text.preview) == ["x" * 200, "x" * 200 + "...", ""]
    assert apply(spark, ["ab"], lambda c: text.preview(c, 1, always=True)) == ["a..."]
    assert apply(spark, ["ab"], lambda c: text.preview(c, 5, always=True)) == ["ab..."]


def test_prompts(spark):
    got = apply(
        spark, ["post", "headline", None],
        lambda c: prompts.build_prompt(prompts.sentiment_instruction(c), F.lit("t")),
    )
    assert got == [
        f"{TWEET_INSTRUCTION}\nInput: t", f"{NEWS_INSTRUCTION}\nInput: t",
        f"{NEWS_INSTRUCTION}\nInput: t",
    ]


def test_passage_leaves_out_what_is_missing(spark):
    rows = spark.createDataFrame(
        [(1, "t", "a.txt", "ACME", "2024-01-31"), (2, "u", None, "", None), (3, "v", "s", None, "d")],
        "rank int, text string, source string, ticker string, date string",
    )
    got = rows.orderBy("rank").select(
        prompts.passage("rank", "text", "source", "ticker", "date")
    ).collect()
    assert [r[0] for r in got] == [
        "[1] source=a.txt ticker=ACME date=2024-01-31\nt",
        "[2] source=unknown\nu",
        "[3] source=s date=d\nv",
    ]


def test_system_prompt(spark):
    got = apply(spark, [None, "BLOCK"], prompts.system_prompt)
    assert got[0] == BASE_SYSTEM
    assert got[1].startswith(BASE_SYSTEM + "\n\n--- RELEVANT FINANCIAL CONTEXT ---\n")
    assert got[1].endswith("ignore them.\n\nBLOCK\n--- END CONTEXT ---")


def test_messages_and_chat_text(spark):
    rows = spark.createDataFrame(
        [(1, "q", [("user", "a"), ("assistant", "b")]), (2, "q", None)],
        f"i int, q string, h array<{prompts.MESSAGE}>",
    )
    listed = rows.orderBy("i").select(prompts.messages(F.lit("s"), "h", "q").alias("m"))
    first, second = [[tuple(m) for m in r.m] for r in listed.collect()]
    assert first == [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "q")]
    assert second == [("system", "s"), ("user", "q")]
    rendered = listed.select(prompts.chat_prompt("m")).collect()[1][0]
    assert rendered == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\n"
    )
    chat = apply(spark, ["u"], lambda c: prompts.chat_text("s", c, F.lit("o")))
    assert chat == [
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n"
        "<|im_start|>assistant\no<|im_end|>\n"
    ]


def test_status_order(spark):
    rows = spark.createDataFrame(
        [(1, True, True, 0, 0, None), (2, False, True, 3, 1, 0.5), (3, False, False, 0, 0, None),
         (4, False, False, 3, 0, 1.23456), (5, False, False, 3, 2, 0.1)],
        "i int, empty boolean, failed boolean, hits int, passing int, best double",
    )
    state = status.rag_status(F.col("empty"), F.col("failed"), F.col("hits"), F.col("passing"))
    told = rows.withColumn("s", state).withColumn(
        "m", status.rag_status_msg(F.col("s"), F.col("hits"), F.col("passing"), F.col("best"), 1.2)
    ).withColumn("w", status.rag_warning(F.col("s"), F.col("m")))
    got = {r.i: (r.s, r.m, r.w) for r in told.collect()}
    assert [got[i][0] for i in range(1, 6)] == [
        "empty_index", "error", "no_match", "low_confidence", "ok",
    ]
    low = (
        "All 3 candidate chunk(s) exceeded the distance threshold (1.2). Best score: 1.235. "
        "Consider raising max_distance or adding more relevant documents."
    )
    assert got[4][1:] == (low, "Retrieved documents were not sufficiently relevant. " + low)
    assert got[5][1:] == ("Injected 2 chunk(s) (rejected 1 below threshold).", None)
    assert got[2][2] == f"RAG retrieval failed ({got[2][1]}). Answer based on model knowledge only."


def test_keyword_hits_are_substrings(spark):
    words = F.array(*[F.lit(w) for w in ("Term", "rate", "absent")])
    assert apply(spark, ["we DETERMINE rates"], lambda c: keyword_hits(c, words)) == [["Term", "rate"]]


def test_parse_forecast(spark):
    full = (
        "[Positive Developments]:\n1. sales & more\n\n[Potential Concerns]:\n1. debt\n\n"
        "[Prediction & Analysis]:\nPrediction: Up by 2-3.5%. Analysis: fine"
    )
    partial = "[Potential Concerns]:\n1. debt\n[Prediction & Analysis]:\nno idea"
    a, b, c = apply(spark, [full, partial, "nothing"], parse_forecast)
    assert a.positive_developments == "1. sales & more" and a.potential_concerns == "1. debt"
    assert a.prediction_analysis.startswith("Prediction: Up") and a.direction == "up"
    assert (b.positive_developments, b.potential_concerns, b.direction, b.percent) == (
        None, "1. debt", None, None,
    )
    assert set(c.asDict().values()) == {None}


def test_a_missing_section_swallows_nothing(spark):
    told = "[Positive Developments]:\n1. good\n[Prediction & Analysis]:\nPrediction: Up by 2%"
    (found,) = apply(spark, [told], parse_forecast)
    assert found.positive_developments == "1. good" and found.potential_concerns is None
    assert found.direction == "up" and found.percent == 2.0
