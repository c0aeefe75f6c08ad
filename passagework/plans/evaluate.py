"""Evaluation: datasets to prompts and targets, answers to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.functions.fixed_values import (
    NEWS_INSTRUCTION,
    PHRASEBANK_LABELS,
    SEVEN_CLASS_LABELS,
    TWEET_INSTRUCTION,
    TWEET_LABELS,
)
from passagework.functions.labels import (
    map_labels,
    normalize_sentiment,
    normalize_yes_no,
    score_to_label,
)
from passagework.functions.prompts import build_prompt, sentiment_instruction
from passagework.operators.agents import routing_map
from passagework.operators.metrics import (
    align,
    avg_keyword_score,
    keyword_scores,
    task_results,
)

YES_NO_TASK = "Headline"


def _examples(df: DataFrame, task: str, key: str, prompt, target) -> DataFrame:
    return df.select(
        F.lit(task).alias("task"),
        F.col(key).cast("string").alias("example_id"),
        prompt.alias("query"),
        target.cast("string").alias("target"),
    )


def phrasebank_examples(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``sentence, label`` with 0 negative, 1 neutral, 2 positive."""
    return _examples(
        df,
        "FPB",
        key,
        build_prompt(F.lit(NEWS_INSTRUCTION), "sentence"),
        map_labels("label", PHRASEBANK_LABELS),
    )


def scored_examples(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``sentence, sentiment_score, format``; the wording follows the format."""
    return _examples(
        df,
        "FiQA-SA",
        key,
        build_prompt(sentiment_instruction("format"), "sentence"),
        score_to_label("sentiment_score"),
    )


def tweet_examples(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``text, label`` with 0 negative, 1 positive, 2 neutral."""
    return _examples(
        df,
        "TFNS",
        key,
        build_prompt(F.lit(TWEET_INSTRUCTION), "text"),
        map_labels("label", TWEET_LABELS),
    )


def seven_class_examples(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``news, label`` of seven classes, mapped to three."""
    return _examples(
        df,
        "NWGI",
        key,
        build_prompt(F.lit(NEWS_INSTRUCTION), "news"),
        map_labels("label", SEVEN_CLASS_LABELS, "neutral", clean=True),
    )


def headline_examples(df: DataFrame, key: str = "example_id") -> DataFrame:
    """``instruction, input, output``; 1 when the output says yes."""
    return _examples(
        df, YES_NO_TASK, key, build_prompt("instruction", "input"), normalize_yes_no("output")
    )


def predictions(answers: DataFrame) -> DataFrame:
    """Add the class the task's rule reads from ``answer``."""
    yes_no = normalize_yes_no("answer").cast("string")
    return answers.withColumn(
        "prediction",
        F.when(F.col("task") == YES_NO_TASK, yes_no).otherwise(normalize_sentiment("answer")),
    )


def evaluate_tasks(
    examples: DataFrame, answers: DataFrame, published: DataFrame | None = None
) -> DataFrame:
    """One row per task: size, metrics, routing, and its published counterparts.

    ``examples`` has ``task, example_id, target``, ``answers`` has ``task,
    example_id, answer, agent_used``, recorded or made by ``answer_queries``.
    Binary F1 is given for the yes/no task only, macro and micro for the others.
    """
    targets = examples.select("task", "example_id", "target")
    scored = align(predictions(answers), targets, ["task", "example_id"])
    results = task_results(scored, pos_label="1")
    yes_no = F.col("task") == YES_NO_TASK
    results = results.withColumns(
        {
            "f1_binary": F.when(yes_no, F.col("f1_binary")),
            "f1_macro": F.when(~yes_no, F.col("f1_macro")),
            "f1_micro": F.when(~yes_no, F.col("f1_micro")),
        }
    )
    if published is None:
        return results
    # The handful of published scores is grouped, not the results: they are made once.
    listed = published.groupBy("task").agg(
        F.sort_array(F.collect_list(F.struct("system", F.col("score").alias("reference"))))
        .alias("published")
    )
    compared = F.transform(
        "published", lambda p: p.withField("delta", F.col("f1_weighted") - p["reference"])
    )
    none = F.array().cast("array<struct<system:string,reference:double,delta:double>>")
    return results.join(listed, "task", "left").withColumn(
        "published", F.coalesce(compared, none)
    )


def evaluate_questions(cases: DataFrame, answers: DataFrame, by=()) -> DataFrame:
    """Open questions: mean share of expected keywords found in the answers.

    ``cases`` has ``example_id, keywords``; a case without an answer scores 0.
    """
    aligned = align(answers, cases).withColumn("answer", F.coalesce("answer", F.lit("")))
    return avg_keyword_score(keyword_scores(aligned), by)


def evaluate_cases(cases: DataFrame, answers: DataFrame, digits: int = 4) -> DataFrame:
    """One row per case: its columns, ``response, agent_used, score, keywords_hit``.

    ``cases`` has ``example_id, keywords``, ``answers`` has ``example_id, answer,
    agent_used``; a case without an answer has an empty response and scores 0.
    """
    aligned = align(answers, cases).withColumn("answer", F.coalesce("answer", F.lit("")))
    scored = keyword_scores(aligned).withColumn("score", F.round("score", digits))
    return scored.withColumnRenamed("answer", "response").select(
        *[c for c in cases.columns if c != "keywords"],
        "response", "agent_used", "score", "keywords_hit",
    )


def cases_result(per_case: DataFrame, by=(), digits: int = 4) -> DataFrame:
    """What the rows of :func:`evaluate_cases` come to: size, mean score, routing."""
    by = [by] if isinstance(by, str) else list(by)
    marked = per_case.withColumn("task", F.lit("QA"))
    means = avg_keyword_score(marked, ["task", *by]).withColumn(
        "avg_keyword_score", F.round("avg_keyword_score", digits)
    )
    routed = routing_map(marked.where(F.col("agent_used").isNotNull()), ["task", *by])
    return means.join(routed, ["task", *by], "left")
