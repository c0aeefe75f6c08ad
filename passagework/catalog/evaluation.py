"""Registered queries: labels, metrics, keyword scores and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.common import sql_text, table, texts
from passagework.functions.fixed_values import (
    PHRASEBANK_LABELS,
    PUBLISHED_SCORES,
    QA_CASES,
    SEVEN_CLASS_LABELS,
    TWEET_LABELS,
)
from passagework.functions.labels import (
    map_labels,
    normalize_sentiment,
    normalize_yes_no,
    score_to_label,
)
from passagework.operators.metrics import (
    avg_keyword_score,
    classification_metrics,
    compare_scores,
    graded,
    label_scores,
)
from passagework.plans.evaluate import evaluate_tasks

def balance():
    """Account balance on a scale about zero."""
    return (F.col("c_acctbal") - 4500) / 5500


def _verdicts(spark, sf_dir):
    """Whole texts, each followed by what its labels say of it."""
    verdict = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "The outlook is POSITIVE.")
        .when((F.col("quality") == 1) & (F.col("toxic") == 1), "Negative, yet partly positive.")
        .when(F.col("toxic") == 1, "Clearly Negative.")
        .otherwise("Not since yesterday.")
    )
    docs = texts(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("quality").isNull(), F.col("text"))
        .otherwise(F.concat("text", F.lit("\n"), verdict))
        .alias("answer"),
    )


def q_normalize_labels(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(
        "doc_id",
        normalize_sentiment("answer").alias("sentiment"),
        normalize_yes_no("answer").alias("yes_no"),
    )


def q_score_labels(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", score_to_label(balance()).alias("label"))


def seven_classes():
    """Account balances as seven classes, spelled carelessly, and one that is none of them."""
    return (
        F.when(F.col("c_acctbal") < 500, " Strong Negative\n")
        .when(F.col("c_acctbal") < 2000, "moderately negative")
        .when(F.col("c_acctbal") < 3500, "Mildly Negative ")
        .when(F.col("c_acctbal") < 5000, "neutral")
        .when(F.col("c_acctbal") < 6500, "\tMILDLY positive")
        .when(F.col("c_acctbal") < 8000, "moderately positive ")
        .when(F.col("c_acctbal") < 9500, "strong positive")
        .otherwise("overwhelming")
    )


def q_map_labels(spark, sf_dir):
    """Account balances as classes; nations as integer labels."""
    customers = table(spark, sf_dir, "customer").withColumn("raw", seven_classes())
    return customers.select(
        "c_custkey",
        map_labels("raw", SEVEN_CLASS_LABELS, "neutral", clean=True).alias("seven_class"),
        map_labels("c_nationkey", PHRASEBANK_LABELS).alias("phrasebank"),
        map_labels("c_nationkey", TWEET_LABELS).alias("tweet"),
    )


def _rounded(df, digits=6):
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else c for c in df.columns])


def q_metrics_binary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return _rounded(classification_metrics(labels, "quality", "toxic", pos_label=1))


def _segments(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.select(
        "c_custkey",
        "c_mktsegment",
        score_to_label(balance()).alias("target"),
        score_to_label(balance() + 0.3).alias("prediction"),
    )


def q_metrics_multiclass(spark, sf_dir):
    df = _segments(spark, sf_dir)
    return _rounded(classification_metrics(df, "target", "prediction", "c_mktsegment"))


def q_label_scores(spark, sf_dir):
    df = _segments(spark, sf_dir)
    return _rounded(label_scores(df, "target", "prediction", "c_mktsegment"))


def _examples(spark, sf_dir):
    """Two tasks: balances as scored sentiment, quality labels as yes or no."""
    customers = table(spark, sf_dir, "customer").select(
        F.lit("FiQA-SA").alias("task"),
        F.col("c_custkey").cast("string").alias("example_id"),
        score_to_label(balance()).alias("target"),
    )
    labels = table(spark, sf_dir, "labels").select(
        F.lit("Headline").alias("task"),
        F.col("doc_id").cast("string").alias("example_id"),
        F.col("quality").cast("string").alias("target"),
    )
    return customers.unionByName(labels)


def _answers(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.lit("FiQA-SA").alias("task"),
        F.col("c_custkey").cast("string").alias("example_id"),
        F.concat(F.lit("I would call it "), F.upper(score_to_label(balance() + 0.3)), F.lit("."))
        .alias("answer"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "multitask")
        .otherwise("sentiment")
        .alias("agent_used"),
    )
    labels = table(spark, sf_dir, "labels").select(
        F.lit("Headline").alias("task"),
        F.col("doc_id").cast("string").alias("example_id"),
        F.when(F.col("toxic") == 1, "Yes, it does.").otherwise("No.").alias("answer"),
        F.lit("multitask").alias("agent_used"),
    )
    return customers.unionByName(labels)


def q_task_results(spark, sf_dir):
    results = evaluate_tasks(_examples(spark, sf_dir), _answers(spark, sf_dir))
    return results.withColumns(
        {
            "n_sentiment": F.try_element_at("routing", F.lit("sentiment")),
            "n_multitask": F.try_element_at("routing", F.lit("multitask")),
        }
    ).drop("routing")


def q_compare_scores(spark, sf_dir):
    results = evaluate_tasks(_examples(spark, sf_dir), _answers(spark, sf_dir))
    published = spark.createDataFrame(
        PUBLISHED_SCORES, "task string, system string, score double"
    )
    return _rounded(compare_scores(results, published))


def cases():
    """The open questions as a literal: a fixed number of rows per document."""
    return F.array(
        *[
            F.struct(
                F.lit(q).alias("question"),
                F.array(*[F.lit(w) for w in words]).alias("keywords"),
                F.lit(level).alias("difficulty"),
            )
            for q, words, level in QA_CASES
        ]
    )


def _scored(spark, sf_dir):
    """Every document graded as an answer to every open question."""
    return texts(spark, sf_dir).select("doc_id", F.inline(graded("text", cases())))


def q_keyword_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select(
        "doc_id",
        "question",
        F.array_join("keywords_hit", "|").alias("keywords_hit"),
        F.round("score", 4).alias("score"),
    )


def q_avg_keyword_score(spark, sf_dir):
    return _rounded(avg_keyword_score(_scored(spark, sf_dir), "difficulty"))


QUERIES = {
    "normalize_labels": q_normalize_labels,
    "score_labels": q_score_labels,
    "map_labels": q_map_labels,
    "metrics_binary": q_metrics_binary,
    "metrics_multiclass": q_metrics_multiclass,
    "label_scores": q_label_scores,
    "task_results": q_task_results,
    "compare_scores": q_compare_scores,
    "keyword_scores": q_keyword_scores,
    "avg_keyword_score": q_avg_keyword_score,
}

SCORE = "(c_acctbal - 4500) / 5500"


def sql_class(score: str) -> str:
    return (
        f"CASE WHEN {score} < -0.1::DOUBLE THEN 'negative' "
        f"WHEN {score} >= 0.1::DOUBLE THEN 'positive' ELSE 'neutral' END"
    )


def sql_scores(source: str, by: str) -> str:
    """CTEs ending in ``scores``: per label support, predicted, tp, f1."""
    return f"""
    supports AS (
        SELECT {by}, target AS label, count(*) AS support,
               count(*) FILTER (target = prediction) AS tp
        FROM {source} GROUP BY ALL),
    guesses AS (SELECT {by}, prediction AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
    scores AS (
        SELECT {by}, label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
               coalesce(tp, 0) AS tp,
               2.0::DOUBLE * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1
        FROM supports FULL JOIN guesses USING ({by}, label))
    """


METRICS = """
    CAST(sum(support) AS BIGINT) AS n_samples,
    round(CAST(sum(tp) AS DOUBLE) / sum(support), {d}) AS accuracy,
    round(sum(f1 * support) / sum(support), {d}) AS f1_weighted,
    round(avg(f1), {d}) AS f1_macro,
    round(2.0::DOUBLE * sum(tp) / (sum(support) + sum(predicted)), {d}) AS f1_micro
"""

_SEGMENTS = f"""
segments AS (
    SELECT c_custkey, c_mktsegment, {sql_class(SCORE)} AS target,
           {sql_class(f'({SCORE} + 0.3::DOUBLE)')} AS prediction
    FROM customer)
"""

_TASKS = f"""
{_SEGMENTS},
answered AS (
    SELECT 'FiQA-SA' AS task, target, prediction,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN 'multitask' ELSE 'sentiment' END AS agent_used
    FROM segments
    UNION ALL
    SELECT 'Headline', CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), 'multitask' FROM labels),
{sql_scores('answered', 'task')},
results AS (
    SELECT task, {METRICS.format(d=4)},
           round(coalesce(max(f1) FILTER (label = '1'), 0), 4) AS f1_binary
    FROM scores GROUP BY task),
routing AS (
    SELECT task, nullif(count(*) FILTER (agent_used = 'sentiment'), 0) AS n_sentiment,
           nullif(count(*) FILTER (agent_used = 'multitask'), 0) AS n_multitask
    FROM answered GROUP BY task)
"""


def sql_cases() -> str:
    return " UNION ALL ".join(
        f"SELECT {sql_text(q)} AS question, [{', '.join(sql_text(w) for w in words)}] AS keywords, "
        f"'{level}' AS difficulty"
        for q, words, level in QA_CASES
    )


_SCORED = f"""
cases AS ({sql_cases()}),
graded AS (
    SELECT doc_id, question, difficulty, len(keywords) AS n,
           list_filter(keywords, lambda w: contains(lower(text), lower(w))) AS hit
    FROM documents, cases),
scored AS (SELECT *, CAST(len(hit) AS DOUBLE) / n AS score FROM graded)
"""

PUBLISHED = ", ".join(
    f"('{task}', '{system}', {'NULL' if score is None else score}::DOUBLE)"
    for task, system, score in PUBLISHED_SCORES
)

ORACLES = {
    "normalize_labels": """
        WITH answers AS (
            SELECT doc_id, lower(text || CASE
                       WHEN quality IS NULL THEN ''
                       WHEN quality = 1 AND toxic = 0 THEN chr(10) || 'The outlook is POSITIVE.'
                       WHEN quality = 1 THEN chr(10) || 'Negative, yet partly positive.'
                       WHEN toxic = 1 THEN chr(10) || 'Clearly Negative.'
                       ELSE chr(10) || 'Not since yesterday.' END) AS answer
            FROM documents LEFT JOIN labels USING (doc_id))
        SELECT doc_id,
               CASE WHEN answer LIKE '%positive%' THEN 'positive'
                    WHEN answer LIKE '%negative%' THEN 'negative' ELSE 'neutral' END AS sentiment,
               CASE WHEN answer LIKE '%yes%' THEN 1 ELSE 0 END AS yes_no
        FROM answers""",
    "score_labels": f"SELECT c_custkey, {sql_class(SCORE)} AS label FROM customer",
    "map_labels": """
        SELECT c_custkey,
               CASE WHEN c_acctbal < 2000 THEN 'negative' WHEN c_acctbal < 6500 THEN 'neutral'
                    WHEN c_acctbal < 9500 THEN 'positive' ELSE 'neutral' END AS seven_class,
               CASE c_nationkey WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral'
                                WHEN 2 THEN 'positive' END AS phrasebank,
               CASE c_nationkey WHEN 0 THEN 'negative' WHEN 1 THEN 'positive'
                                WHEN 2 THEN 'neutral' END AS tweet
        FROM customer""",
    "metrics_binary": f"""
        WITH pairs AS (SELECT 0 AS g, quality AS target, toxic AS prediction FROM labels),
        {sql_scores('pairs', 'g')}
        SELECT {METRICS.format(d=6)},
               round(coalesce(max(f1) FILTER (label = 1), 0), 6) AS f1_binary
        FROM scores""",
    "metrics_multiclass": f"""
        WITH {_SEGMENTS}, {sql_scores('segments', 'c_mktsegment')}
        SELECT c_mktsegment, {METRICS.format(d=6)} FROM scores GROUP BY c_mktsegment""",
    "label_scores": f"""
        WITH {_SEGMENTS}, {sql_scores('segments', 'c_mktsegment')}
        SELECT c_mktsegment, label, support, predicted, tp, round(f1, 6) AS f1 FROM scores""",
    "task_results": f"""
        WITH {_TASKS}
        SELECT task, n_samples, accuracy, f1_weighted,
               CASE WHEN task <> 'Headline' THEN f1_macro END AS f1_macro,
               CASE WHEN task <> 'Headline' THEN f1_micro END AS f1_micro,
               CASE WHEN task = 'Headline' THEN f1_binary END AS f1_binary,
               n_sentiment, n_multitask
        FROM results JOIN routing USING (task)""",
    "compare_scores": f"""
        WITH {_TASKS},
        published(task, system, reference) AS (VALUES {PUBLISHED})
        SELECT task, system, f1_weighted AS score, reference,
               round(f1_weighted - reference, 6) AS delta
        FROM results LEFT JOIN published USING (task)""",
    "keyword_scores": f"""
        WITH {_SCORED}
        SELECT doc_id, question, array_to_string(hit, '|') AS keywords_hit,
               round(score, 4) AS score
        FROM scored""",
    "avg_keyword_score": f"""
        WITH {_SCORED}
        SELECT difficulty, count(*) AS n_samples, round(avg(score), 6) AS avg_keyword_score
        FROM scored GROUP BY difficulty""",
}
