"""Accuracy, the F1 family, keyword scores and comparison with references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["support", "predicted", "tp"]


def align(predictions: DataFrame, targets: DataFrame, on="example_id") -> DataFrame:
    """Every target beside its prediction, by id; null where there is none."""
    return targets.join(predictions, on, "left")


def confusion(df: DataFrame, target: str, prediction: str, by=()) -> DataFrame:
    """Rows per (group, target, prediction): the only pass over the data.

    Counted before the shuffle, so a label that holds most rows costs one row
    per partition.
    """
    by = _listed(by)
    return df.groupBy(
        *by, F.col(target).alias("target"), F.col(prediction).alias("prediction")
    ).agg(F.count("*").alias("n"))


def label_scores(df: DataFrame, target: str, prediction: str, by=()) -> DataFrame:
    """Per label seen in targets or predictions: hits, support, predicted, F1."""
    by = _listed(by)
    counts = confusion(df, target, prediction, by)
    rows = counts.select(*by, F.inline(F.array(*_sides())))
    return _with_f1(rows.groupBy(*by, "label").agg(*_sums(COUNTS)))


def _sides(*more: Column) -> list[Column]:
    """A row of the confusion table seen from its target and from its prediction."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("target").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(none)
    return [
        F.struct(
            F.col(label).alias("label"), *[c.alias(n) for n, c in zip(COUNTS, values)], *more
        )
        for label, values in (
            ("target", (F.col("n"), none, hit)),
            ("prediction", (none, F.col("n"), none)),
        )
    ]


def _sums(names) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _with_f1(labels: DataFrame) -> DataFrame:
    # support + predicted is never zero, so an F1 of zero comes from tp
    return labels.withColumn("f1", 2.0 * F.col("tp") / (F.col("support") + F.col("predicted")))


def classification_metrics(
    df: DataFrame, target: str, prediction: str, by=(), pos_label=None
) -> DataFrame:
    """Accuracy, weighted, macro and micro F1; binary F1 for ``pos_label``.

    Macro averages over the labels of targets and predictions together. For one
    label per row, micro F1 equals accuracy.
    """
    by = _listed(by)
    labels = label_scores(df, target, prediction, by)
    metrics = [c.alias(name) for name, c in _metric_columns(pos_label).items()]
    return labels.groupBy(*by).agg(F.sum("support").alias("n_samples"), *metrics)


def _metric_columns(pos_label=None) -> dict[str, Column]:
    """Aggregates over the rows of one group of ``label_scores``."""
    total = F.sum("support")
    columns = {
        "accuracy": F.sum("tp") / total,
        "f1_weighted": F.sum(F.col("f1") * F.col("support")) / total,
        "f1_macro": F.avg("f1"),
        "f1_micro": 2.0 * F.sum("tp") / (total + F.sum("predicted")),
    }
    if pos_label is not None:
        of_label = F.when(F.col("label") == F.lit(pos_label), F.col("f1"))
        columns["f1_binary"] = F.coalesce(F.max(of_label), F.lit(0.0))
    return columns


def keyword_hits(text, keywords) -> Column:
    """Keywords that occur in the text, as substrings in any case, in list order.

    The one-element array binds the lower-cased text to a variable; written
    straight into the filter it would be lower-cased again for every keyword.
    """
    found = F.transform(
        F.array(F.lower(text)),
        lambda lowered: F.filter(keywords, lambda word: F.contains(lowered, F.lower(word))),
    )
    return F.get(found, 0)


def keyword_scores(df: DataFrame, text: str = "answer", keywords: str = "keywords") -> DataFrame:
    """Add ``keywords_hit`` and ``score``, the share of the keywords found."""
    share = F.size("keywords_hit") / F.nullif(F.size(keywords), F.lit(0))
    return df.withColumn("keywords_hit", keyword_hits(text, keywords)).withColumn("score", share)


def graded(text, cases) -> Column:
    """Every case of an array of structs with ``keywords``, graded against one text.

    The text is lower-cased once and never copied: what comes back are the cases with
    ``keywords_hit`` and ``score``, to be made rows with ``inline``.
    """

    def one(lowered: Column, case: Column) -> Column:
        hits = F.filter(case["keywords"], lambda word: F.contains(lowered, F.lower(word)))
        return case.withField("keywords_hit", hits)

    marked = F.transform(F.array(F.lower(text)), lambda t: F.transform(cases, lambda c: one(t, c)))
    share = lambda c: F.size(c["keywords_hit"]) / F.nullif(F.size(c["keywords"]), F.lit(0))
    return F.transform(F.get(marked, 0), lambda c: c.withField("score", share(c)))


def avg_keyword_score(scored: DataFrame, by=()) -> DataFrame:
    """Unweighted mean over the cases."""
    return scored.groupBy(*_listed(by)).agg(
        F.count("*").alias("n_samples"), F.avg("score").alias("avg_keyword_score")
    )


def task_results(
    df: DataFrame,
    target: str = "target",
    prediction: str = "prediction",
    task: str = "task",
    agent: str | None = "agent_used",
    pos_label=None,
    digits: int = 4,
) -> DataFrame:
    """One row per task: size, rounded metrics, queries per agent.

    The data is grouped once, by task, target, prediction and agent. Labels and
    agents are then rows of one small table, so nothing has to be joined.
    """
    counts = confusion(df, target, prediction, [task, *_listed(agent or ())])
    rounded = [F.round(c, digits).alias(name) for name, c in _metric_columns(pos_label).items()]
    columns = [F.sum("support").alias("n_samples"), *rounded]
    if not agent:
        rows = counts.select(task, F.inline(F.array(*_sides())))
        return _with_f1(rows.groupBy(task, "label").agg(*_sums(COUNTS))).groupBy(task).agg(*columns)

    def missing(name, like):
        return F.lit(None).cast(counts.schema[like].dataType).alias(name)

    per_label = _sides(missing("_agent", agent), missing("_asked", "n"))
    per_agent = F.struct(
        missing("label", "target"),
        *[missing(c, "n") for c in COUNTS],
        F.col(agent).alias("_agent"),
        F.col("n").alias("_asked"),
    )
    rows = counts.select(task, F.inline(F.array(*per_label, per_agent)))
    grouped = rows.groupBy(task, "label", "_agent").agg(*_sums([*COUNTS, "_asked"]))
    entry = F.struct(F.col("_agent").alias(agent), F.col("_asked").alias("n"))
    # A target without an answer was put to no agent.
    asked = F.collect_list(F.when(F.col("_asked").isNotNull() & F.col("_agent").isNotNull(), entry))
    routing = F.map_from_entries(F.sort_array(asked)).alias("routing")
    return _with_f1(grouped).groupBy(task).agg(*columns, routing)


def compare_scores(
    results: DataFrame, published: DataFrame, score: str = "f1_weighted", task: str = "task"
) -> DataFrame:
    """Our score beside each published one; the difference is null without one."""
    reference = published.select(task, "system", F.col("score").alias("reference"))
    return (
        results.select(task, F.col(score).alias("score"))
        .join(reference, task, "left")
        .withColumn("delta", F.col("score") - F.col("reference"))
    )


def _listed(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)
