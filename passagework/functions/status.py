"""Retrieval status, its message and the warning, one CASE expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import (
    EMPTY_INDEX,
    EMPTY_INDEX_MSG,
    EMPTY_INDEX_WARNING,
    ERROR,
    ERROR_MSG,
    LOW_CONFIDENCE,
    LOW_CONFIDENCE_WARNING,
    NO_MATCH,
    NO_MATCH_MSG,
    NO_MATCH_WARNING,
    OK,
)


def rag_status(index_empty, failed, n_hits, n_passing) -> Column:
    """Checked in this order: no index, failed search, no hit, no passing hit."""
    return (
        F.when(index_empty, EMPTY_INDEX)
        .when(failed, ERROR)
        .when(n_hits == 0, NO_MATCH)
        .when(n_passing == 0, LOW_CONFIDENCE)
        .otherwise(OK)
    )


def rag_status_msg(status, n_hits, n_passing, best_score, max_distance: float) -> Column:
    low = F.concat(
        F.lit("All "), n_hits.cast("string"),
        F.lit(f" candidate chunk(s) exceeded the distance threshold ({max_distance}). "),
        F.lit("Best score: "),
        F.format_string("%.3f", best_score),
        F.lit(". Consider raising max_distance or adding more relevant documents."),
    )
    ok = F.concat(
        F.lit("Injected "), n_passing.cast("string"),
        F.lit(" chunk(s) (rejected "), (n_hits - n_passing).cast("string"),
        F.lit(" below threshold)."),
    )
    return (
        F.when(status == EMPTY_INDEX, EMPTY_INDEX_MSG)
        .when(status == ERROR, ERROR_MSG)
        .when(status == NO_MATCH, NO_MATCH_MSG)
        .when(status == LOW_CONFIDENCE, low)
        .otherwise(ok)
    )


def rag_warning(status, message) -> Column:
    """What to show beside the answer; null when context was injected."""
    failed = F.concat(
        F.lit("RAG retrieval failed ("), message,
        F.lit("). Answer based on model knowledge only."),
    )
    return (
        F.when(status == EMPTY_INDEX, EMPTY_INDEX_WARNING)
        .when(status == NO_MATCH, NO_MATCH_WARNING)
        .when(status == LOW_CONFIDENCE, F.concat(F.lit(LOW_CONFIDENCE_WARNING), message))
        .when(status == ERROR, failed)
    )
