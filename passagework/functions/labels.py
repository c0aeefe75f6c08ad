"""From model answers and raw dataset labels to comparable classes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import NEGATIVE_BELOW, POSITIVE_FROM
from passagework.functions.text import strip


def normalize_sentiment(col) -> Column:
    """Substring match, positive before negative, neutral when neither occurs."""
    text = F.lower(col)
    return (
        F.when(F.contains(text, F.lit("positive")), "positive")
        .when(F.contains(text, F.lit("negative")), "negative")
        .otherwise("neutral")
    )


def normalize_yes_no(col) -> Column:
    """1 when ``yes`` occurs anywhere (``yesterday`` counts), else 0."""
    return F.coalesce(F.contains(F.lower(col), F.lit("yes")).cast("int"), F.lit(0))


def score_to_label(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return (
        F.when(col < NEGATIVE_BELOW, "negative")
        .when(col >= POSITIVE_FROM, "positive")
        .otherwise("neutral")
    )


def map_labels(col, mapping: dict, default=None, clean: bool = False) -> Column:
    """Look a label up in a small fixed mapping, as a literal map.

    ``clean`` trims and lower-cases text labels first. Unknown labels give
    ``default``.
    """
    col = F.col(col) if isinstance(col, str) else col
    key = F.lower(strip(col)) if clean else col
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    # try_element_at: an unknown key is null under ANSI mode too
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))
