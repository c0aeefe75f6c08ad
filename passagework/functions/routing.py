"""Keyword routing as one CASE expression built from a rules list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import DEFAULT_AGENT, ROUTES
from passagework.functions.text import contains_any


def route(col, rules=ROUTES, default: str = DEFAULT_AGENT) -> Column:
    """Name of the first group one of whose words occurs in the text."""
    lowered = F.lower(col)
    choice = None
    for agent, group in rules:
        hit = contains_any(lowered, group)
        choice = F.when(hit, agent) if choice is None else choice.when(hit, agent)
    return F.lit(default) if choice is None else choice.otherwise(default)
