"""Parse structured forecast answers into columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagework.functions.fixed_values import FORECAST_SECTIONS
from passagework.functions.text import strip

POSITIVES, CONCERNS, PREDICTION = FORECAST_SECTIONS
MOVE = r"(?i)prediction:\s*(up|down)"
PERCENT = r"(?i)prediction:\s*(?:up|down)[^0-9%\n]*([0-9]+(?:\.[0-9]+)?)\s*%"


def _literal(header: str) -> str:
    return re.sub(r"([\[\]&])", r"\\\1", header) + ":?"


def _section(col: Column, header: str) -> Column:
    """What follows a header, up to whichever header comes next."""
    others = "|".join(_literal(h) for h in FORECAST_SECTIONS if h != header)
    end = f"(?:{others}|$)"
    body = F.regexp_extract(col, f"(?s){_literal(header)}(.*?){end}", 1)
    return F.nullif(strip(body), F.lit(""))


def parse_forecast(col) -> Column:
    """Struct of the three sections, the direction and the percentage.

    A section, direction or percentage that is not there is null.
    """
    col = F.col(col) if isinstance(col, str) else col
    prediction = _section(col, PREDICTION)
    return F.struct(
        _section(col, POSITIVES).alias("positive_developments"),
        _section(col, CONCERNS).alias("potential_concerns"),
        prediction.alias("prediction_analysis"),
        F.nullif(F.lower(F.regexp_extract(prediction, MOVE, 1)), F.lit("")).alias("direction"),
        F.nullif(F.regexp_extract(prediction, PERCENT, 1), F.lit(""))
        .cast("double").alias("percent"),
    )
