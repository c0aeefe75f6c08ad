"""Queries over the given tables, each beside SQL that must give the same rows."""

from __future__ import annotations

from passagework.catalog import answers, evaluation, ingestion, questions, retrieval, training

MODULES = [retrieval, questions, answers, evaluation, training, ingestion]


def queries() -> dict:
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
