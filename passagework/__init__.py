"""Retrieval, evaluation and training-data preparation over text tables, on Spark."""
