import pytest
from pyspark import cloudpickle

import passagework

cloudpickle.register_pickle_by_value(passagework)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Texts to documents, with ids from 1 and a column whose name an operator uses too."""

    def make(texts, ids=None, sources=None):
        ids = ids or range(1, len(texts) + 1)
        sources = sources or ["s"] * len(texts)
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
        from pyspark.sql import functions as F

        return spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("own")).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, one word, a very long text, and other scripts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [None, "", " \t\n", "a", "a", "A b c", long, long + " end", "日本語 テキスト 😀", "x" * 20_000]
