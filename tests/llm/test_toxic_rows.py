"""Which rows the toxicity stage rejects when ids are missing or shared."""

from pyspark.sql import functions as F

from passagework.llm import toxicity


def test_every_row_goes_by_its_own_text(frame, spark):
    clean, toxic = "calm words here", "zgrub zgrub zgrub"
    labels = spark.range(1, 81).select(
        F.col("id").alias("doc_id"), (F.col("id") > 40).cast("int").alias("toxic")
    )
    model = toxicity.train(frame([clean] * 40 + [toxic] * 40), labels)
    docs = frame([toxic, clean, toxic, clean, None], ids=[None, None, 3, 3, 3])
    got = [(r.doc_id, r.text) for r in toxicity.without_toxic(docs, model).collect()]
    assert (None, clean) in got and (3, clean) in got
    assert toxic not in {text for _, text in got}
