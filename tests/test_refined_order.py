"""The seeded order with buckets cut by further digits."""

import pytest
from pyspark.sql import functions as F

from passagework.operators import ordering
from passagework.operators.ordering import global_position, running_total
from passagework.operators.training import collate, pack_sequences


@pytest.mark.parametrize("digits, bound", [(4, 1), (1, 5), (1, 1000)])
def test_same_positions_whatever_the_bound(spark, monkeypatch, digits, bound):
    df = spark.range(700).withColumn("n", F.col("id") % 7)
    want = {r.id: (r.position, r.start) for r in running_total(
        global_position(df, "id"), "id", F.col("n")).collect()}
    monkeypatch.setattr(ordering, "BUCKET_DIGITS", digits)
    placed = running_total(global_position(df, "id", bucket_rows=bound), "id", F.col("n"), bucket_rows=bound)
    got = {r.id: (r.position, r.start) for r in placed.collect()}
    assert got == want and sorted(p for p, _ in got.values()) == list(range(700))


def test_batches_and_blocks(spark, monkeypatch):
    df = spark.range(60).select("id", F.sequence(F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("input_ids"))
    plain = [sorted(map(str, f.collect())) for f in (collate(df, 7, "id"), pack_sequences(df, 16, "id"))]
    monkeypatch.setattr(ordering, "BUCKET_DIGITS", 1)
    fine = [sorted(map(str, f.collect())) for f in (
        collate(df, 7, "id", bucket_rows=2), pack_sequences(df, 16, "id", bucket_rows=2))]
    assert plain == fine
    assert global_position(df.limit(0), "id", bucket_rows=1).count() == 0
