"""Sources mixed to target weights by Poisson replication, with DataFrame functions only.

A source's rate is the number of times its text must be repeated to reach its
share of the target size. Every document draws its number of copies from a Poisson
distribution of that mean, by inverting it at a number hashed from seed and id, and
the copies are dealt to partitions and ordered by a hash of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import sized, stored

PART_RATE = 64.0
MAX_BROADCAST_SOURCES = 20_000


def hashed(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the hash of the parts."""
    return F.conv(F.substring(hashed(*parts), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def target_rates(
    docs: DataFrame,
    weights: DataFrame | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """(source, rate): mean repetitions per source, from sizes over all documents.

    A document's size is its bytes and one more for its end, so that no source has
    size zero. ``weights`` (source, weight >= 0) need not sum to one; a source that
    it does not name gets none. Without it a source weighs its size to the power
    ``temperature``. The null source is a source like others. The target size is
    ``epochs`` times that of the input.
    """
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(
        F.sum(F.octet_length(F.coalesce(text_column, F.lit(""))) + 1).alias("size")
    )
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        named = weights.select(F.col("source").alias("_named"), "weight")
        weighed = sizes.join(named, sizes["source"].eqNullSafe(F.col("_named")), "left").select(
            "source", "size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")
        )
    weighed = stored(weighed, "weights")
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["size"] or not total["weight"]:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    scale = epochs * float(total["size"]) / total["weight"]
    return weighed.select("source", F.round(F.col("weight") * scale / F.col("size"), 9).alias("rate"))


def _with_tables(rates: DataFrame) -> DataFrame:
    """Each source's cumulative distribution, up to where a double no longer grows.

    A large rate is the sum of ``parts`` draws of a smaller one.
    """
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART_RATE)).cast("int")
    mean = F.col("rate") / F.col("parts")
    steps = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        c = state["c"] + p
        return F.struct(
            p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all")
        )

    cumulative = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["all"])
    return rates.withColumn("parts", parts).withColumn("cumulative", cumulative)


def replicated(
    docs: DataFrame,
    rates: DataFrame,
    seed: str = "mix",
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """Copies of documents: row (all columns as a struct), n_copies, copy, mix_key.

    Rows that share an id draw alike, null ids too. A source without a rate gives
    no copies. Texts, nulls and extra columns are carried as they are; an empty
    table gives no rows. Partitions and the order in them follow ``mix_key``.
    """
    own_id = F.coalesce(F.col("row")[id_column].cast("string"), F.lit(""))

    def draw(total: Column, part: Column) -> Column:
        uniform = hashed_uniform(F.lit(seed), own_id, part.cast("string"))
        return total + F.size(F.filter("cumulative", lambda c: c <= uniform))

    table = stored(
        _with_tables(rates).select(F.col("source").alias("_source"), "parts", "cumulative"), "rates"
    )
    drawn = (
        docs.select(F.struct("*").alias("row"))
        .join(
            sized(table, MAX_BROADCAST_SOURCES),
            F.col("row")[source_column].eqNullSafe(F.col("_source")),
        )
        .withColumn("n_copies", F.aggregate(F.sequence(F.lit(1), "parts"), F.lit(0), draw))
        .filter("n_copies > 0")
        .select("row", "n_copies", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy"))
    )
    keyed = drawn.withColumn(
        "mix_key", hashed(F.lit(seed), F.lit("order"), own_id, F.col("copy").cast("string"))
    )
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key", "copy")


def mixed(docs: DataFrame, rates: DataFrame, seed: str = "mix") -> DataFrame:
    """The copies with the columns of ``docs`` alone, in shuffled order."""
    return replicated(docs, rates, seed).select("row.*")
