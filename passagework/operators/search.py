"""Exact k-nearest-neighbour search by squared Euclidean distance.

Two plans give the same rows:

* few questions: their matrix is broadcast, every index partition keeps its own
  best k per question while it streams by, and the partial results are merged
  by one top-k shuffle. The index itself is never shuffled.
* many questions, above ``max_broadcast_bytes``: both sides are partitioned by
  cells, see ``cells``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.functions.fixed_values import MAX_DISTANCE, TOP_K
from passagework.operators.cells import MAX_PIVOTS, search_cells
from passagework.operators.nearest import Best, rows_of, slices_of

MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_HITS = 1_000_000


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int = TOP_K,
    *,
    query_id: str = "query_id",
    index_id: str = "chunk_id",
    vector: str = "embedding",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    shard_rows: int | None = None,
    pivots: int = MAX_PIVOTS,
    dim: int | None = None,
) -> DataFrame:
    """Nearest ``k`` index rows of every question: ``query_id, chunk_id, score, rank``.

    Questions and index rows without a vector of the index's size take no part.
    Equal distances are ordered by the index id. Ids must be unique per side.
    ``dim`` saves a look at the index where the size is known.
    """
    types = (queries.schema[query_id].dataType, index.schema[index_id].dataType)
    schema = T.StructType(
        [
            T.StructField(query_id, types[0]),
            T.StructField(index_id, types[1]),
            T.StructField("score", T.DoubleType()),
        ]
    )
    dim = vector_size(index, vector) if dim is None else dim
    if dim is None or k < 1:
        empty = index.sparkSession.createDataFrame([], schema)
        return empty.withColumn("rank", F.lit(0))
    q = queries.select(F.col(query_id).alias("id"), F.col(vector).alias("v"))
    usable = q.where(F.size("v") == dim)
    x = index.select(F.col(index_id).alias("id"), F.col(vector).alias("v"))

    bound = max(1, max_broadcast_bytes // (8 * dim))
    table = usable.limit(bound + 1).toArrow()  # never more than the broadcast bound
    if table.num_rows == 0:
        return index.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    rows = table.num_rows
    few = rows <= bound
    if few:
        hits = _by_broadcast(table, x, k, dim, schema)
    else:
        del table  # the driver needs the memory
        hits = search_cells(q, x, k, dim, schema, shard_rows, pivots)
    nearest = Window.partitionBy(query_id).orderBy("score", index_id)
    ranked = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    # The number of questions is known here, so is the size of the result: say so
    # to a later join, which would otherwise start to shuffle the index.
    return F.broadcast(ranked) if few and rows * k <= MAX_BROADCAST_HITS else ranked


def gate(hits: DataFrame, max_distance: float = MAX_DISTANCE, score: str = "score") -> DataFrame:
    """Mark the hits near enough to be used; the bound itself still passes."""
    return hits.withColumn("passing", F.col(score) <= F.lit(float(max_distance)))


def vector_size(index: DataFrame, vector: str = "embedding") -> int | None:
    """Length of the index's vectors, or None when it holds none."""
    row = index.where(F.col(vector).isNotNull()).select(F.size(vector)).head()
    return row[0] if row else None


def _by_broadcast(table: pa.Table, x: DataFrame, k: int, dim: int, schema) -> DataFrame:
    arrow = to_arrow_schema(schema)
    shared = x.sparkSession.sparkContext.broadcast(rows_of(table["id"], table["v"], dim))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k)
        for batch in batches:
            for rows in slices_of(batch, dim):
                ids, block = rows_of(rows["id"], rows["v"], dim)
                if ids:
                    best.add(ids, block)
        yield best.batch(arrow)

    return x.mapInArrow(search, schema)
