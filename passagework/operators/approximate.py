"""Approximate search: trained cells, short codes of what is left, exact distances at the end.

The index is cut into cells around centres trained by k-means, and stored by cell. A
row carries a code of its residual, the difference from its centre, in one byte per
dimension. A question is compared with the codes of its nearest cells only; the best
``refine * k`` of a shard are compared once more by their vectors, so the scores that come
back are exact, and only rows outside the probed cells can be missing. How many cells
that takes depends on the vectors: it is measured on a bounded sample of the index when
it is built. What a search finds is measured with :func:`recall`.

Training reads a bounded sample, a pass per round: every task sums up the rows nearest
to each centre, and the sums, one row per cell, meet on the driver. The index itself is
coded in one pass. Small cells share a shard and large ones are cut into several; a
question is sent once to each shard that has one of its cells, in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.functions.fixed_values import TOP_K
from passagework.operators.cells import MAX_TASKS, PART_ROWS, _runs, shards_of, to_centres
from passagework.operators.nearest import rows_of, without_surplus_copies
from passagework.operators.search import knn, vector_size
from passagework.session import written

MAX_CELLS = 4096
SAMPLE_ROWS = 500_000
ROUNDS = 8
PROBES, REFINE = 16, 8
# Rows that tell how many cells hold this share of their nearest others.
TUNING_ROWS, TUNED_RECALL = 1000, 0.95
SHARD_ROWS = 32_768
QUESTION_ROWS = 256
LEVELS = 255


@dataclass(frozen=True)
class TrainedCells:
    """Centres, the range of residuals per dimension, how many rows each cell has, and how
    many cells are probed unless a search says so."""

    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    rows: np.ndarray
    probes: int = PROBES

    def parts(self) -> tuple:
        """What a broadcast carries: the class itself need not be known where it arrives."""
        return self.centres, self.low, self.step, self.rows, self.probes

    def place(self, vectors: np.ndarray) -> np.ndarray:
        return to_centres(vectors, self.centres).argmin(axis=1)

    def code(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        levels = np.rint((vectors - self.centres[cells] - self.low) / self.step)
        return np.clip(levels, 0, LEVELS).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: int) -> np.ndarray:
        return self.centres[cell] + self.low + codes * self.step

    def nearest(self, vectors: np.ndarray, probes: int) -> list[np.ndarray]:
        """Per vector the nearest cells that hold rows."""
        known = np.flatnonzero(self.rows)
        probes = min(probes, len(known))
        distances = to_centres(vectors, self.centres[known])
        order = np.argpartition(distances, probes - 1, axis=1)[:, :probes]
        return [known[o].astype(np.int32) for o in order]


def _usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    gap = F.exists("v", lambda e: e.isNull() | F.isnan(e))
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    return rows.where((F.size("v") == dim) & ~gap)


def _partial(shared, dim: int):
    """One row per cell of a task: rows, their sum, least and greatest residuals."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        counts = np.zeros(len(centres), dtype=np.int64)
        sums = np.zeros_like(centres)
        low, high = np.full(centres.shape, np.inf), np.full(centres.shape, -np.inf)
        for batch in batches:
            _, vectors = rows_of(batch["id"], batch["v"], dim)
            if not len(vectors):
                continue
            cells = to_centres(vectors, centres).argmin(axis=1)
            np.add.at(sums, cells, vectors)
            counts += np.bincount(cells, minlength=len(centres))
            left = vectors - centres[cells]
            np.minimum.at(low, cells, left)
            np.maximum.at(high, cells, left)
        met = np.flatnonzero(counts)
        lists = [pa.array(list(x[met]), pa.list_(pa.float64())) for x in (sums, low, high)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(counts[met]), *lists],
            names=["cell", "n", "total", "low", "high"],
        )

    return read


_PARTIAL = "cell int, n long, total array<double>, low array<double>, high array<double>"


def _merged(table: pa.Table) -> pa.Table:
    def stacked(name):
        return np.stack([np.array(x) for x in table.column(name).to_pylist()])

    lists = [stacked("total").sum(axis=0), stacked("low").min(axis=0), stacked("high").max(axis=0)]
    return pa.table(
        [pa.array([table.column("cell")[0].as_py()], pa.int32()),
         pa.array([sum(table.column("n").to_pylist())], pa.int64()),
         *[pa.array([list(x)], pa.list_(pa.float64())) for x in lists]],
        names=["cell", "n", "total", "low", "high"],
    )


def train_cells(
    rows: DataFrame, dim: int, n_cells: int, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS
) -> TrainedCells | None:
    """Cells of a table (id, v) of vectors of one size; None where it has no rows.

    The sample are the ``sample_rows`` rows that a hash of the id puts first; the first of
    these are the centres to start from. A centre that loses all rows stays where it is.
    """
    chosen = rows.withColumn("_order", F.xxhash64("id"))
    sample = written(chosen.orderBy("_order", "id").limit(sample_rows), "cell-sample")
    n_cells = max(1, min(n_cells, MAX_CELLS))
    first = sample.orderBy("_order", "id").limit(n_cells).toArrow()
    if not first.num_rows:
        return None
    centres = np.unique(rows_of(first["id"], first["v"], dim)[1], axis=0)
    context = rows.sparkSession.sparkContext
    for _ in range(rounds + 1):
        parts = sample.select("id", "v").mapInArrow(_partial(context.broadcast(centres), dim), _PARTIAL)
        sums = parts.groupBy("cell").applyInArrow(_merged, _PARTIAL).toArrow()
        cells = sums.column("cell").to_numpy()
        low, high = (np.stack([np.array(x) for x in sums.column(c).to_pylist()]) for c in ("low", "high"))
        trained = centres
        centres = centres.copy()
        totals = np.stack([np.array(x) for x in sums.column("total").to_pylist()])
        centres[cells] = totals / sums.column("n").to_numpy()[:, None]
    low, high = low.min(axis=0), high.max(axis=0)
    step = np.maximum((high - low) / LEVELS, 1e-12)
    return TrainedCells(trained, low, step, np.zeros(len(trained), dtype=np.int64))


def build_cells(
    index: DataFrame,
    path: str,
    n_cells: int | None = None,
    *,
    index_id: str = "chunk_id",
    vector: str = "embedding",
    dim: int | None = None,
) -> TrainedCells | None:
    """Trains cells on an index and stores its rows by cell below ``path``.

    By default there are as many cells as the square root of the number of rows. Rows
    without a vector of the index's size are left out; None and no files if all are.
    """
    spark = index.sparkSession
    dim = vector_size(index, vector) if dim is None else dim
    if dim is None:
        return None
    rows = written(_usable(index, index_id, vector, dim), "cell-rows")
    if n_cells is None:
        n_cells = int(np.sqrt(rows.count())) + 1
    cells = train_cells(rows, dim, n_cells)
    if cells is None:
        return None
    shared = spark.sparkContext.broadcast(cells.parts())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TrainedCells(*shared.value)
        for batch in batches:
            ids, vectors = rows_of(batch["id"], batch["v"], dim)
            place = known.place(vectors)
            codes = known.code(vectors, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place.astype(np.int32)), batch["id"], batch["v"],
                 pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["cell", "id", "v", "code"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    kind_v = rows.schema["v"].dataType.simpleString()
    placed = rows.mapInArrow(coded, f"cell int, id {kind}, v {kind_v}, code binary")
    # A range of ids beside the cell, so that a large cell is written by many tasks.
    placed.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").parquet(
        f"{path.rstrip('/')}/rows"
    )
    stored = spark.read.parquet(f"{path.rstrip('/')}/rows")
    for cell, n in stored.groupBy("cell").count().collect():
        cells.rows[cell] = n
    cells = replace(cells, probes=_tuned_probes(stored, cells, dim))
    meta = [(i, int(cells.rows[i]), c.tolist()) for i, c in enumerate(cells.centres)]
    schema = "cell int, n long, centre array<double>"
    spark.createDataFrame(meta, schema).coalesce(1).write.parquet(f"{path.rstrip('/')}/centres")
    scale = [(cells.low.tolist(), cells.step.tolist(), cells.probes)]
    schema = "low array<double>, step array<double>, probes int"
    spark.createDataFrame(scale, schema).coalesce(1).write.parquet(f"{path.rstrip('/')}/scale")
    return cells


def _tuned_probes(stored: DataFrame, cells: TrainedCells, dim: int, k: int = TOP_K) -> int:
    """How many cells hold ``TUNED_RECALL`` of the nearest others of a sample of the rows.

    The sample are the ``TUNING_ROWS`` rows that a hash of the id puts first, searched
    for in all rows; at most ``k`` cells of each meet on the driver.
    """
    first = stored.orderBy(F.xxhash64("id"), "id").limit(TUNING_ROWS)
    sample = written(first.select(F.col("id").alias("query_id"), "v"), "cell-tuning")
    rows = stored.select(F.col("id").alias("chunk_id"), "cell", "v")
    hits = knn(sample, rows, k + 1, vector="v", dim=dim).where("chunk_id <> query_id")
    met = hits.join(rows.select("chunk_id", "cell"), "chunk_id").groupBy("query_id").agg(
        F.collect_list("cell").alias("cells")
    )
    table = met.join(sample, "query_id").select("query_id", "cells", "v").toArrow()
    if not table.num_rows:
        return PROBES
    known = np.flatnonzero(cells.rows)
    number = {int(c): i for i, c in enumerate(known)}
    _, vectors = rows_of(table["query_id"], table["v"], dim)
    order = np.argsort(to_centres(vectors, cells.centres[known]), axis=1).argsort(axis=1)
    ranks = np.sort([
        order[i, number[c]] for i, met in enumerate(table["cells"].to_pylist()) for c in met
    ])
    return max(PROBES, int(ranks[int(np.ceil(TUNED_RECALL * len(ranks))) - 1]) + 1)


def load_cells(spark: SparkSession, path: str) -> TrainedCells:
    """What :func:`build_cells` stored: at most MAX_CELLS centres."""
    meta = spark.read.parquet(f"{path.rstrip('/')}/centres").orderBy("cell").collect()
    scale = spark.read.parquet(f"{path.rstrip('/')}/scale").first()
    return TrainedCells(
        np.array([r["centre"] for r in meta]), np.array(scale["low"]), np.array(scale["step"]),
        np.array([r["n"] for r in meta]), scale["probes"],
    )


def approximate_knn(
    queries: DataFrame,
    path: str,
    k: int = TOP_K,
    *,
    probes: int | None = None,
    refine: int = REFINE,
    query_id: str = "query_id",
    index_id: str = "chunk_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Near rows of a stored index: ``query_id, chunk_id, score, rank`` like ``knn``.

    ``probes`` cells are read per question, by default as many as the index was found to
    need, and of every shard ``refine * k`` rows are compared exactly.
    With all cells probed and rows enough to refine the result is that of ``knn``.
    Questions without a vector of the index's size have no hits.
    """
    spark = queries.sparkSession
    cells = load_cells(spark, path)
    dim = cells.centres.shape[1]
    probes = cells.probes if probes is None else probes
    q = written(_usable(queries, query_id, vector, dim), "probing")
    shared = spark.sparkContext.broadcast(cells.parts())
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
    bounds = shards_of(cells.rows, shard_rows)
    shards = max(b for _, b in bounds) + 1
    spans = [list(range(a, b + 1)) for a, b in bounds]

    @F.pandas_udf("array<int>")
    def visited(v: pd.Series) -> pd.Series:
        known = TrainedCells(*shared.value)
        near = known.nearest(np.stack(v.to_numpy()).astype(np.float64), probes)
        return pd.Series([np.array(sorted({s for c in n for s in spans[c]}), np.int32) for n in near])

    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-q.count() // PART_ROWS), -(-2 * cores // shards))
    start = F.element_at(F.lit([a for a, _ in bounds]), F.col("cell") + 1)
    end = F.element_at(F.lit([b for _, b in bounds]), F.col("cell") + 1)
    kind_q, kind_i = q.schema["id"].dataType, rows.schema["id"].dataType
    kind_v = rows.schema["v"].dataType
    if kind_v != q.schema["v"].dataType:
        kind_v = "array<double>"
    index_rows = rows.select(
        (start + F.pmod(F.xxhash64("id"), end - start + 1)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(0).alias("side"),
        F.col("id").alias("index_id"),
        F.lit(None).cast(kind_q).alias("query_id"),
        "cell",
        "code",
        F.col("v").cast(kind_v).alias("v"),
    )
    question_rows = q.select(
        F.explode(visited("v")).alias("shard"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("side"),
        F.lit(None).cast(kind_i).alias("index_id"),
        F.col("id").alias("query_id"),
        F.lit(None).cast("int").alias("cell"),
        F.lit(None).cast("binary").alias("code"),
        F.col("v").cast(kind_v).alias("v"),
    )
    schema = T.StructType([
        T.StructField(query_id, kind_q), T.StructField(index_id, kind_i),
        T.StructField("score", T.DoubleType()),
    ])
    exact = (
        index_rows.unionByName(question_rows)
        .repartitionById(
            min(shards * parts, MAX_TASKS),
            ((F.col("shard").cast("long") * parts + F.col("part")) % MAX_TASKS).cast("int"),
        )
        .sortWithinPartitions("shard", "part", "side")
        .mapInArrow(_compare(shared, probes, refine * k, k, dim, to_arrow_schema(schema)), schema)
    )
    nearest = Window.partitionBy(query_id).orderBy("score", index_id)
    return exact.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


class _Shard:
    """The rows of a shard: vectors, what their codes say of them, and where each cell is."""

    def __init__(self, batches: list[pa.RecordBatch], cells: TrainedCells, dim: int, k: int):
        ids, vectors, codes, at = [], [], [], []
        for rows in batches:
            more, block = rows_of(rows["index_id"], rows["v"], dim)
            ids += more
            vectors.append(block)
            at.append(rows["cell"].to_numpy())
            plain = np.frombuffer(b"".join(rows["code"].to_pylist()), dtype=np.uint8)
            codes.append(plain.reshape(-1, dim))
        block, at, codes = np.concatenate(vectors), np.concatenate(at), np.concatenate(codes)
        # Of copies the least ids are kept, by their places: codes and cells follow.
        by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__), dtype=np.int64)
        kept, block = without_surplus_copies(range(len(ids)), block[by_id], k)
        by_id = by_id[np.array(kept, dtype=np.int64)]
        # Places are in the order of the ids inside a cell, so a place does not rank rows.
        order = np.argsort(at[by_id], kind="stable")
        self.vectors, by_cell = block[order], by_id[order]
        self.ids = [ids[i] for i in by_cell]
        self.rank = order
        self.cells, first = np.unique(at[by_cell], return_index=True)
        self.edges = [*first.tolist(), len(by_cell)]
        decoded = np.empty((len(by_cell), dim + 1), dtype=np.float32)
        for cell, a, b in zip(self.cells, self.edges, self.edges[1:]):
            near = cells.decode(codes[by_cell[a:b]], cell)
            decoded[a:b, :-1], decoded[a:b, -1] = near, (near * near).sum(axis=1)
        self.decoded = decoded

    def search(self, asked: np.ndarray, probed: np.ndarray, wanted: int, k: int):
        """Question, place and exact score of the best ``k`` of ``wanted`` rows each;
        ``probed`` tells per question and cell of the shard whether it is compared."""
        sides = np.ones((len(asked), asked.shape[1] + 1), dtype=np.float32)
        sides[:, :-1] = -2.0 * asked
        if probed.all():
            rough = sides @ self.decoded.T
        else:
            rough = np.full((len(asked), len(self.decoded)), np.inf, dtype=np.float32)
            for j, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
                some = np.flatnonzero(probed[:, j])
                rough[some, a:b] = sides[some] @ self.decoded[a:b].T
        if rough.shape[1] > wanted:
            places = np.argpartition(rough, wanted - 1, axis=1)[:, :wanted]
        else:
            places = np.broadcast_to(np.arange(rough.shape[1]), rough.shape)
        questions = np.repeat(np.arange(len(asked)), places.shape[1])
        places = places.ravel()
        met = rough[questions, places] < np.inf
        questions, places = questions[met], places[met]
        gap = np.ascontiguousarray((asked[questions] - self.vectors[places]).T)
        score = np.zeros(len(questions))
        for step in gap:  # dimension order, as a left fold
            score += step * step
        order = np.lexsort((self.rank[places], score, questions))
        questions, places, score = questions[order], places[order], score[order]
        best = np.arange(len(questions)) - np.searchsorted(questions, questions) < k
        return questions[best], places[best], score[best]


def _compare(shared, probes: int, wanted: int, k: int, dim: int, arrow: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = TrainedCells(*shared.value)
        here, waiting, shard = None, [], None
        for batch in batches:
            for run, side, rows in _runs(batch):
                if run != here:
                    here, waiting, shard = run, [], None
                if side == 0:
                    waiting.append(rows)
                    continue
                if waiting:
                    shard, waiting = _Shard(waiting, cells, dim, k), []
                if shard is None:
                    continue
                ids, vectors = rows_of(rows["query_id"], rows["v"], dim)
                for at in range(0, len(ids), QUESTION_ROWS):
                    asked = vectors[at : at + QUESTION_ROWS]
                    chosen = cells.nearest(asked, probes)
                    probed = np.stack([np.isin(shard.cells, c) for c in chosen])
                    questions, places, score = shard.search(asked, probed, wanted, k)
                    columns = [[ids[at + i] for i in questions], [shard.ids[i] for i in places], score]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
                    )

    return read


def recall(found: DataFrame, exact: DataFrame, query_id="query_id", index_id="chunk_id") -> DataFrame:
    """n_exact, n_found and their share: how many of the exact hits were found."""
    both = exact.select(query_id, index_id).join(
        found.select(query_id, index_id, F.lit(True).alias("_met")), [query_id, index_id], "left"
    )
    counts = both.agg(F.count("*").alias("n_exact"), F.count("_met").alias("n_found"))
    return counts.withColumn("recall", F.col("n_found") / F.nullif(F.col("n_exact"), F.lit(0)))
