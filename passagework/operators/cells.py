"""Search plan for many questions: a k-NN join by Voronoi cells (VLDB 2012).

Index and questions are partitioned by cells around a bounded set of pivots.
The triangle inequality gives an upper bound of a question's k-th distance and
a lower bound of its distance to each cell, so a question meets only cells
that can hold one of its neighbours. Large cells are split by hash of the id into
shards of bounded size and small ones share a shard. Shards and blocks of questions are
files of the shared folder, each written once; a task reads a block of questions and, one
after another, the shards of its run of them that a question of the block can reach. So
neither side is copied for each meeting, no task grows with a table, and only the best k
of a block and a run of shards are shuffled. Index vectors are written to the shared
folder first: the passes over them (pivots, cells, shards) read that table, so that a
model makes each of them once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from passagework.operators.nearest import SLAB_ROWS, Best, rows_of
from passagework.session import shared_files, shared_folder, written
from passagework.sources.vector_blocks import read_block, write_blocks

SHARD_BYTES = 64 << 20
PART_ROWS = 65_536
MAX_PIVOTS = 256
MAX_TASKS = 50_000
MAX_RUN = 16  # shards that a task reads
PLACE_ROWS = 1024


@dataclass(frozen=True)
class Cells:
    """What is known of the cells that hold index rows; small enough to ship."""

    centres: np.ndarray  # (pivots, dim)
    known: np.ndarray  # numbers of the cells with rows
    rows: np.ndarray  # per known cell: how many
    inner: np.ndarray  # smallest and
    outer: np.ndarray  # largest distance to the centre
    radii: np.ndarray  # (known, k) smallest distances to the centre

    def reachable(self, vectors: np.ndarray, k: int) -> list[np.ndarray]:
        """Per vector the cells that can hold one of its k nearest index rows."""
        distances = to_centres(vectors, self.centres)[:, self.known]
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        size = 1.0 + np.sqrt((self.centres * self.centres).sum(axis=1).max()) + self.outer
        cells = []
        for row, norm in zip(distances, norms):
            ceiling = np.partition((row[:, None] + self.radii).ravel(), k - 1)[k - 1]
            floor = np.maximum(row - self.outer, self.inner - row)
            slack = 1e-6 * (size + norm)  # for rounding of the distances to centres
            cells.append(self.known[floor <= ceiling + slack].astype(np.int32))
        return cells


def to_centres(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (vectors * vectors).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(square - 2.0 * (vectors @ centres.T), 0.0))


def search_cells(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    dim: int,
    schema,
    shard_rows: int | None = None,
    pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """Nearest index rows per question and shard; both sides have ``id, v``."""
    kind = queries.schema["v"].dataType
    if kind != index.schema["v"].dataType:
        kind = "array<double>"
    index = _whole(written(index, "index-vectors"), dim, kind)
    centres = _pivots(index, dim, pivots)
    placed = _placed(index, centres)
    cells = _cells(placed, centres, k)
    if cells is None:
        return index.sparkSession.createDataFrame([], schema)
    bounds = shards_of(cells.rows, rows_per_shard(dim, shard_rows))
    first = {int(c): a for c, (a, _) in zip(cells.known, bounds)}
    last = {int(c): b for c, (_, b) in zip(cells.known, bounds)}
    shards = max(last.values()) + 1

    member = np.zeros((cells.known.max() + 1, shards), dtype=bool)
    for c in cells.known:
        member[c, first[int(c)] : last[int(c)] + 1] = True

    spark = index.sparkSession
    folder = shared_folder(spark, "search-blocks")
    most = min(max(1, PART_ROWS // 8), rows_per_shard(dim))
    asked = queries.select(F.lit(0).alias("block"), "id", F.col("v").cast(kind).alias("v"))
    blocks = write_blocks(asked, folder, most)
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    ends = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    start, end = F.element_at(starts, F.col("cell")), F.element_at(ends, F.col("cell"))
    index_rows = placed.select(
        (start + F.pmod(F.xxhash64("id"), end - start + 1)).cast("int").alias("block"), "id", "v"
    )
    dealt = index_rows.repartitionById(min(shards, MAX_TASKS), F.col("block") % MAX_TASKS)
    written_shards = write_blocks(dealt.sortWithinPartitions("block"), folder)
    files = [{"shard": b, "file": f} for b, f, _ in sorted(written_shards)]
    # Few bytes mean much work here: the number of tasks is fixed by the blocks.
    parts = _together(blocks, most)
    cores = spark.sparkContext.defaultParallelism
    runs = max(-(-4 * cores // max(1, len(parts))), -(-len(files) // MAX_RUN))
    cut = np.linspace(0, len(files), min(runs, len(files)) + 1).astype(int)
    tasks = [
        (part, files[a:b]) for part in parts for a, b in zip(cut.tolist(), cut[1:].tolist())
    ]
    if not tasks:
        return spark.createDataFrame([], schema)
    shard_file = pa.struct([("shard", pa.int32()), ("file", pa.string())])
    listed = pa.table({
        "task": pa.array(range(len(tasks)), pa.int32()),
        "questions": pa.array([part for part, _ in tasks], pa.list_(pa.string())),
        "shards": pa.array([run for _, run in tasks], pa.list_(shard_file)),
    })
    meetings = spark.createDataFrame(listed)  # from Arrow: needs no Python worker
    n = min(len(tasks), MAX_TASKS)
    return meetings.repartitionById(n, F.col("task") % n).mapInArrow(
        _search(folder, cells, member, k, dim, to_arrow_schema(schema)), schema
    )


def rows_per_shard(dim: int, shard_rows: int | None = None) -> int:
    """Index rows that a task holds as doubles at once, bounded in bytes if not by a caller."""
    return shard_rows or max(1024, SHARD_BYTES // (8 * dim))


def shards_of(rows, bound: int) -> list[tuple[int, int]]:
    """Per cell its first and last shard: small cells share one, large ones have several."""
    out, shard, held = [], -1, bound
    for n in map(int, rows):
        pieces = -(-n // bound)
        if pieces > 1:
            out.append((shard + 1, shard + pieces))
            shard, held = shard + pieces, bound
            continue
        if held + n > bound:
            shard, held = shard + 1, 0
        held += n
        out.append((shard, shard))
    return out


def _whole(side: DataFrame, dim: int, kind) -> DataFrame:
    gap = F.exists("v", lambda e: e.isNull() | F.isnan(e))
    usable = side.where((F.size("v") == dim) & ~gap)
    return usable.select("id", F.col("v").cast(kind).alias("v"))


def _pivots(index: DataFrame, dim: int, n: int) -> np.ndarray:
    """At most ``n`` index vectors, chosen by hash of the id: a bounded collect."""
    chosen = index.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    return np.unique(rows_of(chosen["id"], chosen["v"], dim)[1], axis=0)


def _placed(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """Index rows with the cell they are in and their distance to its centre."""

    @F.arrow_udf("struct<cell:int,d:double>")
    def nearest_centre(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for at in range(0, len(batch), PLACE_ROWS):
                rows = batch.slice(at, PLACE_ROWS)
                flat = rows.flatten().to_numpy(zero_copy_only=False)
                vectors = flat.astype(np.float64).reshape(len(rows), -1)
                distances = to_centres(vectors, centres)
                cell = distances.argmin(axis=1)
                nearest = distances[np.arange(len(cell)), cell]
                yield pa.StructArray.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(nearest)], ["cell", "d"]
                )

    return index.withColumn("at", nearest_centre("v")).select("id", "v", "at.cell", "at.d")


def _cells(placed: DataFrame, centres: np.ndarray, k: int) -> Cells | None:
    """Summary of the cells: one row with at most k radii per pivot is collected."""
    by_distance = Window.partitionBy("cell").orderBy("d")
    nearest = (
        placed.select("cell", "d")
        .withColumn("i", F.row_number().over(by_distance))
        .where(F.col("i") <= k)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("d")).alias("radii"))
    )
    size = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("d").alias("inner"), F.max("d").alias("outer")
    )
    found = size.join(nearest, "cell").orderBy("cell").collect()
    if not found:
        return None
    radii = [(r["radii"] + [np.inf] * k)[:k] for r in found]
    return Cells(
        centres,
        np.array([r["cell"] for r in found]),
        np.array([r["n"] for r in found]),
        np.array([r["inner"] for r in found]),
        np.array([r["outer"] for r in found]),
        np.array(radii),
    )


def _together(blocks, most: int) -> list[list[str]]:
    """Files of questions, as many for a task as have ``most`` rows at most."""
    parts, held = [], most
    for block in sorted(blocks, key=lambda b: (-b["n"], b["file"])):
        if held + block["n"] > most:
            parts.append([])
            held = 0
        parts[-1].append(block["file"])
        held += block["n"]
    return parts


def _search(folder: str, cells: Cells, member: np.ndarray, k: int, dim: int, arrow: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = shared_files(folder)

        def slabs(file: str) -> Iterator[tuple[list, np.ndarray]]:
            for rows in read_block(store, root, file, SLAB_ROWS):
                yield rows_of(rows["id"], rows["v"], dim)

        for batch in batches:
            for task in batch.to_pylist():
                ids, vectors = zip(*(slab for file in task["questions"] for slab in slabs(file)))
                best = Best([i for part in ids for i in part], np.concatenate(vectors), k)
                del ids, vectors
                reached = np.zeros((len(best.ids), member.shape[1]), dtype=bool)
                for at in range(0, len(best.ids), PLACE_ROWS):
                    near = cells.reachable(best.vectors[at : at + PLACE_ROWS], k)
                    reached[at : at + len(near)] = [member[c].any(axis=0) for c in near]
                for shard in task["shards"]:
                    asked = np.flatnonzero(reached[:, shard["shard"]])
                    for slab in slabs(shard["file"]) if len(asked) else ():
                        best.add(*slab, asked)
                yield best.batch(arrow)

    return search


def _runs(batch: pa.RecordBatch):
    """Slices of equal (shard, part, side) in a sorted batch."""
    if not batch.num_rows:
        return
    columns = [batch[c].to_numpy() for c in ("shard", "part", "side")]
    change = np.zeros(batch.num_rows - 1, dtype=bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield (columns[0][a], columns[1][a]), columns[2][a], batch.slice(a, b - a)
