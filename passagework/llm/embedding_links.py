"""Near-duplicate vectors by an epsilon grid order join.

Vectors are sorted by the cells of a grid on their leading principal dimensions
and cut into blocks. Intervals of the sequence are joined recursively: a pair of
intervals whose boxes lie farther apart than epsilon is skipped, the others are
opened, down to pairs of blocks that are compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import sized, stored
from passagework.llm.components import components, unite

AXES = 6
MAX_COVARIANCE = 256
BLOCK_ROWS = 512
# Blocks that are sent together; divides 2^32, so that a strip lies in one task's numbers.
STRIP_BLOCKS = 4
FAN_OUT = 16
SLACK = 1e-9


def _usable():
    """Non-empty, no null, finite, not all zero."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    top = F.array_max(sizes)
    return (
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull())
        & (top > 0)
        & (top < F.lit(float("inf")))
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
        len(column), -1
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _moments(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for batch in batches:
            if batch.num_rows:
                rows = _unit(matrix(batch.column("embedding")))[:, :dim]
                rows = np.hstack([rows, np.ones((len(rows), 1))])
                total += rows.T @ rows
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())],
            names=["i", "j", "v"],
        )

    return add


def principal_axes(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(length, axes) for vectors of the most common length, from all of them.

    Only the speed of the join depends on the axes. Of longer vectors the first
    MAX_COVARIANCE components are used, so the table of sums stays small.
    """
    lengths = distinct.groupBy(F.size("embedding").alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), "dim").first()
    if common is None:
        return 0, np.zeros((0, 0))
    dim = min(common["dim"], MAX_COVARIANCE)
    sums = np.zeros((dim + 1, dim + 1))
    rows = distinct.filter(F.size("embedding") == common["dim"]).select("embedding")
    found = rows.mapInArrow(_moments(dim), "i int, j int, v double")
    for i, j, v in found.groupBy("i", "j").agg(F.sum("v")).collect():
        sums[i, j] = v
    mean = sums[:dim, dim] / sums[dim, dim]
    covariance = sums[:dim, :dim] / sums[dim, dim] - np.outer(mean, mean)
    return common["dim"], np.linalg.eigh(covariance)[1][:, ::-1][:, :AXES]


def _project(length: int, axes: np.ndarray, epsilon: float):
    """Coordinates on the leading axes, and the grid cell of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            place = np.zeros((batch.num_rows, AXES))
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                unit = _unit(matrix(batch.column("embedding").take(pa.array(of))))
                on = unit[:, : len(axes)] @ axes if size == length else unit[:, :AXES]
                place[of, : on.shape[1]] = on
            cells = np.floor(place / epsilon).astype(np.int32)
            columns = [batch.column(c) for c in ("node", "label", "copies", "embedding")]
            columns += [pa.array(sizes.astype(np.int32))]
            columns += [
                pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), AXES).cast(pa.list_(t))
                for x, t in ((place, pa.float64()), (cells, pa.int32()))
            ]
            yield pa.RecordBatch.from_arrays(
                columns,
                names=["node", "label", "copies", "embedding", "dim", "place", "cell"],
            )

    return read


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of at most BLOCK_ROWS sorted rows of one label and length are a block."""
    from pyspark import TaskContext

    block, held, group = (TaskContext.get().partitionId() << 32) - 1, BLOCK_ROWS, None
    for batch in batches:
        keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
        numbers = []
        for key in keys:
            if key != group or held == BLOCK_ROWS:
                block, held, group = block + 1, 0, key
            held += 1
            numbers.append(block)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "block"]
        )


def _near(a: str, b: str, epsilon: float):
    """Whether two boxes lie within epsilon."""
    gaps = [
        F.greatest(
            F.lit(0.0),
            F.col(f"{b}.low")[k] - F.col(f"{a}.high")[k],
            F.col(f"{a}.low")[k] - F.col(f"{b}.high")[k],
        )
        for k in range(AXES)
    ]
    return sum(g * g for g in gaps) <= epsilon * epsilon + SLACK


def ranked(bounds: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of a block (label, dim, block) among those of its label.

    Blocks of a label follow each other in a task, so only the counts of the tasks are
    summed up: a window over a short row for each task, not over the blocks.
    """
    from pyspark.sql import Window

    task = F.shiftright("block", 32).alias("task")
    keys = ["label", "dim", "task"]
    counts = bounds.groupBy("label", "dim", task).agg(
        F.min("block").alias("first"), F.count("*").alias("n")
    )
    before = F.sum("n").over(Window.partitionBy("label", "dim").orderBy("task")) - F.col("n")
    placed = stored(counts.select(*keys, "first", before.alias("before")), "tasks")
    return bounds.withColumn("task", task).join(sized(placed), keys).select(
        *bounds.columns, (F.col("block") - F.col("first") + F.col("before")).alias("rank")
    )


def block_pairs(blocked: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b in grid order, whose boxes lie within epsilon."""
    low, high = (
        F.array(*[f(F.col("place")[k]) for k in range(AXES)]) for f in (F.min, F.max)
    )
    bounds = stored(
        blocked.groupBy("label", "dim", "block").agg(low.alias("low"), high.alias("high")),
        "bounds",
    )
    boxes = stored(ranked(bounds), "boxes")
    most = boxes.agg(F.max("rank")).first()[0]
    levels = max(1, math.ceil(math.log(max(2, (most or 0) + 1), FAN_OUT)))
    pairs = boxes.select("label", "dim", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).distinct()
    for level in range(levels - 1, -1, -1):
        width = FAN_OUT**level
        low, high = (
            F.array(*[f(F.col(c)[k]) for k in range(AXES)])
            for c, f in (("low", F.min), ("high", F.max))
        )
        level_boxes = (
            boxes.groupBy("label", "dim", F.floor(F.col("rank") / width).alias("at"))
            .agg(low.alias("low"), high.alias("high"), F.min("block").alias("block"))
            .withColumn("parent", F.floor(F.col("at") / FAN_OUT))
        )
        x = level_boxes.alias("x")
        y = level_boxes.alias("y")
        up = pairs.alias("p")
        opened = up.join(
            x,
            (F.col("p.label") == F.col("x.label"))
            & (F.col("p.dim") == F.col("x.dim"))
            & (F.col("p.a") == F.col("x.parent")),
        ).join(
            y,
            (F.col("p.label") == F.col("y.label"))
            & (F.col("p.dim") == F.col("y.dim"))
            & (F.col("p.b") == F.col("y.parent"))
            & (F.col("x.at") <= F.col("y.at"))
            & _near("x", "y", epsilon),
        )
        if level:
            pairs = opened.select(
                "p.label", "p.dim", F.col("x.at").alias("a"), F.col("y.at").alias("b")
            )
    return opened.select(F.col("x.block").alias("a"), F.col("y.block").alias("b"))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` have at least that cosine, in doubles."""
    cosine = _unit(a) @ _unit(b).T
    found = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < SLACK)
    if len(i):
        x, y = a[i], b[j]
        dot, xx, yy = (x * y).sum(axis=1), (x * x).sum(axis=1), (y * y).sum(axis=1)
        found[i, j] = dot / np.sqrt(xx) / np.sqrt(yy) >= threshold
    return found


def _compare(threshold: float):
    """The pairs of blocks of two strips, beside the rows of these strips."""

    def one_pair(a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = linked(a[2], b[2], threshold)
        if a is b:
            np.fill_diagonal(found, False)
            nodes, links, shift = a[0], found @ a[1], 0
        else:
            nodes, shift = np.concatenate((a[0], b[0])), len(a[0])
            links = np.concatenate((found @ b[1], found.T @ a[1]))
        i, j = np.nonzero(found)
        label = np.arange(len(nodes))
        unite(label, i, j + shift)
        has = np.flatnonzero(links)
        return nodes[has], links[has], nodes[label[has]]

    def compare(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        rows = rows.sort_by("block").combine_chunks()
        blocks, starts = np.unique(rows.column("block").to_numpy(), return_index=True)
        held = {}
        for block, start, end in zip(blocks.tolist(), starts, [*starts[1:], len(rows)]):
            own = rows.slice(start, end - start)
            nodes, copies = (own.column(c).to_numpy() for c in ("node", "copies"))
            held[block] = nodes, copies, matrix(own.column("embedding"))
        ends = zip(*(pairs.column(c).to_pylist() for c in ("a", "b")))
        found = zip(*(one_pair(held[a], held[b]) for a, b in ends))
        return pa.table(
            {n: np.concatenate(f) for n, f in zip(("node", "links", "root"), found)}
        )

    return compare


def vector_links(distinct: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): links by pair of blocks, and a tree of each local component."""
    epsilon = math.sqrt(2 - 2 * threshold) + SLACK
    length, axes = principal_axes(distinct)
    fields = (
        "node long, label long, copies long, embedding array<double>, dim int, "
        "place array<double>, cell array<int>"
    )
    placed = distinct.mapInArrow(_project(length, axes, epsilon), fields)
    order = ["label", "dim", *[F.col("cell")[k] for k in range(AXES)], "node"]
    blocked = stored(
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_number, fields + ", block long"),
        "grid-order",
    )
    # Neighbouring blocks travel together, once for all pairs between two strips.
    strip = [F.floor(F.col(c) / STRIP_BLOCKS) for c in ("a", "b")]
    pairs = stored(
        block_pairs(blocked, epsilon).select(strip[0].alias("x"), strip[1].alias("y"), "a", "b"),
        "pairs",
    )
    met = pairs.select("x", "y").distinct()
    wanted = stored(
        met.select("x", "y", F.col("x").alias("strip")).unionByName(
            met.filter("x <> y").select("x", "y", F.col("y").alias("strip"))
        ),
        "strips",
    )
    rows = blocked.select(
        F.floor(F.col("block") / STRIP_BLOCKS).alias("strip"), "block", "node", "copies", "embedding"
    ).join(sized(wanted), "strip").drop("strip")
    return rows.groupBy("x", "y").cogroup(pairs.groupBy("x", "y")).applyInArrow(
        _compare(threshold), "node long, links long, root long"
    )


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, label, embedding): vec_id, n_links,
    component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths
    agree. A vector that is null, empty, zero, or has a null or non-finite
    component links with nothing: it is its own component. So does a row with a
    null id, whose component is null and which is kept. Equal vectors of one label
    are one node of the join, so copies cost one row; repeated rows count as
    vectors of their own. An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    usable = rows.filter(_usable() & F.col("vec_id").isNotNull())
    distinct = stored(
        usable.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    links = stored(
        vector_links(distinct.select("node", "label", "copies", "embedding"), threshold), "links"
    )
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = distinct.join(roots, "node", "left").join(counted, "node", "left").select(
        "label", "embedding", "first", "copies",
        F.coalesce("root", "node").alias("root"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    nodes = stored(nodes, "nodes")
    least = nodes.groupBy("root").agg(F.min("first").alias("component"))
    classes = nodes.join(least, "root").select(
        "label", "embedding", "component",
        (F.col("links") + F.col("copies") - 1).alias("links"),
    )
    found = usable.join(classes, ["label", "embedding"]).select(
        "vec_id",
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        (F.col("vec_id") == F.col("component")).alias("kept"),
    )
    alone = rows.filter(~F.coalesce(_usable() & F.col("vec_id").isNotNull(), F.lit(False))).select(
        "vec_id",
        F.lit(0).cast("long").alias("n_links"),
        F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"),
    )
    return found.unionByName(alone)
