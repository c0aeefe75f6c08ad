"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagework.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the neighbourhood.

    The least is written first, so that the join reads both sides from a shuffle
    and the links of a node with very many can be split over tasks.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")), "least")
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.col("root").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    least = stored(links.groupBy("a").agg(F.min("b").alias("root")), "least")
    moved = links.join(least, "a").filter("b <> root").select(F.col("b").alias("a"), "root")
    return moved.unionByName(least).select("a", F.col("root").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (node, root): root is the smallest node reachable.

    Nodes without a link, and links of a node with itself, give no row. Roots
    themselves give a row. A round keeps at most one link per node and neighbour
    class, and is written to the shared folder; rounds end when the links have
    become stars, which large-star with small-star reach in few steps.
    """
    current = stored(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        if _is_stars(current):
            break
        current = stored(_small_star(_large_star(current)), "links")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _is_stars(links: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, and no root has any."""
    twice = links.groupBy("a").count().filter("count > 1").select("a")
    inner = links.select(F.col("b").alias("a")).distinct().join(links, "a", "left_semi")
    return twice.unionByName(inner).isEmpty()


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i], in place; a class has its least member as label."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label[:] = shorter
