"""Connected components of a graph that may not fit one machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

EDGES = 1 << 20  # edges that a task holds at once


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the smallest of its component among these edges, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        after, low = root.copy(), np.minimum(root[x], root[y])
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            own = np.flatnonzero(root < np.arange(len(root)))
            return nodes[own], nodes[root[own]]
        root = after


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= EDGES:
            yield _star(held)
            held, size = [], 0
    if size:
        yield _star(held)


def _star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    edges = pa.Table.from_batches(held)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(edges["a"].to_numpy(), edges["b"].to_numpy())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), long: root is the smallest node reachable.

    Each task makes its own edges stars. Where a node is still in several of them, rounds of linking every larger neighbour,
    then every smaller one, to the smallest (large-star, small-star) follow; the number of rounds grows with the logarithm of the
    longest chain. Each round's edges are written to the shared folder, so a lost executor costs no earlier round.
    """

    def starred(edges: DataFrame) -> DataFrame:
        return common.save(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).distinct().mapInArrow(_stars, "a long, b long"), "edges")

    now = starred(edges.where("a <> b"))
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("upper")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("upper")))
        if ends.groupBy("node").agg(F.sum("upper").alias("links"), F.count("*").alias("n")).where("links > 0 AND n > 1").isEmpty():  # each node has one link, to one that has none
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = starred(small)
        common.drop_saved(now)
        now = after
