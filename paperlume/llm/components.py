"""Connected components of an undirected graph, by union-find or by alternating stars.

Up to ``ONE_TASK`` edges, some tens of MB, are joined in one task by union-find. Of more, every
round joins the edges with the least neighbour of each end and is written to the checkpoint folder, so
lineage stays short. Minima are pre-aggregated before they are shuffled, and the join
with them has one row per node on one side, so a node with very many edges can be split.

Edge cases: no edges give no rows; loops, repeated edges and null ends are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import scratch, written

ONE_TASK = 500_000


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every end of the edges (a, b); the component is its least node."""
    ends = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    with scratch(edges.sparkSession):
        edges = written(ends.distinct())
        state = _state(edges)
        if state[0] <= one_task:
            return written(edges.coalesce(1).mapInArrow(_union_find, "node long, component long"), keep=True)
        while True:
            with scratch(edges.sparkSession):
                edges = written(_small_star(written(_large_star(edges))), keep=True)
            now = _state(edges)
            if now == state:
                break
            state = now
        members = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
        heads = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
        return written(members.unionByName(heads), keep=True)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels of all ends of the edges of one partition: minima are passed along edges and shortened."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if len(b)]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
