"""Connected components of a link table, by contraction.

Each round every node points to its smallest neighbour, pointers are followed once more, and the links are rewritten
between the targets; nodes without links to others are done. A round at least halves the nodes of each component, so
rounds grow with the logarithm of the largest. Every round's tables are written to the shared folder, so a lost executor
repeats one round at most; nothing but row counts reaches the driver. Minima are taken per task before the shuffle, and joins are
to a side that is unique by key, so a node with a third of all links is split by Spark's skew handling. Once at most FEW links are
left, one task finishes them: 4 MB, however many links there were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_stream

FEW = 1 << 18


def smallest_reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 and links (i, j): the smallest node of each one's component."""
    low = np.arange(n)
    while True:
        x, y = low[i], low[j]
        differ = x != y
        if not differ.any():
            return low
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # only roots are moved, each to a smaller one
        while not (low[low] == low).all():
            low = low[low]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, component) of at most FEW links."""

    def run(batches):
        ends = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
        a, b = np.concatenate(ends, axis=1)
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        low = smallest_reached(at[: len(a)], at[len(a) :], len(nodes))
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[low])], names=["node", "component"])

    return map_stream(edges.select("a", "b").coalesce(1), run, "node long, component long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of each node in links; component is the smallest node reached. Null ends and loops are ignored."""
    scratch = Scratch(links.sparkSession, "components")
    edges = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct()
    edges = scratch.keep(edges, "links")
    result = None
    while edges.count() > FEW:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("low")), F.struct(F.col("b").alias("node"), F.col("a").alias("low")))).alias("x")).select("x.*")
        lowest = scratch.keep(ends.groupBy("node").agg(F.min("low").alias("low")), "lowest")
        ahead = lowest.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        to = scratch.keep(lowest.join(ahead, "low").select("node", F.col("lower").alias("low")), "pointers")
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("low").alias("to_a")), "a").select("to_a", "b")
        moved = moved.join(to.select(F.col("node").alias("b"), F.col("low").alias("to_b")), "b").filter("to_a != to_b")
        fewer = scratch.keep(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        result = _followed(result, to, scratch)
        scratch.only(fewer, result)
        edges = fewer
    last = _in_one_task(edges).select("node", F.col("component").alias("low"))
    result = _followed(result, last, scratch)
    scratch.only(result)
    return result


def _followed(result: DataFrame | None, to: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after another step of pointers (node, low)."""
    if result is None:
        return scratch.keep(to.select("node", F.col("low").alias("component")), "found")
    step = to.select(F.col("node").alias("component"), F.col("low").alias("next"))
    return scratch.keep(result.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "found")
