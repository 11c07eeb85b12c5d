"""Embedding near-dedup by sorted projection passes.

A pass hashes each vector to the signs of random projections, concatenated, and orders the vectors of each label by
them. Neighbours up to `window` ranks apart are compared by cosine in double precision; pairs that reach the threshold are
links, and links of all passes are united. Vectors of small angle share long prefixes in most passes, so a pair missed by one
pass is found by another; passes_for() gives the number of passes for the rows of the largest label and a wanted recall.

Nodes. Vectors of the same label and bytes are one node with a weight, so a third of all rows may be copies of one vector.
Windows hand on which nodes are connected, not each pair: a block of rows yields at most one row for each of its rows. After
the first passes the nodes found to be connected are contracted, and later passes look for links between components only.

Counts. n_links is counted inside the components: nodes whose angle to the component's first one is at most half the threshold's
angle are its core and linked to each other by the triangle inequality; all other pairs of a component are compared block by
block, dealt to many tasks, and come out as sums. No group's pairs are listed, and no group is gathered in one task.

The first rows of each range of a pass are compared with the end of the range before in a second, small step.

Defined cases: null vectors, zero vectors, and vectors with null or non-finite components, or under a null label, link with nothing; nor do
vectors of different lengths. Every row is returned. A null vec_id links with nothing. Rows that repeat a vec_id count as one vector (the
one whose label and then bytes sort first). Ties (a cosine of just the threshold) are links. Other columns, whatever their names, are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Scratch, map_batches, map_stream, whole_groups
from .graph import components, smallest_reached

#: Passes at least; passes_for() asks for more where a label has many rows.
PASSES, WINDOW, BITS, RECALL = 16, 64, 64, 0.99
#: Passes whose sorted copies of the vectors are on disk at a time.
TOGETHER = 4
#: Rows of a block in which all pairs of a component are compared, and of a tile of such a comparison.
BLOCK, TILE = 4096, 1024
SEED = 20_011


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair of just the threshold has met in a window with at least this probability.

    A bit agrees with probability 1 - angle / pi, and rows whose first log2(rows / window) bits agree share a window.
    """
    agree = (1 - math.acos(threshold) / math.pi) ** max(0.0, math.log2(max(1, rows) / window))
    return max(PASSES, math.ceil(math.log(1 - recall) / math.log(1 - agree))) if agree < 1 else PASSES


def _directions(dim: int, number: int, seed: int = SEED) -> np.ndarray:
    """BITS directions of a pass; the same wherever they are drawn."""
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of unit length; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def kind_of(vectors: DataFrame, vector_col: str) -> str:
    """How components are kept: as they come, in 4 or 8 bytes."""
    column = vectors.schema[vector_col].dataType
    return "<f4" if isinstance(column, ArrayType) and isinstance(column.elementType, FloatType) else "<f8"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, v (the components' bytes), of the vectors that can link; one row for each id."""
    kind = kind_of(vectors, vector_col)
    size = int(kind[-1])
    v = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v")).dropna()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(2)
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False).astype(kind)  # a null component becomes nan
        sums = [np.concatenate([[0], np.cumsum(x)])[offsets] for x in (~np.isfinite(flat), flat != 0)]
        ok = np.flatnonzero((np.diff(sums[0]) == 0) & (np.diff(sums[1]) > 0))
        data = flat.tobytes()
        packed = [data[a * size : b * size] for a, b in zip(offsets[ok].tolist(), offsets[ok + 1].tolist(), strict=True)]
        return pa.record_batch([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(packed, pa.binary())], names=["id", "label", "v"])

    rows = map_batches(rows, run, "id long, label string, v binary")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _keyed(nodes: DataFrame, passes: list[int], kind: str) -> DataFrame:
    """A row for each pass: number, key (dimension and signs), tie (a hash, so that equal keys stand in random order), id, part, label, v."""
    size = int(kind[-1])

    def run(batches):
        for batch in batches:
            vectors, ids = batch.column(3).to_pylist(), batch.column(0).to_numpy()
            dims = np.array([len(v) // size for v in vectors])
            by_dim = [(d, at, _units([vectors[k] for k in at], kind)) for d in np.unique(dims).tolist() for at in [np.flatnonzero(dims == d).tolist()]]
            for number in passes:
                keys = [b""] * len(vectors)
                for dim, at, x in by_dim:
                    signs = np.packbits(x @ _directions(dim, number) >= 0, axis=1)
                    for k, s in zip(at, signs, strict=True):
                        keys[k] = dim.to_bytes(4, "big") + s.tobytes()
                tie = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(number * 0x1000193)) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.record_batch([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys, pa.binary()), pa.array(tie.view(np.int64)), *batch.columns], names=["number", "key", "tie", "id", "part", "label", "v"])

    return map_stream(nodes.select("id", "part", "label", "v"), run, "number int, key binary, tie long, id long, part long, label string, v binary")


def _stars(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that connect the parts that links (i, j) between rows connect: one row at most for each part."""
    i, j = i[part[i] != part[j]], j[part[i] != part[j]]
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, at = np.unique(np.concatenate([part[i], part[j]]), return_inverse=True)
    low = smallest_reached(at[: len(i)], at[len(i) :], len(parts))
    moved = np.flatnonzero(low != np.arange(len(parts)))
    return parts[moved], parts[low[moved]]


def _near(part: np.ndarray, x: np.ndarray, window: int, least: float, new: int) -> tuple[np.ndarray, np.ndarray]:
    """Connections by pairs at most window rows apart with cosine >= least; the later row is at or after `new`."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 256
    for start in range(new, len(part), step):
        stop = min(len(part), start + step)
        low = max(0, start - window)
        i, j = np.nonzero(x[start:stop] @ x[low:stop].T >= least)
        i, j = i + start, j + low
        near = (j < i) & (i - j <= window)
        some = _stars(part, i[near], j[near])
        a.append(some[0])
        b.append(some[1])
    return np.concatenate(a), np.concatenate(b)


def _compare(ordered: DataFrame, window: int, least: float, kind: str) -> DataFrame:
    """Of sorted ranges: connections (range -1, a, b), and their first and last rows (range, place: rank from the start, or -1 - rank from the end)."""
    size = int(kind[-1])

    def run(batches):
        own_range, done = TaskContext.get().partitionId(), 0
        held: tuple | None = None  # the last `window` rows of the current (number, label, dimension)
        tail: list[tuple] = []
        for batch in batches:
            number, part, label, vectors = (batch.column(k).to_pylist() for k in ("number", "part", "label", "v"))
            groups = [f"{n}/{len(v) // size}/{x}" for n, x, v in zip(number, label, vectors, strict=True)]
            edges = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                parts, rows, new = np.array(part[low:high], np.int64), _units(vectors[low:high], kind), 0
                if held and held[0] == groups[low]:
                    new = len(held[1])
                    parts, rows = np.concatenate([held[1], parts]), np.vstack([held[2], rows])
                a, b = _near(parts, rows, window, least, new)
                if len(a):
                    yield _rows([-1] * len(a), [0] * len(a), a, b, None)
                held = (groups[low], parts[-window:], rows[-window:])
            rows = list(zip(part, groups, vectors, strict=True))
            if done < window and rows:
                head = rows[: window - done]
                yield _rows([own_range] * len(head), range(done, done + len(head)), [r[0] for r in head], [r[0] for r in head], head)
            done += len(rows)
            tail = [*tail, *rows[-window:]][-window:]
        if tail:
            n = len(tail)
            yield _rows([own_range] * n, range(-n, 0), [t[0] for t in tail], [t[0] for t in tail], tail)

    return map_stream(ordered.select("number", "part", "label", "v"), run, "range int, place int, a long, b long, label string, v binary")


def _rows(own_range, place, a, b, rest: list[tuple] | None) -> pa.RecordBatch:
    n = len(own_range)
    labels = pa.nulls(n, pa.string()) if rest is None else pa.array([r[1] for r in rest], pa.string())
    vectors = pa.nulls(n, pa.binary()) if rest is None else pa.array([r[2] for r in rest], pa.binary())
    return pa.record_batch(
        [pa.array(np.asarray(own_range, np.int32)), pa.array(np.asarray(place, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), labels, vectors],
        names=["range", "place", "a", "b", "label", "v"],
    )


def _seams(edges: DataFrame, ranges: list[int], window: int, least: float, kind: str) -> DataFrame:
    """Connections across two neighbouring ranges: 2 * window rows a seam."""
    before = dict(zip(ranges[1:], ranges, strict=False))
    follows = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    seam = F.when(F.col("place") < 0, F.col("range")).otherwise(F.try_element_at(follows, F.col("range"))) if before else F.lit(None).cast("int")
    rows = edges.withColumn("seam", seam).filter("seam is not null").drop("range")

    def pairs(group):
        import pandas as pd

        ends = group[group["place"] < 0].sort_values("place")
        starts = group[group["place"] >= 0].sort_values("place")
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for label in sorted(set(ends["label"]) & set(starts["label"])):
            x, y = ends[ends["label"] == label], starts[starts["label"] == label]
            cosine = _units(y["v"].to_list(), kind) @ _units(x["v"].to_list(), kind).T
            ranks = y["place"].to_numpy()[:, None] - x["place"].to_numpy()[None, :]
            i, j = np.nonzero((cosine >= least) & (ranks <= window))
            some = _stars(np.concatenate([y["a"].to_numpy(), x["a"].to_numpy()]), i, j + len(y))
            a.append(some[0])
            b.append(some[1])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.groupBy("seam").applyInPandas(pairs, "a long, b long")


def connections(nodes: DataFrame, kind: str, threshold: float, passes: list[int], window: int, scratch: Scratch) -> DataFrame:
    """(a, b), a < b, distinct: parts of nodes (id, part, label, v) that verified pairs of these passes connect."""
    # a range must hold several windows, or neighbours would stand more than one range apart
    ranges = max(1, min(int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TOGETHER // (8 * window)))
    found = None
    for first in range(0, len(passes), TOGETHER):
        keyed = scratch.keep(_keyed(nodes, passes[first : first + TOGETHER], kind), "keyed")
        order = ["number", "label", "key", "tie"]
        out = scratch.keep(_compare(keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order), window, threshold, kind), "compared")
        scratch.drop(keyed)
        edges = out.filter("range >= 0").select("range", "place", "a", "label", "v")
        numbers = sorted(r[0] for r in edges.select("range").distinct().collect())  # one number for each range
        pairs = out.filter("range < 0").select("a", "b").unionAll(_seams(edges, numbers, window, threshold, kind))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = scratch.keep((pairs if found is None else found.unionAll(pairs)).distinct(), "pairs")
        scratch.drop(out, *([found] if found is not None else []))
        found = more
    return found


def _outside(members: DataFrame, sizes: DataFrame, least: float, kind: str) -> DataFrame:
    """id, n_out: vectors linked by a pair with at least one end outside the core, over all pairs of a component, block by block."""
    total = members.groupBy("component").agg(F.count(F.when(~F.col("core"), 1)).alias("n_other")).filter("n_other > 0").join(sizes, "component")
    others, cores = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_other", "n_core"))
    # blocks of others come first; each meets every block, a block of the core only those of others
    block = F.when(F.col("core"), others + F.pmod(F.xxhash64("id"), cores)).otherwise(F.pmod(F.xxhash64("id"), others)).cast("int")
    last = F.when(F.col("core"), others).otherwise(others + cores) - 1
    rows = members.join(total, "component").withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("component", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "weight", "v")
    rows = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")

    def run(batches):
        for batch, at in whole_groups(batches, ("component", "lo", "hi")):
            lo, hi, mine, ids, weight = (batch.column(k).to_numpy() for k in ("lo", "hi", "mine", "id", "weight"))
            vectors, n = batch.column("v").to_pylist(), np.zeros(len(batch), np.int64)
            for s, e in zip(at, at[1:], strict=False):
                x = _units(vectors[s:e], kind)
                i, j = (np.flatnonzero(mine[s:e] == side[s]) for side in (lo, hi))
                for tile in (i[k : k + TILE] for k in range(0, len(i), TILE)):
                    near = x[tile] @ x[j].T >= least
                    if lo[s] == hi[s]:
                        near &= tile[:, None] != j
                    else:
                        n[s + j] += weight[s + tile] @ near
                    n[s + tile] += near @ weight[s + j]
            yield pa.record_batch([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["id", "n"])

    return map_stream(rows, run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_out"))


def _cores(members: DataFrame, half: float, kind: str) -> DataFrame:
    """Members (id, component, weight, v, first) with core instead of first: whether they are within this cosine of first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, first = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        core = np.zeros(len(own), bool)
        sizes = np.array([len(v) for v in own])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size).tolist()
            core[at] = (_units([own[k] for k in at], kind) * _units([first[k] for k in at], kind)).sum(1) >= half
        return pa.record_batch([*batch.columns[:4], pa.array(core)], names=[*batch.schema.names[:4], "core"])

    return map_batches(members, run, "id long, component long, weight long, v binary, core boolean")


def near_dedup(vectors: DataFrame, threshold: float = 0.93, passes: int | None = None, window: int = WINDOW, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors. passes: as many as passes_for() says, if not given."""
    scratch, kind = Scratch(vectors.sparkSession, "embedding"), kind_of(vectors, vector_col)
    rows = scratch.keep(valid(vectors, id_col, vector_col, label_col), "valid")
    nodes = scratch.keep(rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).withColumn("part", F.col("id")), "nodes")
    if passes is None:
        largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        passes = passes_for(largest, threshold, window)
    numbers = list(range(passes))
    # links between components come after links inside them: what the first passes have joined is contracted
    some = connections(nodes, kind, threshold, numbers[:TOGETHER], window, scratch)
    early = components(some)
    parts = nodes.join(early, nodes["id"] == early["node"], "left").select("id", F.coalesce("component", "id").alias("part"), "label", "v")
    parts = scratch.keep(parts, "parts")
    classes = components(some.unionAll(connections(parts, kind, threshold, numbers[TOGETHER:], window, scratch))) if numbers[TOGETHER:] else early
    # the core of each component: within half the threshold's angle of its first vector (a little less, for rounding)
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    members = nodes.join(classes, nodes["id"] == classes["node"]).select("id", "component", "weight", "v")
    first = nodes.join(classes.select("component").distinct(), nodes["id"] == F.col("component"), "left_semi").select(F.col("id").alias("component"), F.col("v").alias("first"))
    members = scratch.keep(_cores(members.join(first, "component").select("id", "component", "weight", "v", "first"), half, kind), "members")
    sizes = members.filter("core").groupBy("component").agg(F.count(F.lit(1)).alias("n_core"), F.sum("weight").alias("in_core"))
    outside = _outside(members, sizes, threshold, kind)
    counted = members.join(sizes, "component", "left").join(outside, "id", "left")
    n = F.coalesce("n_out", F.lit(0)) + F.when(F.col("core"), F.col("in_core")).otherwise(F.col("weight")) - 1
    counted = scratch.keep(counted.select("id", n.cast("long").alias("n"), "component"), "counted")
    # a node that links with no other has its own copies
    counted = nodes.join(counted, "id", "left").select("label", "v", F.coalesce("n", F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    result = scratch.keep(rows.join(counted, ["label", "v"]).select(F.col("id").alias("__id"), "n_links", "component_id"), "result")
    scratch.only(result)
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    out = every.join(result, every["vec_id"] == result["__id"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
