"""What the trained operators share: the rows they may learn from, samples, partial counts and a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_stream

#: Rows whose remainder is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 3, 1

#: Most ids that are broadcast where all labelled rows are read.
IDS = 1_000_000


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id) == HELD_OUT


def calibrates(doc_id: Column) -> Column:
    """A quarter of the rows to learn from: it fits no model, only the score and the choice among settings."""
    return F.floor(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) / FOLDS) % 4 == 0


def lowest_share(rows: DataFrame, key: str, wanted: int, there: int, seed: int = 11) -> DataFrame:
    """Rows of low hash, more than `wanted` of `there` (all, if there are few): what a top-k by the same hash must look at."""
    if there <= 2 * wanted:
        return rows
    cut = int((2 * wanted / there) * (1 << 63)) * 2 - (1 << 63)
    return rows.filter(F.xxhash64(key, F.lit(seed)) < cut)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int | None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> tuple[DataFrame, dict[int, int]]:
    """(text, y, calibrates) of labelled rows, and how many rows each class has.

    With per_class None these are all labelled rows that may be learned from; their ids are broadcast if they are IDS at most, else
    rows are shuffled by id. Otherwise they are at most per_class of either class, those
    of smallest hash, whose ids (at most 2 * per_class) are broadcast. Ids that repeat with different labels count as 1; rows with
    a null label or id are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("__y")).dropna()
    known = known.filter(F.col("__y").isin(0, 1) & ~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = {int(y): int(n) for y, n in known.groupBy("__y").count().collect()}
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(~held_out(F.col("__id")))
    if per_class is not None:
        chosen = None
        for y in (0, 1):
            some = lowest_share(known.filter(F.col("__y") == y), "__id", per_class, counts.get(y, 0), seed).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(per_class)
            chosen = some if chosen is None else chosen.unionAll(some)
        known = chosen
    if per_class is not None or sum(counts.values()) <= IDS:
        known = F.broadcast(known)
    rows = rows.join(known, "__id").select("text", F.col("__y").alias("y"), calibrates(F.col("__id")).alias("calibrates"))
    return rows, counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of 1 and each (scaled) column, by Newton steps; folded back to unscaled columns. A row may stand for several (times)."""
    if times is None:
        scale = x.std(axis=0) + 1e-9
    else:
        weight, scale = weight * times, np.sqrt(np.average((x - np.average(x, axis=0, weights=times)) ** 2, axis=0, weights=times)) + 1e-9
    mean = np.average(x, axis=0, weights=weight)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(60):
        p = probability(a @ w)
        step = np.linalg.solve((a.T * (weight * p * (1 - p) + 1e-9)) @ a + penalty, a.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    out = w / np.concatenate([[1.0], scale])
    out[0] = w[0] - (w[1:] * mean / scale).sum()
    return out


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def class_weights(y: np.ndarray, counts: dict[int, int], times: np.ndarray | None = None) -> np.ndarray:
    """Weights under which the sample has the classes in their shares of all labelled rows. A row may stand for several (times)."""
    times = np.ones(len(y)) if times is None else times
    n1, n = max(1, int(times[y == 1].sum())), max(1, int(times.sum()))
    total = max(1, sum(counts.values()))
    share = counts.get(1, 0) / total
    w = np.where(y == 1, share * n / n1, (1 - share) * n / max(1, n - n1))
    return w


def summed(rows: DataFrame, key: str) -> DataFrame:
    """(key, slice, cells) with cells a sparse vector (int32 places, int64 counts): one row for each key and slice, added up.

    Rows are dealt by key and slice and added as they stream by, so a task holds its sums, never its input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, dict] = {}
        for batch in batches:
            for k, s, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, n = unpack(cells)
                have = sums.get((k, s))
                if have is None:
                    sums[k, s] = (place, n)
                else:
                    both, at = np.unique(np.concatenate([have[0], place]), return_inverse=True)
                    sums[k, s] = (both, np.bincount(at, np.concatenate([have[1], n])).astype(np.int64))
        if sums:
            yield pa.record_batch([pa.array([k for k, _ in sums], pa.string()), pa.array([s for _, s in sums], pa.int32()), pa.array([pack(*v) for v in sums.values()], pa.binary())], names=[key, "slice", "cells"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_stream(rows.repartition(n, key, "slice"), add, f"{key} string, slice int, cells binary")


def pack(place: np.ndarray, n: np.ndarray) -> bytes:
    return place.astype("<i4").tobytes() + n.astype("<i8").tobytes()


def unpack(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = len(cells) // 12
    return np.frombuffer(cells, "<i4", k), np.frombuffer(cells, "<i8", k, 4 * k)
