"""Quality by compression: zstandard dictionaries of good and of bad texts.

Two dictionaries are trained on blocks of a bounded sample of labelled rows (FIT_ROWS of either class, BLOCKS blocks of
BLOCK bytes of each, drawn evenly over the text). A text is cut into blocks, each compressed with both dictionaries and with none. Its features are
the normalised difference (good - bad) / (good + bad) of the compressed sizes, and the plain ratio of compression, which
tells repetition apart from prose; a logistic curve fitted on rows that are in no dictionary makes them a score.

Defined cases: null and empty texts have difference 0 and ratio 1, and the score of that. Without labelled rows of both
classes the score is the share of label 1 (0.5 if there are none). Repeated rows get the same score, ties (a score of just the
threshold) are predicted 1. Texts are scored whole. A null doc_id is not held out and has no label. Other columns, whatever their
names, are not read; with keep they are passed on. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_batches, map_stream
from .learning import class_weights, held_out, labelled_sample, logistic, lowest_share, probability

FIT_ROWS = 20_000
BLOCK, BLOCKS, TRAIN_BLOCKS = 2048, 8, 4000
DICTIONARY_BYTES, LEVEL = 65_536, 3


def blocks(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Compressors:
    def __init__(self, dictionaries: tuple[bytes, bytes] | None):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**plain).compress
        self.by_class = []
        for data in dictionaries or ():
            made = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT)
            made.precompute_compress(level=LEVEL)
            self.by_class.append(zstandard.ZstdCompressor(dict_data=made, **plain).compress)

    def features(self, text: str) -> tuple[float, float]:
        bad = good = plain = n = 0
        for block in blocks(text):
            bad += len(self.by_class[0](block))
            good += len(self.by_class[1](block))
            plain += len(self.plain(block))
            n += len(block)
        return ((good - bad) / (good + bad), plain / n) if n else (0.0, 1.0)


def _train(sample: DataFrame, y: int) -> bytes | None:
    """A dictionary from at most TRAIN_BLOCKS blocks, evenly chosen by hash; the same for any order of tasks."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column(0).to_pylist():
            own = blocks(text)
            out += own[:: max(1, -(-len(own) // BLOCKS))]
        return pa.record_batch([pa.array(out, pa.binary())], names=["block"])

    rows = map_batches(sample.filter((F.col("y") == y) & ~F.col("calibrates")).select("text"), cut, "block binary").distinct()
    rows = Scratch(sample.sparkSession, "quality").keep(rows, "blocks")
    rows = lowest_share(rows, "block", TRAIN_BLOCKS, rows.count())
    data = [bytes(r[0]) for r in rows.orderBy(F.xxhash64("block", F.lit(11)), "block").limit(TRAIN_BLOCKS).collect()]
    if not data:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, data).as_bytes()
    except zstandard.ZstdError:  # too few blocks for the trainer: their bytes serve as they are
        return b"".join(data)[-DICTIONARY_BYTES:]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS):
    """Dictionaries of class 0 and 1, and the weights of the score; without both classes none and a constant."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample, counts = labelled_sample(docs, labels, label, fit_rows)
    total = sum(counts.values())
    constant = counts.get(1, 0) / total if total else 0.5
    nothing = None, np.array([np.log(max(constant, 1e-9)) - np.log(max(1 - constant, 1e-9)), 0.0, 0.0])
    if not (counts.get(0) and counts.get(1)):
        return nothing
    sample = scratch.keep(sample, "sample")
    dictionaries = (_train(sample, 0), _train(sample, 1))
    if None in dictionaries:
        return nothing
    shared = scratch.spark.sparkContext.broadcast(dictionaries)

    def measure(batches):
        compressors = Compressors(shared.value)
        for batch in batches:
            x = np.array([compressors.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 2)
            yield pa.record_batch([batch.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "x0", "x1"])

    held = map_stream(sample.filter("calibrates").select("text", "y"), measure, "y int, x0 double, x1 double").toPandas()
    held = held.sort_values(list(held.columns))
    y = held["y"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return nothing
    return dictionaries, logistic(held[["x0", "x1"]].to_numpy(), y, class_weights(y, counts))


def score(docs: DataFrame, learned, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document; with keep, the columns of docs and the score in a new column of that name."""
    dictionaries, w = learned
    shared = Scratch(docs.sparkSession, "quality").spark.sparkContext.broadcast((dictionaries, w))
    text, out = F.coalesce(text_col, F.lit("")).alias(fresh("score_text", docs)), keep or "score"
    if keep:
        if keep.lower() in (c.lower() for c in docs.columns):
            raise ValueError(f"docs has a column {keep}")
        rows = docs.select(text, *docs.columns)
        schema = docs.withColumn(keep, F.lit(0.0)).schema
    else:
        rows = docs.select(text, F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
        schema = "doc_id long, held_out boolean, score double"

    def run(batches):
        dictionaries, w = shared.value
        compressors = Compressors(dictionaries)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = np.array([compressors.features(t) for t in texts]).reshape(-1, 2) if dictionaries else np.zeros((len(texts), 2))
            p = probability(w[0] + x @ w[1:])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p)], names=[*batch.schema.names[1:], out])

    scored = map_stream(rows, run, schema)
    return scored if keep else scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
