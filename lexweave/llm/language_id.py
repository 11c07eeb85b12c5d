"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every character that is no letter counts as a space. The n-grams of 1 to 3 characters with at
least one letter are hashed to BUCKETS places. Counts of each language are added up per task and then by slices of the
table, so what reaches the driver is a fixed number of places for each language. The matrix of log-probabilities
(languages x BUCKETS floats) is broadcast; a batch of texts is scored by looking up its n-grams and adding by document.

Learned languages are the values of lang in rows that may be learned from (see learning.py), however many. Counts use every such
row. The matrix is broadcast in parts of at most TOGETHER languages (105 MB), one after the other; with more languages than that, each
part is a pass over the texts, which carry their best language and the sum of all likelihoods from pass to pass.

Defined cases: lang_pred is `und`, with score 0, for a null text, a text without a letter, or if no language was learned.
Ties go to the language first in code point order. Texts are read whole; rows that repeat get the same result. A null doc_id is not held
out, and its row is learned from. Other columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, built, by_size, map_batches, map_stream
from .learning import held_out, pack, summed, unpack

ORDERS, BITS, SLICES = (1, 2, 3), 16, 16
BUCKETS = 1 << BITS
#: Languages of a part of the matrix, and of which a task holds counts at a time.
TOGETHER, HELD = 400, 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each n-gram, in no special order of n-grams but by document for each order."""
    letters = built(("letters",), _letters)
    joined = "  ".join(["", *(lower := [t.lower() for t in texts]), ""])  # two spaces on either side of each
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) + 2 for t in lower])
    doc = np.concatenate([np.zeros(2, np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), sizes)])
    is_letter = letters[codes]
    symbol = np.where(is_letter, codes, 32).astype(np.uint64)
    buckets, docs = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h, any_letter = np.full(m, n, np.uint64) * _ODD[2], np.zeros(m, bool)
        for k in range(n):
            h = (h ^ symbol[k : k + m]) * _ODD[k % 2]
            h ^= h >> np.uint64(29)
            any_letter |= is_letter[k : k + m]
        last = n - 1 if n > 1 else 0  # an n-gram over the gap between documents has letters of one of them only
        owner = np.where(is_letter[:m], doc[:m], doc[last : last + m])
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int32)[any_letter])
        docs.append(owner[any_letter])
    return (np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int32))


class Model:
    """Counts of all languages, in the shared folder, and the languages in code point order with the rows of each."""

    def __init__(self, table: DataFrame, langs: list[str], rows: list[int]):
        self.table, self.langs, self.rows = table, langs, rows

    def parts(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Languages and their log-probabilities: float32, languages x (BUCKETS + 1); the last column is the prior."""
        total = sum(self.rows)
        for low in range(0, len(self.langs), TOGETHER):
            langs, rows = self.langs[low : low + TOGETHER], np.array(self.rows[low : low + TOGETHER], np.float64)
            counts, at = np.zeros((len(langs), BUCKETS)), {lang: k for k, lang in enumerate(langs)}
            some = self.table if len(langs) == len(self.langs) else self.table.filter(F.col("lang").between(langs[0], langs[-1]))
            for lang, part, cells in some.toLocalIterator():
                place, n = unpack(cells)
                counts[at[lang], part * (BUCKETS // SLICES) + place] += n
            logs = np.log(counts + 0.5) - np.log(counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
            prior = np.log(rows + 1) - np.log(total + len(self.langs))
            yield langs, np.hstack([logs, prior[:, None]]).astype(np.float32)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    scratch = Scratch(docs.sparkSession, "language")
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))

    def cells(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        lang, part, packed = [], [], []
        for name, table in counts.items():
            for k, some in enumerate(np.split(table, SLICES)):
                found = np.flatnonzero(some)
                lang.append(name)
                part.append(k)
                packed.append(pack(found, some[found]))
        return pa.record_batch([pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(packed, pa.binary())], names=["lang", "slice", "cells"])

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                if lang not in counts and len(counts) >= HELD:
                    yield cells(counts)
                    counts = {}
                table = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for some in by_size(own, 1 << 18):
                    table += np.bincount(ngrams(some)[0], minlength=BUCKETS)
        yield cells(counts)

    table = scratch.keep(summed(map_stream(rows, count, "lang string, slice int, cells binary"), "lang"), "counts")
    found = sorted(map(tuple, rows.groupBy("lang").count().collect()))  # a name and a number for each language
    return Model(table, [lang for lang, _ in found], [n for _, n in found])


def likelihoods(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each text under each language, whether it has any n-gram)."""
    like, known = [np.zeros((0, len(logs)))], [np.zeros(0, bool)]
    for some in by_size(texts, 1 << 18):
        bucket, doc = ngrams(some)
        like.append(np.stack([np.bincount(doc, row[bucket].astype(np.float64), minlength=len(some)) + row[-1] for row in logs], 1))
        known.append(np.bincount(doc, minlength=len(some)) > 0)
    return np.concatenate(like), np.concatenate(known)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    scratch = Scratch(docs.sparkSession, "language")
    nothing = F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("*", F.lit("und").alias("lang"), nothing.alias("best"), nothing.alias("log_sum"))
    schema = "doc_id long, held_out boolean, text string, lang string, best double, log_sum double"
    more = len(model.langs) > TOGETHER
    for part in model.parts():
        shared = scratch.spark.sparkContext.broadcast(part)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            langs, logs = shared.value
            like, known = likelihoods(batch.column(2).to_pylist(), logs)
            names, best, log_sum = batch.column(3).to_pylist(), *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (4, 5))
            best, log_sum = (np.where(np.isnan(x), -np.inf, x) for x in (best, log_sum))
            top = like.argmax(1) if len(like) else np.zeros(0, int)
            highest = like[np.arange(len(like)), top]
            both = np.logaddexp(log_sum, highest + np.log(np.exp(like - highest[:, None]).sum(1)))
            better = known & (highest > best)
            names = [langs[k] if b else name for k, b, name in zip(top, better, names, strict=True)]
            values = [pa.array(x, pa.float64(), mask=~known) for x in (np.maximum(best, highest), both)]
            texts = batch.column(2) if more else pa.nulls(len(names), pa.string())
            return pa.record_batch([batch.column(0), batch.column(1), texts, pa.array(names, pa.string()), *values], names=[*batch.schema.names])

        rows = map_batches(rows, run, schema)
        rows = scratch.keep(rows, "part") if more else rows
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("log_sum"))))
    return rows.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), score.alias("score"))
