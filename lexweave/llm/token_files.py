"""Token-ID output: Parquet files with a list column of ids, in ascending doc_id order, and their reader.

Encoding. Nothing in the tokenizer crosses white space (it splits on it and drops it), so a text's ids are those of its
white-space separated words, one after the other; a worker remembers the ids of words (see lexicon.py), and the library encodes the rest.

Files. Rows are dealt by ranges of doc_id and sorted, one file for each range: `part` (the range), `start` (ids of the
rows before it in its part), n_tokens, ids. The integers of metadata columns are delta encoded, ids dictionary encoded
(at most a vocabulary of entries a row group); row groups and pages have set sizes and page indexes, so reading
metadata, or some documents' ids, leaves other pages unread. A row's place in the whole output is the sum of the parts before it
(a few numbers, one for each file) and its start.

Defined cases: a null text is empty and has the end id only. Rows that repeat a doc_id stand in the order of their text's
hash. A null doc_id comes first. An empty table writes files without rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, built, by_size, map_batches, map_stream, read_local
from .lexicon import Lexicon, per_text

ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10

#: Format v2 has the delta encodings; a dictionary of ids stays far below its page size.
FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}


class WordIds:
    """Ids of texts.

    The vocabulary is lower case, so ASCII letters are lower-cased before words are looked up, and marks after
    letters are a match of their own: both spare encoding variants of one word. A special string is found before
    lower-casing, so texts that may hold one are left as they are. New words of letters of Latin-1 go to the library
    as one text, without the normalisation and splitting that they don't need; each ends with the one token that ends a word.
    """

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        lean = json.loads(vocabulary)
        lean |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}
        self.lean = Tokenizer.from_str(json.dumps(lean))
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(1 + max(vocab.values()), bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.lower = self._ids("Word") == self._ids("word")
        self.tails: dict[bytes, bytes] = {}
        self.lexicon = Lexicon(self.make)

    def _ids(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def make(self, words: list[bytes]) -> list[bytes]:
        stems, tails, rest = [], [], []  # lower-case letters and the marks after them; words of another kind
        for word in words:
            if word.isalpha() and self.lower:
                stems.append(word if word.islower() else word.lower())
                tails.append(b"")
                continue
            stem = word.rstrip(_MARKS)
            if self.lower and (letters := stem if stem.isalpha() else _latin(stem)):
                tails.append(word[len(stem) :])
                stems.append(letters.lower())
            else:
                stems.append(None)
                tails.append(word)
                rest.append(word.decode("utf-8", "replace"))
        table = dict.fromkeys(stems)
        table.pop(None, None)
        table = dict(zip(table, self._letters(list(table)), strict=True))
        others = (array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        return [next(others) if stem is None else table[stem] + self._tail(tail) if tail else table[stem] for stem, tail in zip(stems, tails, strict=True)]

    def _tail(self, marks: bytes) -> bytes:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails.clear()
            ids = self.tails[marks] = self._ids(marks.decode("ascii"))
        return ids

    def _letters(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        text = b" ".join(words).decode("latin-1").translate(_BYTE_CHARS)
        ids = np.asarray(self.lean.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(words):
            return [self._ids(w.decode("utf-8")) for w in words]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[str], end_id: int | None = None) -> pa.ListArray:
        """Ids of each text, with end_id after them."""
        sizes, chunks = [], []
        for some in by_size(texts, CHUNK):
            data = [t.encode("utf-8", "replace") for t in some]
            data = [d if not self.lower or b"<|" in d else d.lower() for d in data]
            buffer = b"\n".join(data) + b"\n"
            gap = _GAP[np.frombuffer(buffer, np.uint8)]
            edge = np.flatnonzero(np.diff(gap, prepend=True))  # a word starts, a word ends, ...
            starts, ends = edge[::2], edge[1::2]
            values, lengths = self.lexicon.look_up(buffer, starts, ends)
            chunks.append(values)
            sizes.append(per_text(lengths, starts, np.cumsum([len(d) + 1 for d in data])))
        return lists(np.concatenate([np.zeros(0, np.int32), *chunks]), np.concatenate([np.zeros(0, np.int64), *sizes]), end_id)


#: Marks that are neither letters, numbers nor white space.
_MARKS = string.punctuation.encode()


def _latin(stem: bytes) -> bytes | None:
    """A word of letters of Latin-1 only, in lower case."""
    try:
        text = stem.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not text.isalpha() or max(text) >= "\u0100":
        return None
    text = text.lower()
    return None if max(text) >= "\u0100" else text.encode()


#: Bytes that end a word here; other white space, also of Unicode, is left to the library.
_GAP = np.isin(np.arange(256), [9, 10, 32])
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)} | {b: b for b in _PRINTABLE} | {32: 32}
CHUNK = 1 << 20


def lists(values: np.ndarray, sizes: np.ndarray, end_id: int | None = None) -> pa.ListArray:
    """A list<int32> column; end_id, if given, closes each list."""
    if end_id is not None:
        values = np.insert(values, np.cumsum(sizes), end_id)
        sizes = sizes + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts of docs and write them, in ascending doc_id order, under path."""
    spark = Scratch(docs.sparkSession, "token-files").spark
    shared = spark.sparkContext.broadcast(read_local(vocabulary_path))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encode(batches):
        words = _words(shared)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = words.encode(batch.column(1).to_pylist(), end_id)
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(sizes), ids],
                names=["doc_id", "part", "start", "n_tokens", "ids"],
            )

    map_stream(rows, encode, "doc_id long, part int, start long, n_tokens long, ids array<int>").write.options(**FORMAT).parquet(path)


def _words(shared) -> WordIds:
    data = shared.value
    return built(("words", len(data), zlib.crc32(data)), lambda: WordIds(data))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (in the whole output), n_tokens, ids. Select what is needed: only those columns are read."""
    rows = spark.read.parquet(path)
    parts = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each file
    before, offsets = 0, []
    for part, n in parts:
        offsets.append((part, before))
        before += n
    table = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return rows.join(table, "part", "left").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (as counted in the ids read), ids_crc32."""

    def crc(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        offsets = ids.offsets.to_numpy()
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4").view(np.uint8)
        sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("doc_id", "start", "ids"), crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
