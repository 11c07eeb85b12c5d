"""Token counts under a SentencePiece BPE vocabulary, by the whole-token shortcut.

The proof, made once on the driver (`proven`): (1) no piece has a space mark after another character, so no merge
crosses the start of a run of spaces, and a text's count is the sum over its pre-tokens (a run of spaces with the word
after it); (2) the model file itself says that it merges pairs and that its normalisation is the identity, with no table of
characters, but for the mark that is put before the text and stands for spaces; (3) a vocabulary string is a whole
token if the library encodes it, alone, as exactly one id. Executors count pre-tokens that are whole tokens as 1 and
merge only the rest, each distinct one once for as long as it is remembered (see lexicon.py).

Defined cases: a null or empty text has 0 bytes and 0 tokens. Special strings in a text are ordinary text, as the library
takes them. Texts of any length are read whole. Rows that repeat are counted each; other columns are not read, whatever
their names. A null doc_id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, built, by_size, map_batches, read_local
from .lexicon import Lexicon, per_text

MARK = "▁"


def fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol-buffer message: an integer, or bytes."""
    out, at = {}, 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = message[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            out[tag >> 3] = varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            out[tag >> 3] = message[at : at + size]
            at += size
    return out


# Numbers of fields in the published schema of model files.
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, SUFFIX = 3, 24
CHARS_MAP, DUMMY_PREFIX, DROP_SPACES, ESCAPE, RULES = 2, 3, 4, 5, 6
BPE = 2


def proven(model: bytes) -> list[str]:
    """The strings (without their leading mark) that encode alone as one token; raises if the shortcut does not hold."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans a word boundary: pre-tokens can't be counted apart")
    spec = fields(model)
    trainer, normal = fields(spec[TRAINER]), fields(spec[NORMALIZER])
    if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SUFFIX, 0):
        raise ValueError("the model does not merge pairs after a leading mark: pre-tokens can't be counted apart")
    if normal.get(CHARS_MAP) or normal.get(RULES) or normal.get(DROP_SPACES, 1) or not normal.get(DUMMY_PREFIX, 1) or not normal.get(ESCAPE, 1) or sp.encode(""):
        raise ValueError("the model changes characters or drops spaces: pre-tokens can't be counted apart")
    words = [p[1:] for p in pieces if p[0] == MARK and p[1:] and MARK not in p[1:]]
    return [w for w, ids in zip(words, sp.encode(words, num_threads=1), strict=True) if len(ids) == 1]


class Counts:
    """Tokens of texts."""

    def __init__(self, model: bytes, whole: list[str]):
        self.whole = {w.encode(): b"\x01\0\0\0" for w in whole}
        self.encode = sentencepiece.SentencePieceProcessor(model_proto=model).encode
        self.lexicon = Lexicon(self.make)

    def make(self, pieces: list[bytes]) -> list[bytes]:
        """The count of each pre-token, given without the one mark (or text start) that stands before it, as an integer's bytes."""
        rest = [p for p in pieces if p and p not in self.whole]
        counts = {b"": b"\x01\0\0\0"}  # a lone mark, where a text ends in a space
        for piece, ids in zip(rest, self.encode([p.decode("utf-8", "replace") for p in rest], num_threads=1), strict=True):
            counts[piece] = len(ids).to_bytes(4, "little")
        return [self.whole.get(p) or counts[p] for p in pieces]

    def of(self, texts: list[str]) -> list[int]:
        out = []
        for some in by_size(texts, 1 << 20):
            # the library puts one mark before a text; to it the mark and a space are the same character
            data = [b" " + t.replace(MARK, " ").encode("utf-8", "replace") if t else b"" for t in some]
            buffer = b"".join(data)
            ends = np.cumsum([len(d) for d in data])
            spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
            first = np.diff(spaces, prepend=-2) > 1
            first |= np.isin(spaces, ends)  # a text's first mark, whatever the text before ends in
            runs = spaces[first]
            values, _ = self.lexicon.look_up(buffer, runs + 1, np.append(runs[1:], len(buffer)))
            out += per_text(values, runs, ends).tolist()
        return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; see the module."""
    spark = Scratch(docs.sparkSession, "tokens").spark
    model = read_local(model_path)
    shared = spark.sparkContext.broadcast((model, proven(model)))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = built(("count", len(shared.value[0]), zlib.crc32(shared.value[0])), lambda: Counts(*shared.value))
        n = counts.of(batch.column(2).to_pylist())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_batches(rows, count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
