"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

The bytes of a vocabulary are mapped to Latin-1 characters for an Aho-Corasick automaton, which gives the longest token
at a position. A sequence of tokens is what the merges give if, and only if, each two neighbours are compatible: if
merging their bytes gives those two tokens again. The encoder takes the longest token that is compatible with the one
before, falls back to the longest shorter prefix token, and steps back where none fits; positions found dead are not
entered again, so the time is linear in the bytes. Compatibility of two tokens is remembered.

A text is cut before each space that a character other than white space follows: no match of the pattern spans such a
place. Ids of cuts and of matches are remembered (see lexicon.py), so frequent words are encoded once a worker.

Defined cases: a null text is empty and has no ids. Special strings are ordinary text. Decoding unknown ids raises an
error. Decoded bytes of an encoded text are its UTF-8 bytes. Texts of any length are encoded whole. A null doc_id stays null; rows that
repeat are encoded each. Of other columns those named in `keep`, which must not be called ids or decoded, are passed on, the rest is not
read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memory, Scratch, built, fresh, by_size, map_batches, read_local
from .lexicon import Lexicon, per_text
from .token_files import CHUNK, lists

#: Cuts, matches of the pattern and pairs of tokens that a worker remembers; fewer cost time and no result.
REMEMBERED, MATCHES, PAIRS = 650_000, 120_000, 250_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The plain merges, lowest rank and then leftmost first; also the two parts of the last merge."""
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token that merges can make: the ids of the two parts of its last merge; single bytes have themselves."""
    out = {}
    for token, rank in ranks.items():
        parts, last = merge(token, ranks)
        if len(parts) == 1:
            out[rank] = (ranks[last[0]], ranks[last[1]]) if last else (rank, rank)
    return out


class Encoder(Memory):
    """Ids of texts; what it remembers itself are little-endian 32-bit ids of matches of the pattern."""

    def __init__(self, ranks: dict[bytes, int], made_of: dict[int, tuple[int, int]], pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        share = remembered / REMEMBERED
        self.LIMIT, self.most_pairs = int(MATCHES * share), int(PAIRS * share)
        self.ranks, self.made_of, self.pattern = ranks, made_of, regex.compile(pattern)
        self.bytes = {r: t for t, r in ranks.items()}
        self.reachable = {t: r for t, r in ranks.items() if r in made_of}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.reachable.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lexicon = Lexicon(self.make, remembered, int((24 << 20) * share))
        self.pairs: dict[int, bool] = {}
        self.shorter = lru_cache(self.most_pairs)(self._shorter)

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, latest first, along the seam; a merge over the seam that was due earlier breaks the pair."""
        due = 1 << 60  # merges over the seam of lower rank than this would have come first
        while True:
            if self.ranks.get(self.bytes[left] + self.bytes[right], 1 << 60) < due:
                return False
            inner_left, inner_right = self.made_of[left][1], self.made_of[right][0]
            if inner_left == left and inner_right == right:
                return True
            if inner_right == right or (inner_left != left and left > right):
                due, left = left, inner_left
            else:
                due, right = right + 1, inner_right  # at equal ranks the leftmost merge is first, and the seam is left of it

    def _shorter(self, token: int) -> int:
        """The longest proper prefix that is a token, or -1."""
        data = self.bytes[token]
        return next((self.reachable[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.reachable), -1)

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        longest = [token for _, token in self.automaton.iter_long(text)]
        if all(map(self.compatible, longest, longest[1:])):
            return longest  # no step back is needed
        out: list[int] = []
        at, dead = 0, bytearray(n + 1)
        token = longest[0]
        while True:
            end = at + len(self.bytes[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at = end
                token = next(self.automaton.iter_long(text, at))[1]
            elif (less := self.shorter(token)) >= 0:
                token = less
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(self.bytes[token])

    def make(self, cuts: list[bytes]) -> list[bytes]:
        """Ids of cuts. The matches of the pattern in them are encoded once each, and remembered."""
        find = self.pattern.findall
        matches = [find(c.decode("utf-8", "replace")) for c in cuts]
        table = self.table(set().union(*matches))
        return [table[m[0]] if len(m) == 1 else b"".join([table[p] for p in m]) for m in matches]

    def make_all(self, matches: list[str]) -> dict[str, bytes]:
        return {m: array("i", self.piece(m.encode())).tobytes() for m in matches}

    def encode(self, texts: list[str]) -> pa.ListArray:
        sizes, chunks = [], []
        for some in by_size(texts, CHUNK):
            data = [t.encode("utf-8", "replace") for t in some]
            buffer = b"".join(data)
            starts, text_ends = cuts(buffer, np.cumsum([len(d) for d in data]))
            values, lengths = self.lexicon.look_up(buffer, starts, np.append(starts[1:], len(buffer)))
            chunks.append(values)
            sizes.append(per_text(lengths, starts, text_ends))
        return lists(np.concatenate([np.zeros(0, np.int32), *chunks]), np.concatenate([np.zeros(0, np.int64), *sizes]))


#: Bytes that may start white space (of ASCII or Unicode); a space before them is no place to cut.
_MAY_BE_SPACE = np.isin(np.arange(256), [*range(33), 0xC2, 0xE1, 0xE2, 0xE3])


def cuts(buffer: bytes, text_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts start: at texts' starts and at spaces before what surely is no white space."""
    data = np.frombuffer(buffer, np.uint8)
    inner = np.flatnonzero((data[:-1] == 32) & ~_MAY_BE_SPACE[data[1:]]) if len(data) else np.zeros(0, np.int64)
    # the last byte of a text and the first of the next are no neighbours
    firsts = np.concatenate([[0], text_ends[:-1]]).astype(np.int64)
    inner = inner[~np.isin(inner + 1, firsts)]
    starts = np.unique(np.concatenate([inner, firsts]))
    return starts[starts < len(data)], text_ends


def _encoder(shared, remembered: int) -> Encoder:
    ranks, made_of, pattern, mark = shared.value
    return built(("bpe", mark, pattern, remembered), lambda: Encoder(ranks, made_of, pattern, remembered))


def tables(spark, ranks_path: str, pattern: str):
    """The vocabulary, its merges and the pattern, broadcast: a few MB, whatever the texts."""
    data = read_local(ranks_path)
    mark = (len(data), zlib.crc32(data))

    def make():
        ranks = load_ranks(data)
        return ranks, halves(ranks), pattern, mark

    return spark.sparkContext.broadcast(built(("tables", mark, pattern), make))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, the columns named in keep, and ids: array<int>; with decoded also the bytes that the ids decode to, in the same pass. remembered bounds a worker's memory."""
    shared = tables(Scratch(docs.sparkSession, "byte-bpe").spark, ranks_path, pattern)
    text = fresh("text_to_encode", docs)
    rows = docs.select(F.coalesce(text_col, F.lit("")).alias(text), F.col(id_col).cast("long").alias("doc_id"), *keep)
    schema = rows.drop(text).withColumn("ids", F.lit(None).cast("array<int>"))
    schema = (schema.withColumn("decoded", F.lit(None).cast("binary")) if decoded else schema).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(shared, remembered)
        ids = encoder.encode(batch.column(0).to_pylist())
        more = [ids, pa.array(_decoded(ids, encoder.bytes), pa.binary())] if decoded else [ids]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=[*batch.schema.names[1:], "ids", "decoded"][: len(schema)])

    return map_batches(rows, run, schema)


def _decoded(ids: pa.ListArray, tokens: dict[int, bytes]) -> list[bytes | None]:
    values, offsets, null = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
    return [None if n else b"".join(map(tokens.__getitem__, values[a:b].tolist())) for a, b, n in zip(offsets[:-1], offsets[1:], null, strict=True)]


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids as a binary column; null ids give null."""
    spark = Scratch(rows.sparkSession, "byte-bpe").spark
    data = read_local(ranks_path)
    mark = (len(data), zlib.crc32(data))
    shared = spark.sparkContext.broadcast((data, mark))
    schema = rows.withColumn(out, F.lit(None).cast("binary")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = built(("decode", shared.value[1]), lambda: {r: t for t, r in load_ranks(shared.value[0]).items()})
        decoded = _decoded(batch.column(batch.schema.get_field_index(ids_col)), tokens)
        columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != out]
        names = [name for name in batch.schema.names if name != out]
        at = schema.names.index(out)
        columns.insert(at, pa.array(decoded, pa.binary()))
        names.insert(at, out)
        return pa.record_batch(columns, names=names)

    return map_batches(rows, run, schema)

