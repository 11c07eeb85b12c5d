"""Integer sequences for the words of a byte buffer, looked up without a Python object for each word.

Words are ranges of the buffer. Their 64-bit polynomial hashes come from prefix sums over the whole buffer; the different hashes
of a buffer are looked up once each, and only words not known yet become objects, to be handed to `make`. A hash decides nothing by itself:
the bytes of each word are compared with those of the first word of its hash in the buffer, and these with the bytes that are remembered.
Buffers in which different words share a hash take the plain way, as do words longer than LONGEST.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_DRAW = np.random.default_rng(20_240)
_BYTES = _DRAW.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed together.
SPAN = 1 << 19
#: Bytes of the longest word that is hashed and remembered; longer ones are made each time.
LONGEST = 4096


class _Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < SPAN:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers(0x9E3779B97F4A7C15)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of data, which has at most SPAN bytes."""
    up, down = _POWERS.all()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def same(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, places: np.ndarray) -> bool:
    """Whether all ranges of data (starts, sizes) have the bytes of the ranges of the same sizes at places in other."""
    stop = np.cumsum(sizes)
    if not len(stop) or not stop[-1]:
        return True
    at = np.arange(stop[-1])
    at += np.repeat(starts - (stop - sizes), sizes)
    return bool((data[at] == other[at + np.repeat(places - starts, sizes)]).all())


class Lexicon:
    """make(words) gives the little-endian 32-bit integers of each word, as bytes.

    At most `limit` words and `most_bytes` of their bytes are remembered, in sorted arrays, to which the newest are merged from a dict.
    """

    NEWEST = 1 << 16

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], limit: int = 1_200_000, most_bytes: int = 24 << 20):
        self.make, self.limit, self.most_bytes = make, limit, most_bytes
        self._forget()

    def _forget(self) -> None:
        self.newest: dict[int, int] = {}
        self.keys, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.offset, self.length, self.values = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.place, self.size, self.text = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint8)
        self.n = self.used = self.written = 0

    def _learn(self, words: list[bytes], keys: list[int]) -> None:
        made = self.make(words)
        lengths = np.fromiter(map(len, made), np.int32, len(made)) // 4
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        flat, text = np.frombuffer(b"".join(made), "<i4"), np.frombuffer(b"".join(words), np.uint8)
        n, used, written = self.n + len(words), self.used + len(flat), self.written + len(text)
        for name, need in (("offset", n), ("length", n), ("place", n), ("size", n), ("values", used), ("text", written)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(need - len(have) + need // 4, have.dtype)]))
        self.length[self.n : n], self.size[self.n : n] = lengths, sizes
        self.offset[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.place[self.n : n] = self.written + np.cumsum(sizes) - sizes
        self.values[self.used : used], self.text[self.written : written] = flat, text
        self.newest.update(zip(keys, range(self.n, n), strict=True))
        self.n, self.used, self.written = n, used, written
        if len(self.newest) > self.NEWEST:
            keys = np.concatenate([self.keys, np.fromiter(self.newest, np.uint64, len(self.newest))])
            rank = np.concatenate([self.rank, np.fromiter(self.newest.values(), np.int32, len(self.newest))])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rank, self.newest = keys[order], rank[order], {}

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each (sorted) key, -1 if it is not known."""
        at = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[near] == keys
            at[hit] = self.rank[near[hit]]
        rest = np.flatnonzero(at < 0)
        if self.newest and len(rest):
            get = self.newest.get
            at[rest] = [get(k, -1) for k in keys[rest].tolist()]
        return at

    def look_up(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all words, one after the other; how many each word has); starts and ends ascend."""
        values, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        long = np.flatnonzero(ends - starts > LONGEST)
        for low, stop in zip([0, *(long + 1).tolist()], [*long.tolist(), len(starts)], strict=True):
            while low < stop:
                high = min(stop, max(low + 1, int(np.searchsorted(ends, starts[low] + SPAN - 1))))
                some = self._near(buffer, starts[low:high], ends[low:high])
                values.append(some[0])
                lengths.append(some[1])
                low = high
            if stop < len(starts):
                some = self._plain(buffer, starts[stop : stop + 1], ends[stop : stop + 1])
                values.append(some[0])
                lengths.append(some[1])
        return np.concatenate(values), np.concatenate(lengths)

    def _near(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first_byte = int(starts[0])
        data = np.frombuffer(buffer, np.uint8, int(ends[-1]) - first_byte, first_byte)
        own, sizes = starts - first_byte, ends - starts
        keys, first, inverse = np.unique(hashes(data, own, ends - first_byte), return_index=True, return_inverse=True)
        if self.n + len(keys) > self.limit or self.written > self.most_bytes:
            self._forget()
        if not (sizes[first][inverse] == sizes).all() or not same(data, own, sizes, data, own[first][inverse]):
            return self._plain(buffer, starts, ends)
        at = self._places(keys)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        if not (self.size[at[old]] == sizes[first[old]]).all() or not same(data, own[first[old]], sizes[first[old]], self.text, self.place[at[old]].astype(np.int64)):
            return self._plain(buffer, starts, ends)
        if len(new):
            at[new] = np.arange(self.n, self.n + len(new))
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn([buffer[a:b] for a, b in zip(s, e, strict=True)], keys[new].tolist())
        at = at[inverse]
        length = self.length[at].astype(np.int64)
        stop = np.cumsum(length)
        where = np.repeat(self.offset[at] - (stop - length), length)
        where += np.arange(len(where))
        return self.values[where], length

    def _plain(self, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.make([buffer[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        return np.frombuffer(b"".join(made), "<i4"), np.array([len(m) // 4 for m in made], np.int64)


def per_text(lengths: np.ndarray, starts: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """How many values each text has, from those of its words; text_ends are places in the buffer."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(sums[np.searchsorted(starts, text_ends, "left")], prepend=0)
