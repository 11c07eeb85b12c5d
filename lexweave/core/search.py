"""The diff of two texts: shortcuts, sentence level, and the middle of a shortest script."""

from __future__ import annotations

import re
from collections.abc import Generator, Iterator
from functools import lru_cache
from itertools import groupby
from math import isqrt

import numpy as np

from ..config import DEFAULT, Config
from .segments import DELETE, EQUAL, INSERT, Diff, common_prefix, common_suffix
from .tidy import half_overlap, merge, semantic

#: Fixed value: texts longer than this are compared by lines first.
LINE_MODE_OVER = 100

#: They change no result: texts up to this length may be remembered, and are aligned to count their edits before a search.
REMEMBERED, ALIGNED = 1 << 16, 2_000

_LINE = re.compile(r"[^\n]*\n|[^\n]+")

#: How many lines a text has, and the different ones.
Lines = tuple[int, frozenset[str]]

Steps = Generator[tuple[str, str, bool], Diff, Diff]


def diff(a: str, b: str, lines: bool = True, config: Config = DEFAULT) -> Diff:
    """The diff from a to b."""
    if a is None or b is None:
        raise ValueError("null input")
    return _Search(config).run(a, b, lines)


def to_lines(*texts: str) -> tuple[list[str], list[str]]:
    """Each text as a string of line codes, and the lines by code; code 0 is left blank, codes go by first use."""
    code: dict[str, str] = {"": chr(0)}
    coded = ["".join([code.setdefault(line, chr(len(code))) for line in _LINE.findall(text)]) for text in texts]
    return coded, list(code)


def _remembered(fn):
    """fn of a text; a licence meets many documents, and a document all licences, so short texts come again."""
    known = lru_cache(maxsize=128)(fn)
    return lambda text: known(text) if len(text) <= REMEMBERED else fn(text)


@_remembered
def _line_set(text: str) -> Lines:
    lines = _LINE.findall(text)
    return len(lines), frozenset(lines)


@_remembered
def _longest_line(text: str) -> int:
    return max(map(len, text.split("\n"))) + 1


def _only_short_parts(a: str, b: str, lines_a: Lines, lines_b: Lines) -> bool:
    """Whether it is proven that no part of half the shorter text's length is common.

    One with two line breaks would hold a whole line of both, and one with a single break lies in two lines.
    """
    return lines_a[1].isdisjoint(lines_b[1]) and 4 * min(_longest_line(a), _longest_line(b)) < min(len(a), len(b))


def from_lines(diff: Diff, lines: list[str]) -> Diff:
    return [(op, "".join([lines[ord(c)] for c in coded])) for op, coded in diff]


def half_match(a: str, b: str) -> tuple[str, str, str, str, str] | None:
    """(a before, a after, b before, b after, common) if a common part has half the longer text's length."""
    swap = len(a) <= len(b)
    long, short = (b, a) if swap else (a, b)
    if len(long) < 4 or 2 * len(short) < len(long):
        return None
    best = None
    for start in (-(-len(long) // 4), -(-len(long) // 2)):
        found = _around(long, short, start)
        if 2 * found[0] >= len(long) and (best is None or found[0] >= best[0]):
            best = found
    if best is None:
        return None
    n, at_long, at_short = best
    outer = (long[:at_long], long[at_long + n :])
    inner = (short[:at_short], short[at_short + n :])
    return (*inner, *outer, short[at_short : at_short + n]) if swap else (*outer, *inner, short[at_short : at_short + n])


def _around(long: str, short: str, start: int) -> tuple[int, int, int]:
    """(length, place in long, place in short) of the first longest common part through long's quarter from start."""
    seed, best = long[start : start + len(long) // 4], (0, 0, 0)
    tail, head = long[start:], long[:start]
    at = short.find(seed)
    while at >= 0:
        ahead, back = common_prefix(tail, short[at:]), common_suffix(head, short[:at])
        if ahead + back > best[0]:
            best = (ahead + back, start - back, at - back)
        at = short.find(seed, at + 1)
    return best


#: Columns of an alignment between two looks at whether it can still prove anything.
COLUMNS = 32

#: Characters of a gram, and buckets that grams are counted in.
GRAM, GRAM_BUCKETS = 3, 4096


@_remembered
def _grams(text: str) -> np.ndarray:
    """How many grams of a text fall into each bucket."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = sum(codes[k : len(codes) - GRAM + 1 + k] * np.uint32(factor) for k, factor in enumerate((961, 31, 1)))
    return np.bincount(mixed * np.uint32(2654435761) >> np.uint32(20), minlength=GRAM_BUCKETS)


@_remembered
def _places(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return {c: int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little") for c in set(text)}


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, a column of the table at a time as bits (Hyyrö 2004).

    Once it is proven to be less than `least`, a number from it to less than `least`.
    """
    places, full = _places(b), (1 << len(b)) - 1
    column = full
    for done in range(0, len(a), COLUMNS):
        if len(b) - column.bit_count() + len(a) - done < least:
            return least - 1
        for c in a[done : done + COLUMNS]:
            if at := places.get(c):
                both = column & at
                column = (column + both | column - both) & full
    return len(b) - column.bit_count()


def takes_more_edits(a: str, b: str, most: int) -> bool:
    """Whether it is proven that every script from a to b has more than `most` insertions and deletions.

    An edit changes the length by one, and removes or adds 2 * GRAM - 1 grams at most (Ukkonen 1992); short texts are aligned.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return True
    if n + m <= most:
        return False
    each = 2 * GRAM - 1
    if min(n, m) >= GRAM and n + m > each * most and int(np.abs(_grams(a) - _grams(b)).sum()) > each * most:
        return True
    if set(a).isdisjoint(b):
        return True
    return max(n, m) <= ALIGNED and n + m - 2 * common_subsequence(a, b, (n + m - most + 1) // 2) > most


def _depths(left: int) -> int:
    """How many depths of a search a budget is enough for, the one that exhausts it included; depth d takes 2 * (d + 1)."""
    if left <= 0:
        return 0
    t = isqrt(left)
    return t if t * (t + 1) >= left else t + 1


def _step(a: str, b: str, d: int, reach: dict[int, int]) -> Iterator[tuple[int, int]]:
    """From the furthest places that d - 1 edits reach, by diagonal k = x - y, those that d edits reach; reach is renewed on the way."""
    n, m = len(a), len(b)
    for k in range(-d, d + 1, 2):
        x = max(reach.get(k - 1, -2) + 1, reach.get(k + 1, -1)) if d else 0
        y = x - k
        if x < 0 or x > n or y > m:
            reach.pop(k, None)  # outside the grid: the paths of this diagonal are at their end
            continue
        while x < n and y < m and a[x] == b[y]:
            x += 1
            y += 1
        reach[k] = x
        yield k, x


class _Search:
    def __init__(self, config: Config):
        self.config, self.left = config, config.budget

    def run(self, a: str, b: str, lines: bool) -> Diff:
        """Parts ask for the diffs of smaller parts; they wait on a stack of their own, however deep."""
        stack, answer = [self._whole(a, b, lines)], None
        while stack:
            try:
                stack.append(self._whole(*stack[-1].send(answer)))
                answer = None
            except StopIteration as done:
                stack.pop()
                answer = done.value
        return answer

    def _whole(self, a: str, b: str, lines: bool) -> Steps:
        if a == b:
            return [(EQUAL, a)] if a else []
        start = common_prefix(a, b)
        prefix, a, b = a[:start], a[start:], b[start:]
        end = common_suffix(a, b)
        suffix = a[len(a) - end :]
        a, b = a[: len(a) - end], b[: len(b) - end]
        middle = yield from self._middle(a, b, lines)
        out = [(EQUAL, prefix), *middle, (EQUAL, suffix)]
        if middle == [(DELETE, a), (INSERT, b)]:
            return [x for x in out if x[1]]  # nothing to merge: they have no common ends
        return merge([x for k, x in enumerate(out) if x[1] or 0 < k < len(out) - 1])

    def _middle(self, a: str, b: str, lines: bool) -> Steps:
        if not a or not b:
            return [(DELETE, a)] if a else [(INSERT, b)]
        op, long, short = (DELETE, a, b) if len(a) > len(b) else (INSERT, b, a)
        lines = lines and len(short) > LINE_MODE_OVER
        known = (_line_set(a), _line_set(b)) if lines else ()
        if lines and _only_short_parts(a, b, *known):
            return (yield from self._unlike(a, b, *known))
        if (at := long.find(short)) >= 0:
            return [(op, long[:at]), (EQUAL, short), (op, long[at + len(short) :])]
        if len(short) == 1:
            return [(DELETE, a), (INSERT, b)]
        if self.config.half_match and (half := half_match(a, b)):
            left = yield half[0], half[2], lines
            right = yield half[1], half[3], lines
            return [*left, (EQUAL, half[4]), *right]
        return (yield from self._by_lines(a, b, *known) if lines else self._by_characters(a, b))

    def _by_characters(self, a: str, b: str) -> Steps:
        split = self._meet(a, b)
        if split is None:
            return [(DELETE, a), (INSERT, b)]
        x, y = split
        left = yield a[:x], b[:y], False
        right = yield a[x:], b[y:], False
        return left + right

    def _unlike(self, a: str, b: str, lines_a: Lines, lines_b: Lines) -> Steps:
        """The diff of texts that have no line in common, nor ends, nor a half match, nor half an overlap: by lines it is one replacement."""
        n, m = lines_a[0], lines_b[0]
        if min(n, m) > 1:
            self._exhaust(n + m)
        middle = yield from self._by_characters(a, b)
        return middle if middle == [(DELETE, a), (INSERT, b)] else merge(middle)

    def _by_lines(self, a: str, b: str, lines_a: Lines, lines_b: Lines) -> Steps:
        (n, set_a), (m, set_b) = lines_a, lines_b
        if set_a.isdisjoint(set_b):
            if not half_overlap(a, b):
                return (yield from self._unlike(a, b, lines_a, lines_b))
            if min(n, m) > 1:
                self._exhaust(n + m)
            coarse = [(DELETE, a), (INSERT, b)]
        else:
            (coded_a, coded_b), lines = to_lines(a, b)
            coarse = from_lines((yield coded_a, coded_b, False), lines)
        out: Diff = []
        for is_equal, some in groupby(semantic(coarse), key=lambda x: x[0] == EQUAL):
            some = list(some)
            if not is_equal and len({op for op, _ in some}) == 2:
                gone = "".join(text for op, text in some if op == DELETE)
                new = "".join(text for op, text in some if op == INSERT)
                some = yield gone, new, False
            out += some
        return out

    def _exhaust(self, size: int) -> None:
        """Takes from the budget what a search over texts of that size together takes if it finds nothing."""
        if self.left is not None:
            depths = min((size + 1) // 2, _depths(self.left))
            self.left -= depths * (depths + 1)

    def _meet(self, a: str, b: str) -> tuple[int, int] | None:
        """A place that a shortest script passes through, or None if the budget ends.

        Furthest reaching paths from both ends (Myers 1986): the first forward and backward ones that overlap on a diagonal make a
        shortest script. Its length has the parity of len(a) - len(b), which tells the direction that closes the gap.
        Paths that overlap at depth d make a script of 2 * d edits at most: where all scripts are proven to be longer than
        the last depth's, the search finds nothing and only its cost is taken.
        """
        n, m = len(a), len(b)
        depths = (n + m + 1) // 2 if self.left is None else min((n + m + 1) // 2, _depths(self.left))
        if takes_more_edits(a, b, 2 * (depths - 1)):
            self._exhaust(n + m)
            return None
        ahead: dict[int, int] = {}
        back: dict[int, int] = {}
        ends = a[::-1], b[::-1]
        odd = (n - m) % 2 == 1
        for d in range((n + m + 1) // 2):
            if self.left is not None:
                if self.left <= 0:
                    return None
                self.left -= 2 * (d + 1)
            for k, x in _step(a, b, d, ahead):
                if odd and n - m - k in back and x + back[n - m - k] >= n:
                    return x, x - k
            for k, x in _step(*ends, d, back):
                if not odd and n - m - k in ahead and x + ahead[n - m - k] >= n:
                    return ahead[n - m - k], ahead[n - m - k] - (n - m - k)
        return None
