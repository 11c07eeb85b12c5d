"""Diffs as lists of (op, text), and what can be read from them."""

from __future__ import annotations

DELETE, EQUAL, INSERT = -1, 0, 1

Diff = list[tuple[int, str]]


def source(diff: Diff) -> str:
    """The text that the diff starts from."""
    return "".join(text for op, text in diff if op != INSERT)


def target(diff: Diff) -> str:
    """The text that the diff leads to."""
    return "".join(text for op, text in diff if op != DELETE)


def map_position(diff: Diff, place: int) -> int:
    """Where a place of the source is in the target; a deleted place is where the deletion was."""
    before = after = 0
    for op, text in diff:
        n = len(text)
        if op != INSERT and before + n > place:
            return after if op == DELETE else after + place - before
        before += n if op != INSERT else 0
        after += n if op != DELETE else 0
    return after + place - before


def edit_cost(diff: Diff) -> int:
    """Characters inserted, deleted or replaced, counted run by run."""
    cost, run = 0, {INSERT: 0, DELETE: 0}
    for op, text in [*diff, (EQUAL, "")]:
        if op == EQUAL:
            cost += max(run.values())
            run = {INSERT: 0, DELETE: 0}
        else:
            run[op] += len(text)
    return cost


def equal_length(diff: Diff) -> int:
    return sum(len(text) for op, text in diff if op == EQUAL)


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving the part not known yet."""
    low, high = 0, min(len(a), len(b))
    if high and a[0] != b[0]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def common_suffix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if high and a[-1] != b[-1]:
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def common_overlap(a: str, b: str) -> int:
    """Length of the longest suffix of a that is a prefix of b: the border of b + separator + a, by failure links."""
    n = min(len(a), len(b))
    a, b = a[len(a) - n :], b[:n]
    fail = [0] * n
    k = 0
    for i in range(1, n):
        while k and b[i] != b[k]:
            k = fail[k - 1]
        k += b[i] == b[k]
        fail[i] = k
    k = 0
    for c in a:
        while k and (k == n or c != b[k]):
            k = fail[k - 1]
        k += c == b[k] if n else 0
    return k
