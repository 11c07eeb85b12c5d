"""Patches: made from a diff, applied to another text, written and read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..config import DEFAULT, Config
from . import tidy
from .codec import escape, unescape
from .locate import locate
from .search import diff as compare
from .segments import DELETE, EQUAL, INSERT, Diff, edit_cost, map_position, source, target


@dataclass
class Patch:
    diffs: Diff = field(default_factory=list)
    start1: int | None = None
    start2: int | None = None
    length1: int = 0
    length2: int = 0

    def header(self) -> str:
        return f"@@ -{_span(self.start1, self.length1)} +{_span(self.start2, self.length2)} @@\n"

    def __str__(self) -> str:
        return self.header() + "".join(f"{' +-'[op]}{escape(text)}\n" for op, text in self.diffs)

    def grow(self, before: str = "", after: str = "") -> None:
        """Add equal text at the ends, joined to equalities there."""
        if before:
            if self.diffs and self.diffs[0][0] == EQUAL:
                self.diffs[0] = (EQUAL, before + self.diffs[0][1])
            else:
                self.diffs.insert(0, (EQUAL, before))
            self.start1 -= len(before)
            self.start2 -= len(before)
        if after:
            if self.diffs and self.diffs[-1][0] == EQUAL:
                self.diffs[-1] = (EQUAL, self.diffs[-1][1] + after)
            else:
                self.diffs.append((EQUAL, after))
        self.length1 += len(before) + len(after)
        self.length2 += len(before) + len(after)


def _span(start: int, length: int) -> str:
    if length == 0:
        return f"{start},0"
    return f"{start + 1}" if length == 1 else f"{start + 1},{length}"


def make(a: str, b: str, config: Config = DEFAULT) -> list[Patch]:
    """Patches from a to b."""
    found = compare(a, b, True, config)
    if len(found) > 2:
        found = tidy.efficiency(tidy.semantic(found), config.edit_cost)
    return from_diff(found, a, config)


def from_diff(found: Diff, text: str | None = None, config: Config = DEFAULT) -> list[Patch]:
    """Patches of a diff, whose source is text."""
    text = source(found) if text is None else text
    out: list[Patch] = []
    patch, before = Patch(), text  # before: the text when the patch's turn comes, with all earlier ones applied
    done = ""  # the target so far
    read = at1 = 0  # characters of the source read; and where the next patch starts in `before`
    for k, (op, piece) in enumerate(found):
        n = len(piece)
        if op != EQUAL:
            if not patch.diffs:
                patch.start1, patch.start2 = at1, len(done)
            patch.diffs.append((op, piece))
            patch.length1 += n if op == DELETE else 0
            patch.length2 += n if op == INSERT else 0
        elif patch.diffs and n <= 2 * config.patch_margin and k + 1 < len(found):
            patch.diffs.append((op, piece))
            patch.length1 += n
            patch.length2 += n
        elif patch.diffs and n >= 2 * config.patch_margin:
            out.append(add_context(patch, before, config))
            patch, before, at1 = Patch(), done + text[read:], len(done)
        read += n if op != INSERT else 0
        at1 += n if op != INSERT else 0
        done += piece if op != DELETE else ""
    if patch.diffs:
        out.append(add_context(patch, before, config))
    return out


def add_context(patch: Patch, text: str, config: Config = DEFAULT) -> Patch:
    """Equal text around the patch, till it is found in one place only or is too long, and a margin more."""
    if not text:
        return patch
    start, end, wide = patch.start2, patch.start2 + patch.length1, 0
    pattern = text[start:end]
    while text.find(pattern) != text.rfind(pattern) and len(pattern) < config.match_max_bits - 2 * config.patch_margin:
        wide += config.patch_margin
        pattern = text[max(0, start - wide) : end + wide]
    wide += config.patch_margin
    before, after = text[max(0, start - wide) : start], text[end : end + wide]
    # the context stands apart from equalities that a patch may begin with
    if before:
        patch.diffs.insert(0, (EQUAL, before))
    if after:
        patch.diffs.append((EQUAL, after))
    patch.start1 -= len(before)
    patch.start2 -= len(before)
    patch.length1 += len(before) + len(after)
    patch.length2 += len(before) + len(after)
    return patch


def copied(patches: list[Patch]) -> list[Patch]:
    return [Patch(list(p.diffs), p.start1, p.start2, p.length1, p.length2) for p in patches]


def pad(patches: list[Patch], config: Config = DEFAULT) -> tuple[str, list[Patch]]:
    """Edges of the text as characters 1, 2, ...: the padding, and patches that know it."""
    margin = config.patch_margin
    padding = "".join(map(chr, range(1, margin + 1)))
    out = copied(patches)
    for p in out:
        p.start1 += margin
        p.start2 += margin
    first, last = out[0], out[-1]
    lead = len(first.diffs[0][1]) if first.diffs and first.diffs[0][0] == EQUAL else 0
    first.grow(before=padding[lead:])
    trail = len(last.diffs[-1][1]) if last.diffs and last.diffs[-1][0] == EQUAL else 0
    last.grow(after=padding[: max(0, margin - trail)])
    return padding, out


def split(patches: list[Patch], config: Config = DEFAULT) -> list[Patch]:
    """Patches short enough to be located, but for large deletions."""
    out = []
    for p in patches:
        out += [p] if p.length1 <= config.match_max_bits else _pieces(p, config)
    return out


def _pieces(big: Patch, config: Config) -> list[Patch]:
    most, margin = config.match_max_bits, config.patch_margin
    rest, out, lead = list(big.diffs), [], ""
    at1, at2 = big.start1, big.start2
    while rest:
        piece = Patch([(EQUAL, lead)] if lead else [], at1 - len(lead), at2 - len(lead), len(lead), len(lead))
        changes = False
        while rest and piece.length1 < most - margin:
            op, text = rest[0]
            whole = op == INSERT or (op == DELETE and len(piece.diffs) == 1 and piece.diffs[0][0] == EQUAL and len(text) > 2 * most)
            if not whole:
                text = text[: most - piece.length1 - margin]
            left = rest[0][1][len(text) :]
            rest[:1] = [(op, left)] if left else []
            piece.diffs.append((op, text))
            n1, n2 = len(text) * (op != INSERT), len(text) * (op != DELETE)
            piece.length1, piece.length2, at1, at2 = piece.length1 + n1, piece.length2 + n2, at1 + n1, at2 + n2
            changes |= op != EQUAL
        lead = target(piece.diffs)
        lead = lead[max(0, len(lead) - margin) :]
        piece.grow(after=source(rest)[:margin])
        if changes:
            out.append(piece)
    return out


def apply(patches: list[Patch], text: str, config: Config = DEFAULT) -> tuple[str, list[bool]]:
    """The patched text, and for each patch (after splitting) whether it was applied."""
    if not patches:
        return text, []
    padding, patches = pad(patches, config)
    text = padding + text + padding
    drift, applied = 0, []
    for patch in split(patches, config):
        expected = patch.start2 + drift
        start, end = _find(text, old := source(patch.diffs), expected, config)
        if start < 0:
            drift -= patch.length2 - patch.length1
            applied.append(False)
            continue
        drift = start - expected
        changed = _replace(text, patch, old, start, end, config)
        applied.append(changed is not None)
        text = text if changed is None else changed
    return text[len(padding) : len(text) - len(padding)], applied


def _find(text: str, old: str, expected: int, config: Config) -> tuple[int, int]:
    """Start and end of what is to be replaced; start -1 if it is not found. Long texts are found by both ends."""
    most = config.match_max_bits
    if len(old) <= most:
        start = locate(text, old, expected, config)
        return start, start + len(old)
    start = locate(text, old[:most], expected, config)
    if start < 0:
        return -1, -1
    tail = locate(text, old[len(old) - most :], expected + len(old) - most, config)
    return (-1, -1) if tail < 0 or start >= tail else (start, tail + most)


def _replace(text: str, patch: Patch, old: str, start: int, end: int, config: Config) -> str | None:
    there = text[start:end]
    if there == old:
        return text[:start] + target(patch.diffs) + text[start + len(old) :]
    between = compare(old, there, False, config)
    if len(old) > config.match_max_bits and edit_cost(between) / len(old) > config.patch_delete_threshold:
        return None
    between = tidy.lossless(between)
    at = 0
    for op, piece in patch.diffs:
        if op != EQUAL:
            place = start + map_position(between, at)
            if op == INSERT:
                text = text[:place] + piece + text[place:]
            else:
                text = text[:place] + text[start + map_position(between, at + len(piece)) :]
        at += len(piece) if op != DELETE else 0
    return text


def to_text(patches: list[Patch]) -> str:
    return "".join(map(str, patches))


#: Fixed value: the header of a patch.
HEADER = re.compile(r"@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@")


def from_text(text: str) -> list[Patch]:
    out: list[Patch] = []
    for line in text.split("\n") if text else []:
        sign, rest = line[:1], line[1:]
        if sign == "@" or not out:
            header = HEADER.fullmatch(line)
            if not header:
                raise ValueError(f"invalid patch: {line}")
            (start1, length1), (start2, length2) = _read_span(header[1], header[2]), _read_span(header[3], header[4])
            out.append(Patch([], start1, start2, length1, length2))
        elif sign:
            if sign not in "+- ":
                raise ValueError(f"invalid sign: {line}")
            out[-1].diffs.append(({"-": DELETE, "+": INSERT, " ": EQUAL}[sign], unescape(rest)))
    return out


def _read_span(start: str, length: str) -> tuple[int, int]:
    if length == "0":
        return int(start), 0
    return int(start) - 1, int(length) if length else 1
