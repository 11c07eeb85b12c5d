"""Diffs and patches as text."""

from __future__ import annotations

import re
from urllib.parse import quote

from .segments import DELETE, EQUAL, INSERT, Diff

#: Characters that escaping leaves alone, and those whose escapes stay as they are when read.
KEPT = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789;,/?:@&=+$-_.!~*'()#"
RESERVED = ";/?:@&=+$,#"

_ESCAPES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_NUMBER = re.compile(r"\s*([+-]?\d+)")


def escape(text: str) -> str:
    """Percent escapes of UTF-8, with spaces as they are. Lone surrogates raise ValueError."""
    return quote(text, safe=KEPT + " ", encoding="utf-8", errors="strict")


def unescape(text: str) -> str:
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        raise ValueError(f"illegal escape: {text}")

    def decode(match: re.Match) -> str:
        try:
            plain = bytes.fromhex(match[0].replace("%", "")).decode("utf-8")
        except UnicodeDecodeError as e:
            raise ValueError(f"illegal escape: {text}") from e
        at, out = 0, []
        for c in plain:
            n = 3 * len(c.encode())
            out.append(match[0][at : at + n] if c in RESERVED else c)
            at += n
        return "".join(out)

    return _ESCAPES.sub(decode, text)


def to_delta(diff: Diff) -> str:
    return "\t".join("+" + escape(text) if op == INSERT else f"{'-' if op == DELETE else '='}{len(text)}" for op, text in diff)


def from_delta(source: str, delta: str) -> Diff:
    out, at = [], 0
    for token in delta.split("\t"):
        kind, rest = token[:1], token[1:]
        if kind == "+":
            out.append((INSERT, unescape(rest)))
        elif kind in ("-", "=") and kind:
            number = _NUMBER.match(rest)
            if not number or int(number[1]) < 0:
                raise ValueError(f"invalid number: {rest}")
            n = int(number[1])
            out.append((EQUAL if kind == "=" else DELETE, source[at : at + n]))
            at += n
        elif token:
            raise ValueError(f"invalid operation: {token}")
    if at != len(source):
        raise ValueError(f"delta covers {at} characters; the source has {len(source)}")
    return out
