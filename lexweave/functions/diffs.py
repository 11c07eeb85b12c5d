"""Column functions on diffs (array<struct<op, text>>). Those that read a diff are native; those that make one are Arrow UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Config
from ..core import codec, locate, patches, search, tidy
from ..core.segments import DELETE, EQUAL, INSERT


def source_text(diff: Column) -> Column:
    return F.array_join(F.transform(F.filter(diff, lambda x: x["op"] != INSERT), lambda x: x["text"]), "")


def target_text(diff: Column) -> Column:
    return F.array_join(F.transform(F.filter(diff, lambda x: x["op"] != DELETE), lambda x: x["text"]), "")


def equal_length(diff: Column) -> Column:
    return F.aggregate(F.filter(diff, lambda x: x["op"] == EQUAL), F.lit(0), lambda n, x: n + F.length(x["text"]))


def edit_cost(diff: Column) -> Column:
    start = F.struct(F.lit(0).alias("cost"), F.lit(0).alias("ins"), F.lit(0).alias("del"))

    def step(s: Column, x: Column) -> Column:
        n, op = F.length(x["text"]), x["op"]
        closed = F.struct((s["cost"] + F.greatest(s["ins"], s["del"])).alias("cost"), F.lit(0).alias("ins"), F.lit(0).alias("del"))
        grown = F.struct(s["cost"].alias("cost"), (s["ins"] + F.when(op == INSERT, n).otherwise(0)).alias("ins"), (s["del"] + F.when(op == DELETE, n).otherwise(0)).alias("del"))
        return F.when(op == EQUAL, closed).otherwise(grown)

    return F.aggregate(diff, start, step, lambda s: s["cost"] + F.greatest(s["ins"], s["del"]))


def map_position(diff: Column, place: Column) -> Column:
    """Where a place of the source is in the target."""
    start = F.struct(F.lit(0).alias("before"), F.lit(0).alias("after"), F.lit(None).cast("int").alias("found"))

    def step(s: Column, x: Column) -> Column:
        n, op = F.length(x["text"]), x["op"]
        here = (op != INSERT) & (s["before"] + n > place)
        found = F.coalesce(s["found"], F.when(here & (op == DELETE), s["after"]).when(here, s["after"] + place - s["before"]))
        return F.struct((s["before"] + F.when(op != INSERT, n).otherwise(0)).alias("before"), (s["after"] + F.when(op != DELETE, n).otherwise(0)).alias("after"), found.cast("int").alias("found"))

    return F.aggregate(diff, start, step, lambda s: F.coalesce(s["found"], s["after"] + place - s["before"])).cast("int")


#: How segments are marked up.
STYLE = {INSERT: ('<ins style="background:#e6ffe6;">', "</ins>"), DELETE: ('<del style="background:#ffe6e6;">', "</del>"), EQUAL: ("<span>", "</span>")}


def html(diff: Column) -> Column:
    def escaped(text: Column) -> Column:
        for plain, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&para;<br>")):
            text = F.replace(text, F.lit(plain), F.lit(mark))
        return text

    def segment(x: Column) -> Column:
        out = F
        for op, (left, right) in STYLE.items():
            out = out.when(x["op"] == op, F.concat(F.lit(left), escaped(x["text"]), F.lit(right)))
        return out

    return F.array_join(F.transform(diff, segment), "")


def _udf(fn, kind):
    """An Arrow UDF that gives null for a null argument."""

    def run(*values):
        return None if any(v is None for v in values) else fn(*values)

    return F.udf(run, kind, useArrow=True)


def _plain(diff) -> list:
    return [(op, text) for op, text in diff]


def _patches(rows) -> list:
    return [patches.Patch(_plain(diffs), *spans) for diffs, *spans in rows]


def _patch_rows(some) -> list:
    return [(p.diffs, p.start1, p.start2, p.length1, p.length2) for p in some]


def diff(a: Column, b: Column, lines: bool = True, config: Config = DEFAULT) -> Column:
    """The diff from a to b; null if either is null."""
    return _udf(lambda x, y: search.diff(x, y, lines, config), schema.DIFF)(a, b)


def half_match(a: Column, b: Column) -> Column:
    return _udf(search.half_match, schema.HALF_MATCH)(a, b)


def merge(d: Column) -> Column:
    return _udf(lambda x: tidy.merge(_plain(x)), schema.DIFF)(d)


def semantic(d: Column) -> Column:
    return _udf(lambda x: tidy.semantic(_plain(x)), schema.DIFF)(d)


def lossless(d: Column) -> Column:
    return _udf(lambda x: tidy.lossless(_plain(x)), schema.DIFF)(d)


def efficiency(d: Column, edit_cost: int = 4) -> Column:
    return _udf(lambda x: tidy.efficiency(_plain(x), edit_cost), schema.DIFF)(d)


def to_delta(d: Column) -> Column:
    return _udf(lambda x: codec.to_delta(_plain(x)), "string")(d)


def _quiet(fn):
    """In permissive mode, what can't be read is null."""

    def run(*values):
        try:
            return fn(*values)
        except ValueError:
            return None

    return run


def from_delta(source: Column, delta: Column, strict: bool = True) -> Column:
    fn = codec.from_delta if strict else _quiet(codec.from_delta)
    return _udf(fn, schema.DIFF)(source, delta)


def locate_fuzzy(text: Column, pattern: Column, place: Column, config: Config = DEFAULT) -> Column:
    """Place of pattern near place, or -1. The UDF is asked only where exact tests don't decide."""
    from .text import exact_location

    exact = exact_location(text, pattern, place)
    fuzzy = _udf(lambda t, p, at: locate.locate(t, p, at, config), "int")
    return F.coalesce(exact, fuzzy(F.when(exact.isNull(), text), pattern, place))


def bitap_alphabet(pattern: Column) -> Column:
    """map<character, bits>: the bits of the character's places, the last place being bit 0."""
    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    n = F.length(pattern)
    bits = lambda c: F.aggregate(F.transform(chars, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1), n - i - 1)).otherwise(0)), F.lit(0), lambda a, x: a.bitwiseOR(x))
    return F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, bits(c))))


def patch_make(a: Column, b: Column, config: Config = DEFAULT) -> Column:
    return _udf(lambda x, y: _patch_rows(patches.make(x, y, config)), schema.PATCHES)(a, b)


def patch_from_diff(d: Column, text: Column | None = None, config: Config = DEFAULT) -> Column:
    text = source_text(d) if text is None else text
    return _udf(lambda x, t: _patch_rows(patches.from_diff(_plain(x), t, config)), schema.PATCHES)(d, text)


def patch_apply(some: Column, text: Column, config: Config = DEFAULT) -> Column:
    return _udf(lambda p, t: patches.apply(_patches(p), t, config), schema.APPLIED)(some, text)


def patch_to_text(some: Column) -> Column:
    return _udf(lambda p: patches.to_text(_patches(p)), "string")(some)


def patch_from_text(text: Column, strict: bool = True) -> Column:
    fn = lambda t: _patch_rows(patches.from_text(t))
    return _udf(fn if strict else _quiet(fn), schema.PATCHES)(text)


def _span(start: Column, length: Column) -> Column:
    one = F.format_string("%d", start + 1)
    return F.when(length == 0, F.format_string("%d,0", start)).when(length == 1, one).otherwise(F.format_string("%d,%d", start + 1, length))


def patch_header(patch: Column) -> Column:
    return F.concat(F.lit("@@ -"), _span(patch["start1"], patch["length1"]), F.lit(" +"), _span(patch["start2"], patch["length2"]), F.lit(" @@"))


#: Fixed value: the header of a patch.
HEADER = r"^@@ -([0-9]+),?([0-9]*) \+([0-9]+),?([0-9]*) @@$"


def parse_header(line: Column) -> Column:
    """struct(start1, length1, start2, length2) of a header, starts from 0; null if it is none."""

    def part(k: int) -> Column:
        return F.regexp_extract(line, HEADER, k)

    def span(k: int) -> tuple[Column, Column]:
        start, n = part(k).cast("int"), part(k + 1)
        return F.when(n == "0", start).otherwise(start - 1), F.when(n == "", 1).otherwise(n.cast("int"))

    (s1, n1), (s2, n2) = span(1), span(3)
    return F.when(line.rlike(HEADER), F.struct(s1.alias("start1"), n1.alias("length1"), s2.alias("start2"), n2.alias("length2")))
