"""Native column functions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space, the same in Java's and in RE2's notation.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
SPACE_RE2 = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: SPACE in Java's notation alone: an ASCII character is told by one look-up, only others are held against each of the list.
SPACE_JAVA = r"[\s[\u00a0-\ufeff&&[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]]]"
#: A line with its break, or a last line without.
LINE = r"[^\n]*\n|[^\n]+"


def normalize(text: Column) -> Column:
    """White space runs to one space; a line break after each full stop."""
    return F.replace(F.regexp_replace(text, SPACE_JAVA + "+", " "), F.lit("."), F.lit(".\n"))


def lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    same = F.transform(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    first = F.array_position(same, False)
    return F.when(n == 0, 0).when(n > 0, F.least(n, F.when(first > 0, first - 1).otherwise(n))).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def common_overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of a that is a prefix of b."""
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: F.right(a, k) == F.left(b, k))
    return F.when(n == 0, 0).when(n > 0, F.coalesce(F.array_max(fits), F.lit(0))).cast("int")


def line_dictionary(a: Column, b: Column) -> Column:
    """struct(codes1, codes2, lines): lines by first use, codes from 1; line 0 is blank."""
    both = F.array_distinct(F.concat(lines(a), lines(b)))
    code = lambda line: F.array_position(both, line).cast("int")
    return F.struct(F.transform(lines(a), code).alias("codes1"), F.transform(lines(b), code).alias("codes2"), F.concat(F.array(F.lit("")), both).alias("lines"))


def from_codes(codes: Column, dictionary: Column) -> Column:
    return F.array_join(F.transform(codes, lambda c: F.element_at(dictionary, c + 1)), "")


def exact_location(text: Column, pattern: Column, place: Column) -> Column:
    """Where a pattern is without any search: null where only a fuzzy search can tell."""
    at = F.least(F.greatest(place, F.lit(0)), F.length(text))
    return (
        F.when(text == pattern, 0)
        .when(F.length(text) == 0, -1)
        .when(F.substr(text, at + 1, F.length(pattern)) == pattern, at)
        .otherwise(F.lit(None))
        .cast("int")
    )
