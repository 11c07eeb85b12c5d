"""The comparison's known results, and properties that hold for any texts.

Fixed values: the texts, diffs, deltas, places and patches in this file pin results that must be equal.
"""

import random
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.config import DEFAULT, EXACT, Config
from lexweave.core import codec, locate, patches, search, segments, tidy
from lexweave.core.segments import DELETE, EQUAL, INSERT


def e(t):
    return (EQUAL, t)


def d(t):
    return (DELETE, t)


def i(t):
    return (INSERT, t)


@pytest.mark.parametrize(("a", "b", "n"), [("abc", "xyz", 0), ("1234abcdef", "1234xyz", 4), ("1234", "1234xyz", 4), ("", "", 0)])
def test_common_prefix_and_suffix(a, b, n):
    assert segments.common_prefix(a, b) == n
    assert segments.common_suffix(a[::-1], b[::-1]) == n


@pytest.mark.parametrize(("a", "b", "n"), [("", "abcd", 0), ("abc", "abcd", 3), ("123456", "abcd", 0), ("123456xxx", "xxxabcd", 3), ("fi", "ﬁi", 0)])
def test_common_overlap(a, b, n):
    assert segments.common_overlap(a, b) == n


@pytest.mark.parametrize(
    ("a", "b", "parts"),
    [
        ("1234567890", "abcdef", None),
        ("12345", "23", None),
        ("1234567890", "a345678z", ("12", "90", "a", "z", "345678")),
        ("a345678z", "1234567890", ("a", "z", "12", "90", "345678")),
        ("abc56789z", "1234567890", ("abc", "z", "1234", "0", "56789")),
        ("a23456xyz", "1234567890", ("a", "xyz", "1", "7890", "23456")),
        ("121231234123451234123121", "a1234123451234z", ("12123", "123121", "a", "z", "1234123451234")),
        ("x-=-=-=-=-=-=-=-=-=-=-=-=", "xx-=-=-=-=-=-=-=", ("", "-=-=-=-=-=", "x", "", "x-=-=-=-=-=-=-=")),
        ("qHilloHelloHew", "xHelloHeHulloy", ("qHillo", "w", "x", "Hulloy", "HelloHe")),
    ],
)
def test_half_match(a, b, parts):
    assert search.half_match(a, b) == parts


@pytest.mark.parametrize(
    ("a", "b", "coded", "lines"),
    [
        ("alpha\nbeta\nalpha\n", "beta\nalpha\nbeta\n", ["\x01\x02\x01", "\x02\x01\x02"], ["", "alpha\n", "beta\n"]),
        ("", "alpha\r\nbeta\r\n\r\n\r\n", ["", "\x01\x02\x03\x03"], ["", "alpha\r\n", "beta\r\n", "\r\n"]),
        ("a", "b", ["\x01", "\x02"], ["", "a", "b"]),
    ],
)
def test_lines(a, b, coded, lines):
    assert search.to_lines(a, b) == (coded, lines)
    assert search.from_lines([(EQUAL, coded[0]), (INSERT, coded[1])], lines) == [(EQUAL, a), (INSERT, b)]


def test_many_lines():
    text = "".join(f"{k}\n" for k in range(1, 70_000))
    (coded, empty), lines = search.to_lines(text, "")
    assert len(coded) == 69_999 and empty == "" and len(set(coded)) == 69_999
    assert search.from_lines([(DELETE, coded)], lines) == [(DELETE, text)]


MERGE = [
    ([], []),
    ([e("a"), d("b"), i("c")], [e("a"), d("b"), i("c")]),
    ([e("a"), e("b"), e("c")], [e("abc")]),
    ([d("a"), d("b"), d("c")], [d("abc")]),
    ([i("a"), i("b"), i("c")], [i("abc")]),
    ([d("a"), i("b"), d("c"), i("d"), e("e"), e("f")], [d("ac"), i("bd"), e("ef")]),
    ([d("a"), i("abc"), d("dc")], [e("a"), d("d"), i("b"), e("c")]),
    ([e("x"), d("a"), i("abc"), d("dc"), e("y")], [e("xa"), d("d"), i("b"), e("cy")]),
    ([e("a"), i("ba"), e("c")], [i("ab"), e("ac")]),
    ([e("c"), i("ab"), e("a")], [e("ca"), i("ba")]),
    ([e("a"), d("b"), e("c"), d("ac"), e("x")], [d("abc"), e("acx")]),
    ([e("x"), d("ca"), e("c"), d("b"), e("a")], [e("xca"), d("cba")]),
]
LOSSLESS = [
    ([], []),
    ([e("AAA\r\n\r\nBBB"), i("\r\nDDD\r\n\r\nBBB"), e("\r\nEEE")], [e("AAA\r\n\r\n"), i("BBB\r\nDDD\r\n\r\n"), e("BBB\r\nEEE")]),
    ([e("AAA\r\nBBB"), i(" DDD\r\nBBB"), e(" EEE")], [e("AAA\r\n"), i("BBB DDD\r\n"), e("BBB EEE")]),
    ([e("The c"), i("ow and the c"), e("at.")], [e("The "), i("cow and the "), e("cat.")]),
    ([e("The-c"), i("ow-and-the-c"), e("at.")], [e("The-"), i("cow-and-the-"), e("cat.")]),
    ([e("a"), d("a"), e("ax")], [d("a"), e("aax")]),
    ([e("xa"), d("a"), e("a")], [e("xaa"), d("a")]),
    ([e("The xxx. The "), i("zzz. The "), e("yyy.")], [e("The xxx."), i(" The zzz."), e(" The yyy.")]),
]
SEMANTIC = [
    ([], []),
    ([d("ab"), i("cd"), e("12"), d("e")], [d("ab"), i("cd"), e("12"), d("e")]),
    ([d("abc"), i("ABC"), e("1234"), d("wxyz")], [d("abc"), i("ABC"), e("1234"), d("wxyz")]),
    ([d("a"), e("b"), d("c")], [d("abc"), i("b")]),
    ([d("ab"), e("cd"), d("e"), e("f"), i("g")], [d("abcdef"), i("cdfg")]),
    ([i("1"), e("A"), d("B"), i("2"), e("_"), i("1"), e("A"), d("B"), i("2")], [d("AB_AB"), i("1A2_1A2")]),
    ([e("The c"), d("ow and the c"), e("at.")], [e("The "), d("cow and the "), e("cat.")]),
    ([d("abcxx"), i("xxdef")], [d("abcxx"), i("xxdef")]),
    ([d("abcxxx"), i("xxxdef")], [d("abc"), e("xxx"), i("def")]),
    ([d("xxxabc"), i("defxxx")], [i("def"), e("xxx"), d("abc")]),
    ([d("abcd1212"), i("1212efghi"), e("----"), d("A3"), i("3BC")], [d("abcd"), e("1212"), i("efghi"), e("----"), d("A"), e("3"), i("BC")]),
]
EFFICIENCY = [
    (4, [], []),
    (4, [d("ab"), i("12"), e("wxyz"), d("cd"), i("34")], [d("ab"), i("12"), e("wxyz"), d("cd"), i("34")]),
    (4, [d("ab"), i("12"), e("xyz"), d("cd"), i("34")], [d("abxyzcd"), i("12xyz34")]),
    (4, [i("12"), e("x"), d("cd"), i("34")], [d("xcd"), i("12x34")]),
    (4, [d("ab"), i("12"), e("xy"), i("34"), e("z"), d("cd"), i("56")], [d("abxyzcd"), i("12xy34z56")]),
    (5, [d("ab"), i("12"), e("wxyz"), d("cd"), i("34")], [d("abwxyzcd"), i("12wxyz34")]),
]


@pytest.mark.parametrize(("before", "after"), MERGE)
def test_merge(before, after):
    assert tidy.merge(before) == after


@pytest.mark.parametrize(("before", "after"), LOSSLESS)
def test_lossless(before, after):
    assert tidy.lossless(before) == after


@pytest.mark.parametrize(("before", "after"), SEMANTIC)
def test_semantic(before, after):
    assert tidy.semantic(before) == after


@pytest.mark.parametrize(("cost", "before", "after"), EFFICIENCY)
def test_efficiency(cost, before, after):
    assert tidy.efficiency(before, cost) == after


JUMP = [e("jump"), d("s"), i("ed"), e(" over "), d("the"), i("a"), e(" lazy"), i("old dog")]


def test_texts_and_positions():
    assert segments.source(JUMP) == "jumps over the lazy"
    assert segments.target(JUMP) == "jumped over a lazyold dog"
    assert segments.map_position([d("a"), i("1234"), e("xyz")], 2) == 5
    assert segments.map_position([e("a"), d("1234"), e("xyz")], 3) == 1
    assert segments.edit_cost([d("abc"), i("1234"), e("xyz")]) == 4
    assert segments.edit_cost([e("xyz"), d("abc"), i("1234")]) == 4
    assert segments.edit_cost([d("abc"), e("xyz"), i("1234")]) == 7


def test_delta():
    delta = codec.to_delta(JUMP)
    assert delta == "=4\t-1\t+ed\t=6\t-3\t+a\t=5\t+old dog"
    source = segments.source(JUMP)
    assert codec.from_delta(source, delta) == JUMP
    for text, bad in ((source + "x", delta), (source[1:], delta), ("", "+%c3%xy"), ("", "?1"), ("ab", "=x"), ("ab", "=-2")):
        with pytest.raises(ValueError):
            codec.from_delta(text, bad)
    odd = [e("ڀ \x00 \t %"), d("ځ \x01 \n ^"), i("ڂ \x02 \\ |")]
    assert codec.to_delta(odd) == "=7\t-7\t+%DA%82 %02 %5C %7C"
    assert codec.from_delta(segments.source(odd), codec.to_delta(odd)) == odd
    plain = "A-Z a-z 0-9 - _ . ! ~ * ' ( ) ; / ? : @ & = + $ , # "
    assert codec.to_delta([i(plain)]) == "+" + plain
    assert codec.from_delta("", "+" + plain) == [i(plain)]
    assert codec.from_delta("abc", "=2\t\t-1") == [e("ab"), d("c")]
    assert codec.unescape("%2f%41%C3%A9") == "%2fAé"


def test_middle():
    run = lambda budget: search.diff("cat", "map", False, Config(budget=budget))
    assert run(None) == [d("c"), i("m"), e("a"), d("t"), i("p")]
    assert run(0) == [d("cat"), i("map")]


MAIN = [
    ("", "", []),
    ("abc", "abc", [e("abc")]),
    ("abc", "ab123c", [e("ab"), i("123"), e("c")]),
    ("a123bc", "abc", [e("a"), d("123"), e("bc")]),
    ("abc", "a123b456c", [e("a"), i("123"), e("b"), i("456"), e("c")]),
    ("a123b456c", "abc", [e("a"), d("123"), e("b"), d("456"), e("c")]),
    ("a", "b", [d("a"), i("b")]),
    ("Apples are a fruit.", "Bananas are also fruit.", [d("Apple"), i("Banana"), e("s are a"), i("lso"), e(" fruit.")]),
    ("ax\t", "ڀx\0", [d("a"), i("ڀ"), e("x"), d("\t"), i("\0")]),
    ("1ayb2", "abxab", [d("1"), e("a"), d("y"), e("b"), d("2"), i("xab")]),
    ("abcy", "xaxcxabc", [i("xaxcx"), e("abc"), d("y")]),
    (
        "ABCDa=bcd=efghijklmnopqrsEFGHIJKLMNOefg",
        "a-bcd-efghijklmnopqrs",
        [d("ABCD"), e("a"), d("="), i("-"), e("bcd"), d("="), i("-"), e("efghijklmnopqrs"), d("EFGHIJKLMNOefg")],
    ),
    ("a [[Pennsylvania]] and [[New", " and [[Pennsylvania]]", [i(" "), e("a"), i("nd"), e(" [[Pennsylvania]]"), d(" and [[New")]),
]


@pytest.mark.parametrize(("a", "b", "diff"), MAIN)
def test_diff(a, b, diff):
    assert search.diff(a, b, False, EXACT) == diff


def test_line_mode():
    ones, letters = "1234567890\n" * 13, "abcdefghij\n" * 13
    assert search.diff(ones, letters, False, EXACT) == search.diff(ones, letters, True, EXACT)
    assert search.diff("1234567890" * 13, "abcdefghij" * 13, False, EXACT) == search.diff("1234567890" * 13, "abcdefghij" * 13, True, EXACT)
    mixed = ("abcdefghij\n" + "1234567890\n" * 3) * 3 + "abcdefghij\n"
    for lines in (True, False):
        found = search.diff(ones, mixed, lines, EXACT)
        assert (segments.source(found), segments.target(found)) == (ones, mixed)
    with pytest.raises(ValueError):
        search.diff(None, "a")


def test_budget_ends_a_long_search():
    a = "`Twas brillig, and the slithy toves\nDid gyre and gimble in the wabe:\n" * 512
    b = "I am the very model of a modern major general,\nI know the kings of England\n" * 512
    found = search.diff(a, b, True, Config(budget=1000))
    assert (segments.source(found), segments.target(found)) == (a, b)


def test_alphabet():
    assert locate.alphabet("abc") == {"a": 4, "b": 2, "c": 1}
    assert locate.alphabet("abcaba") == {"a": 37, "b": 18, "c": 8}


@pytest.mark.parametrize(
    ("text", "pattern", "place", "threshold", "distance", "found"),
    [
        ("abcdefghijk", "fgh", 5, 0.5, 100, 5),
        ("abcdefghijk", "fgh", 0, 0.5, 100, 5),
        ("abcdefghijk", "efxhi", 0, 0.5, 100, 4),
        ("abcdefghijk", "cdefxyhijk", 5, 0.5, 100, 2),
        ("abcdefghijk", "bxy", 1, 0.5, 100, -1),
        ("123456789xx0", "3456789x0", 2, 0.5, 100, 2),
        ("abcdefghijk", "efxyhi", 1, 0.4, 100, 4),
        ("abcdefghijk", "efxyhi", 1, 0.3, 100, -1),
        ("abcdefghijk", "bcdef", 1, 0.0, 100, 1),
        ("abcdexyzabcde", "abccde", 3, 0.5, 100, 0),
        ("abcdexyzabcde", "abccde", 5, 0.5, 100, 8),
        ("abcdefghijklmnopqrstuvwxyz", "abcdefg", 24, 0.5, 10, -1),
        ("abcdefghijklmnopqrstuvwxyz", "abcdxxefg", 1, 0.5, 10, 0),
        ("abcdefghijklmnopqrstuvwxyz", "abcdefg", 24, 0.5, 1000, 0),
    ],
)
def test_fuzzy(text, pattern, place, threshold, distance, found):
    assert locate.fuzzy(text, pattern, place, Config(match_threshold=threshold, match_distance=distance)) == found


@pytest.mark.parametrize(
    ("text", "pattern", "place", "found"),
    [
        ("abcdef", "abcdef", 1000, 0),
        ("", "abcdef", 1, -1),
        ("abcdef", "", 3, 3),
        ("abcdef", "de", 3, 3),
        ("abcdef", "defy", 4, 3),
        ("abcdef", "abcdefy", 0, 0),
        ("I am the very model of a modern major general.", " that berry ", 5, 4),
    ],
)
def test_locate(text, pattern, place, found):
    assert locate.locate(text, pattern, place) == found


def test_locate_refuses():
    with pytest.raises(ValueError):
        locate.locate(None, "a", 0)
    with pytest.raises(ValueError):
        locate.locate("a" * 50, "b" * 33, 0)


#: Patches are made and applied without shortcuts by half matches, as their known results were.
PLAIN = replace(DEFAULT, budget=None, half_match=False)


def test_patch_text():
    p = patches.Patch([e("jump"), d("s"), i("ed"), e(" over "), d("the"), i("a"), e("\nlaz")], 20, 21, 18, 17)
    text = "@@ -21,18 +22,17 @@\n jump\n-s\n+ed\n  over \n-the\n+a\n %0Alaz\n"
    assert str(p) == text
    for t in (
        text,
        "@@ -1 +1 @@\n-a\n+b\n",
        "@@ -1,3 +0,0 @@\n-abc\n",
        "@@ -0,0 +1,3 @@\n+abc\n",
        "@@ -21,18 +22,17 @@\n jump\n-s\n+ed\n  over \n-the\n+a\n  laz\n",
        "@@ -1,9 +1,9 @@\n-f\n+F\n oo+fooba\n@@ -7,9 +7,9 @@\n obar\n-,\n+.\n  tes\n",
    ):
        assert patches.to_text(patches.from_text(t)) == t
    assert patches.from_text("") == []
    for bad in ("Bad\nPatch\n", "@@ -1 +1 @@\n?x\n", "@@ -1 +1 @@\n+%zz\n"):
        with pytest.raises(ValueError):
            patches.from_text(bad)


@pytest.mark.parametrize(
    ("patch", "text", "grown"),
    [
        ("@@ -21,4 +21,10 @@\n-jump\n+somersault\n", "The quick brown fox jumps over the lazy dog.", "@@ -17,12 +17,18 @@\n fox \n-jump\n+somersault\n s ov\n"),
        ("@@ -21,4 +21,10 @@\n-jump\n+somersault\n", "The quick brown fox jumps.", "@@ -17,10 +17,16 @@\n fox \n-jump\n+somersault\n s.\n"),
        ("@@ -3 +3,2 @@\n-e\n+at\n", "The quick brown fox jumps.", "@@ -1,7 +1,8 @@\n Th\n-e\n+at\n  qui\n"),
        ("@@ -3 +3,2 @@\n-e\n+at\n", "The quick brown fox jumps.  The quick brown fox crashes.", "@@ -1,27 +1,28 @@\n Th\n-e\n+at\n  quick brown fox jumps. \n"),
    ],
)
def test_context(patch, text, grown):
    assert str(patches.add_context(patches.from_text(patch)[0], text)) == grown


FOX, FOX2 = "The quick brown fox jumps over the lazy dog.", "That quick brown fox jumped over a lazy dog."
THERE = "@@ -1,11 +1,12 @@\n Th\n-e\n+at\n  quick b\n@@ -22,18 +22,17 @@\n jump\n-s\n+ed\n  over \n-the\n+a\n  laz\n"


def test_make():
    assert patches.make("", "", PLAIN) == []
    assert patches.to_text(patches.make(FOX2, FOX, PLAIN)) == "@@ -1,8 +1,7 @@\n Th\n-at\n+e\n  qui\n@@ -21,17 +21,18 @@\n jump\n-ed\n+s\n  over \n-a\n+the\n  laz\n"
    assert patches.to_text(patches.make(FOX, FOX2, PLAIN)) == THERE
    found = search.diff(FOX, FOX2, False, PLAIN)
    assert patches.to_text(patches.from_diff(found)) == THERE
    assert patches.to_text(patches.from_diff(found, FOX)) == THERE
    keys, shifted = "`1234567890-=[]\\;',./", '~!@#$%^&*()_+{}|:"<>?'
    text = "@@ -1,21 +1,21 @@\n-%601234567890-=%5B%5D%5C;',./\n+~!@#$%25%5E&*()_+%7B%7D%7C:%22%3C%3E?\n"
    assert patches.to_text(patches.make(keys, shifted, PLAIN)) == text
    assert patches.from_text(text)[0].diffs == [d(keys), i(shifted)]
    long = "abcdef" * 100
    assert patches.to_text(patches.make(long, long + "123", PLAIN)) == "@@ -573,28 +573,31 @@\n cdefabcdefabcdefabcdefabcdef\n+123\n"


def test_split():
    def pieces(a, b):
        return patches.to_text(patches.split(patches.make(a, b, PLAIN), PLAIN))

    assert pieces("abcdefghijklmnopqrstuvwxyz01234567890", "XabXcdXefXghXijXklXmnXopXqrXstXuvXwxXyzX01X23X45X67X89X0") == (
        "@@ -1,32 +1,46 @@\n+X\n ab\n+X\n cd\n+X\n ef\n+X\n gh\n+X\n ij\n+X\n kl\n+X\n mn\n+X\n op\n+X\n qr\n+X\n st\n+X\n uv\n+X\n wx\n+X\n yz\n+X\n 012345\n"
        "@@ -25,13 +39,18 @@\n zX01\n+X\n 23\n+X\n 45\n+X\n 67\n+X\n 89\n+X\n 0\n"
    )
    a, b = "abcdef" + "1234567890" * 7 + "uvwxyz", "abcdefuvwxyz"
    assert pieces(a, b) == patches.to_text(patches.make(a, b, PLAIN))
    assert pieces("1234567890" * 7, "abc") == (
        "@@ -1,32 +1,4 @@\n-1234567890123456789012345678\n 9012\n@@ -29,32 +1,4 @@\n-9012345678901234567890123456\n 7890\n@@ -57,14 +1,3 @@\n-78901234567890\n+abc\n"
    )
    h = "abcdefghij , h : {} , t : 1 abcdefghij , h : {} , t : 1 abcdefghij , h : 0 , t : 1"
    assert pieces(h.format(0, 0), h.format(1, 1)) == (
        "@@ -2,32 +2,32 @@\n bcdefghij , h : \n-0\n+1\n  , t : 1 abcdef\n@@ -29,32 +29,32 @@\n bcdefghij , h : \n-0\n+1\n  , t : 1 abcdef\n"
    )


@pytest.mark.parametrize(
    ("a", "b", "made", "padded"),
    [
        ("", "test", "@@ -0,0 +1,4 @@\n+test\n", "@@ -1,8 +1,12 @@\n %01%02%03%04\n+test\n %01%02%03%04\n"),
        ("XY", "XtestY", "@@ -1,2 +1,6 @@\n X\n+test\n Y\n", "@@ -2,8 +2,12 @@\n %02%03%04X\n+test\n Y%01%02%03\n"),
        ("XXXXYYYY", "XXXXtestYYYY", "@@ -1,8 +1,12 @@\n XXXX\n+test\n YYYY\n", "@@ -5,8 +5,12 @@\n XXXX\n+test\n YYYY\n"),
    ],
)
def test_pad(a, b, made, padded):
    some = patches.make(a, b, PLAIN)
    assert patches.to_text(some) == made
    assert patches.to_text(patches.pad(some)[1]) == padded
    assert patches.to_text(some) == made


LONG = "x" + "1234567890" * 7 + "y"
FAR = "x12345678901234567890---------------++++++++++---------------12345678901234567890y"


@pytest.mark.parametrize(
    ("a", "b", "text", "config", "result"),
    [
        ("", "", "Hello world.", PLAIN, ("Hello world.", [])),
        (FOX, FOX2, FOX, PLAIN, (FOX2, [True, True])),
        (FOX, FOX2, "The quick red rabbit jumps over the tired tiger.", PLAIN, ("That quick red rabbit jumped over a tired tiger.", [True, True])),
        (FOX, FOX2, "I am the very model of a modern major general.", PLAIN, ("I am the very model of a modern major general.", [False, False])),
        (LONG, "xabcy", "x123456789012345678901234567890-----++++++++++-----123456789012345678901234567890y", PLAIN, ("xabcy", [True, True])),
        (LONG, "xabcy", FAR, PLAIN, ("xabc12345678901234567890---------------++++++++++---------------12345678901234567890y", [False, True])),
        (LONG, "xabcy", FAR, replace(PLAIN, patch_delete_threshold=0.6), ("xabcy", [True, True])),
        (
            "abcdefghijklmnopqrstuvwxyz--------------------1234567890",
            "abcXXXXXXXXXXdefghijklmnopqrstuvwxyz--------------------1234567YYYYYYYYYY890",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ--------------------1234567890",
            replace(PLAIN, match_threshold=0.0, match_distance=0),
            ("ABCDEFGHIJKLMNOPQRSTUVWXYZ--------------------1234567YYYYYYYYYY890", [False, True]),
        ),
        ("", "test", "", PLAIN, ("test", [True])),
        ("XY", "XtestY", "XY", PLAIN, ("XtestY", [True])),
        ("y", "y123", "x", PLAIN, ("x123", [True])),
    ],
)
def test_apply(a, b, text, config, result):
    some = patches.make(a, b, config)
    before = patches.to_text(some)
    assert patches.apply(some, text, config) == result
    assert patches.to_text(some) == before


TEXTS = st.text(alphabet="ab c.\n", max_size=60)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(TEXTS, TEXTS)
def test_properties(a, b):
    for config in (DEFAULT, EXACT, Config(budget=10)):
        found = search.diff(a, b, True, config)
        for tidied in (found, tidy.merge(found), tidy.semantic(found), tidy.lossless(found), tidy.efficiency(found)):
            assert (segments.source(tidied), segments.target(tidied)) == (a, b)
            assert segments.equal_length(tidied) <= lcs(a, b)
        assert codec.from_delta(a, codec.to_delta(found)) == found
    assert segments.equal_length(search.diff(a, b, False, EXACT)) == lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefgh ", min_size=1, max_size=80), st.text(alphabet="abcdefgh ", min_size=1, max_size=80))
def test_patches_round_trip(a, b):
    some = patches.make(a, b, PLAIN)
    assert patches.to_text(patches.from_text(patches.to_text(some))) == patches.to_text(some)
    assert segments.source(search.diff(a, b)) == a


def test_patches_apply_to_their_source():
    draw = random.Random(5)
    for _ in range(50):
        words = [draw.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) + str(draw.randrange(1000)) for _ in range(60)]
        other = [w if draw.random() > 0.1 else "new" + w for w in words]
        a, b = " ".join(words), " ".join(other)
        assert patches.apply(patches.make(a, b), a)[0] == b


def unrelated(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("etaoinshrdlu \n") for _ in range(n))


@pytest.mark.parametrize(("n", "m"), [(3000, 9000), (3000, 3100), (900, 800), (60, 50)])
def test_a_search_that_can_not_end_takes_no_steps(n, m, monkeypatch):
    """Texts whose scripts are all longer than the budget reaches are told from their lengths, grams or an alignment."""

    def step(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(search, "_step", step)
    a, b = "x" + unrelated(1, n) + "x", "y" + unrelated(2, m) + "y"
    assert search.diff(a, b, False, Config(budget=20_000 if n > 60 else 300)) == [d(a), i(b)]


def test_proof_of_a_long_script_changes_no_diff(monkeypatch):
    """Diffs and what is left of the budget are those of the search that runs until the budget ends."""
    rng, pairs = random.Random(5), []
    for _ in range(250):
        a = unrelated(rng.random(), rng.choice([3, 40, 300, 900]))
        b = list(a) if rng.random() < 0.6 else list(unrelated(rng.random(), rng.choice([3, 40, 300, 900])))
        for _ in range(rng.choice([1, 10, 60])):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(3)] = []
            b.insert(rng.randrange(len(b) + 1), rng.choice("etao\n😀"))
        pairs.append((a, "".join(b), rng.random() < 0.7, rng.choice([0, 1, 2, 7, 300, 3000, 20_000])))

    def run():
        out = []
        for a, b, lines, budget in pairs:
            one = search._Search(Config(budget=budget))
            out.append((one.run(a, b, lines), one.left))
        return out

    got = run()
    monkeypatch.setattr(search, "takes_more_edits", lambda *_: False)
    monkeypatch.setattr(search, "_line_set", lambda text: (0, frozenset([""])))
    assert got == run()


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé😀") for _ in range(rng.randrange(30))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for k, other in enumerate(b):
                new.append(row[k] + 1 if c == other else max(new[k], row[k + 1]))
            row = new
        assert search.common_subsequence(a, b) == row[-1]
        n = len(a) + len(b) - 2 * row[-1]
        assert not search.takes_more_edits(a, b, n) and search.takes_more_edits(a, b, n - 1)


@given(st.text("ab", max_size=12), st.text("ab", max_size=12))
def test_overlaps_of_half_are_never_missed(a, b):
    n = segments.common_overlap(a, b)
    if 2 * n >= min(len(a), len(b)):
        assert tidy._half_overlaps(a, b)


def test_an_unrelated_document_is_scored_without_a_search(monkeypatch):
    """Invented prose against all licences, as the queries of the diff score compare them."""
    from lexweave.operators import score
    from lexweave.sources import catalog

    monkeypatch.setattr(search, "_step", None)
    rng = random.Random(3)
    words = ["".join(rng.choice("bdgkmnprstaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    document = catalog.normalize("".join(rng.choice(words) + rng.choice([" "] * 9 + [". "]) for _ in range(600)))
    assert all(segments.equal_length(score.compare(document, catalog.normalize(r[4]))) < 10 for r in catalog.rows())


def test_an_unrelated_document_is_not_looked_up_in_the_licences(monkeypatch):
    """Where no line is common and all are short, no long part can be; one replacement is neither merged nor tidied."""
    from lexweave.operators import score
    from lexweave.sources import catalog

    for module, name in ((search, "half_match"), (search, "half_overlap"), (search, "merge"), (tidy, "_dissolved")):
        monkeypatch.setattr(module, name, None)
    rng = random.Random(4)
    words = ["".join(rng.choice("bdgkmnprstaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    document = catalog.normalize("".join(rng.choice(words) + (". " if k % 8 == 7 else " ") for k in range(1200)))
    assert all(segments.equal_length(score.compare(document, catalog.normalize(r[4]))) < 10 for r in catalog.rows())


def test_what_short_lines_prove_changes_no_diff(monkeypatch):
    """Diffs and what is left of the budget are those without the proof, also where long parts are common."""
    rng, pairs = random.Random(8), []
    for _ in range(400):
        one, other, common = ("".join(rng.choice("etao" * 6 + "\n") for _ in range(rng.choice([60, 150, 400]))) for _ in range(3))
        for a, b in ((one + common, common + other), (one + common + other, common), (one, other), (one + common + one, other + common + other)):
            pairs.append((a, b, rng.choice([0, 7, 300, 3000, 20_000])))

    def run():
        out = []
        for a, b, budget in pairs:
            search_ = search._Search(Config(budget=budget))
            out.append((search_.run(a, b, True), search_.left))
        return out

    got, proven = run(), 0

    def not_proven(*args, only_short_parts=search._only_short_parts):
        nonlocal proven
        proven += only_short_parts(*args)
        return False

    monkeypatch.setattr(search, "_only_short_parts", not_proven)
    monkeypatch.setattr(search, "half_overlap", lambda *_: True)
    assert got == run() and 50 < proven < len(pairs) / 2
