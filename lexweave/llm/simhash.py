"""SimHash near-dedup with multi-index hashing.

Fingerprints. A text's words (runs of other than white space, A-Z lower-cased) make shingles of `shingle` words, repeats
included; a bit of the fingerprint is 1 if it is set in over half the shingles' XXH64 hashes.

Links. Fingerprints, each different one once, are cut into segments. If two differ in at most `distance` bits, then some
segment differs in at most its radius, as long as the radii + 1 add up to more than distance. So each fingerprint is looked up
under every key in the Hamming ball of that radius around each of its segments, and the whole distance of each table match is verified.
A bucket with more than CROWDED_PRINTS fingerprints would be compared with itself; its look-ups instead list the fingerprints that
may match (the ball of the distance left over, around the other bits) and find them by equality: linear, and exact too.
A fingerprint has at most a few thousand others within distance 2, so links stay linear in the number of fingerprints.

Defined cases: fewer words than a shingle make one shingle of all words; no words (also null) make fingerprint zero, linked like any
other. A null doc_id has a fingerprint, but is never the smallest id; its component is null if no other id is in it. Rows that share
a doc_id are grouped each by its own text. Texts are read whole. Other columns, whatever their names, are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_batches, map_stream, whole_groups
from .exact_dedup import hit_filter
from .graph import components

SEED = 42
#: (first bit, bits, radius) of the segments: radii 1 and 0 prove distance 2, as (1 + 1) + (0 + 1) > 2.
SEGMENTS = ((0, 32, 1), (32, 32, 0))
CROWDED_PRINTS = 2000
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):  # a bounded number of bits at a time, however long the text
        ones += np.unpackbits(hashes[at : at + _STEP].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    Scratch(docs.sparkSession, "simhash")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.record_batch([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _ball(first: int, bits: int, radius: int) -> list[int]:
    """Masks of at most radius bits in a segment."""
    places = range(first, first + bits)
    return [_signed(sum(1 << p for p in some)) for r in range(radius + 1) for some in combinations(places, r)]


def _key(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit(_signed((1 << bits) - 1)))


def links(distinct: DataFrame, distance: int = 2, segments=SEGMENTS, crowd: int = CROWDED_PRINTS) -> DataFrame:
    """(a, b), a < b: the pairs of different fingerprints fp within distance; distinct has each fp once."""
    if sum(r + 1 for _, _, r in segments) <= distance:
        raise ValueError("the radii do not prove the distance")
    scratch = Scratch(distinct.sparkSession, "simhash-links")
    fp = F.col("fp")
    entries, probes = [], []
    for k, (first, bits, radius) in enumerate(segments):
        entries.append(F.struct(F.lit(k).alias("segment"), _key(fp, first, bits).alias("key"), F.lit(0).alias("off")))
        for mask in _ball(first, bits, radius):
            probes.append(F.struct(F.lit(k).alias("segment"), _key(fp.bitwiseXOR(F.lit(mask)), first, bits).alias("key"), F.lit(bin(mask & (1 << 64) - 1).count("1")).alias("off")))
    entry = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*entries)).alias("e")).select("b", "e.segment", "e.key")
    probe = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*probes)).alias("e")).select("a", "e.segment", "e.key", "e.off")
    crowded = scratch.keep(entry.groupBy("segment", "key").count().filter(F.col("count") > crowd).select("segment", "key"), "crowded")
    within = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    if crowded.isEmpty():
        found = probe.join(entry, ["segment", "key"]).filter(within).select("a", "b")
        return found.distinct()
    calm = probe.join(crowded, ["segment", "key"], "left_anti").join(entry, ["segment", "key"]).filter(within).select("a", "b")
    crowd_probe = probe.join(crowded, ["segment", "key"], "left_semi")
    listed = None
    for k, (first, bits, radius) in enumerate(segments):
        own = _signed(((1 << bits) - 1) << first)
        rest = [p for p in range(64) if not first <= p < first + bits]
        for off in range(radius + 1):
            masks = [_signed(sum(1 << p for p in some)) for r in range(distance - off + 1) for some in combinations(rest, r)]
            some = crowd_probe.filter((F.col("segment") == k) & (F.col("off") == off))
            base = F.col("a").bitwiseAND(F.lit(~own)).bitwiseOR(F.shiftleft("key", first))
            some = some.select("a", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: base.bitwiseXOR(m))).alias("b"))
            listed = some if listed is None else listed.unionAll(some)
    exact = listed.filter("a < b").join(distinct.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b")
    return calm.unionAll(exact).distinct()


def near_dedup(prints: DataFrame, distance: int = 2, segments=SEGMENTS, crowd: int = CROWDED_PRINTS) -> DataFrame:
    """doc_id, fp, component_id of each row of prints (doc_id, fp)."""
    scratch = Scratch(prints.sparkSession, "simhash")
    prints = scratch.keep(prints, "prints")
    groups = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(groups.select("fp"), distance, segments, crowd))
    classes = scratch.keep(groups.join(found, groups["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("class")), "classes")
    lowest = classes.groupBy("class").agg(F.min("first").alias("component_id"))
    return prints.join(classes.join(lowest, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Wide fingerprints: near copies of a given similarity, where 64 bits can't tell them apart
#
# The same method, multi-index hashing, over fingerprints of 512 bits of the set of shingles. Texts of similarity 0.8 differ in 78 of
# them on average, so no ball of a size worth listing proves that distance; there are as many segments as find a pair of just
# the least similarity with probability RECALL (computed, and measured in the README). The steps:
#
# 1. texts of equal sets of shingles are one node;
# 2. nodes that agree in a segment and STAR_BITS more bits are compared with one node of their bucket, and each node with one node of
#    any class that fills a bucket it can see: a few pairs a node, which join most of a large group. Pairs within ALIKE bits
#    also make classes of nodes that are alike, copies or not (texts that fill in one form, say);
# 3. a class of more than CROWD nodes is compared in full, block by block, dealt to many tasks, which hand on links only;
# 4. each node is looked up under all keys of the Hamming ball of radius 1 around its segments, in batches of segments. The
#    table matches are compared where they are found, but for those of one component or of one such class, and components are
#    joined after each batch.
#
# Every match is verified by its whole distance and then by the exact Jaccard similarity. A component or class that fills a bucket is
# kept apart there, so its own pairs are never met: a group of g nodes costs about g pairs. Nothing is capped. What grows with
# the square of a group's size is the comparison of nodes that are alike but no copies (step 3); it lists no pairs.

#: 64-bit words of a wide fingerprint, of which SKETCH travel with each look-up; the recall aimed at for pairs of just the least similarity.
WIDE_WORDS, SKETCH, RECALL = 8, 2, 0.95
WIDE_BITS = 64 * WIDE_WORDS
#: Nodes of a segment's bucket, as a power of 2, where fingerprints are random; bits more that nodes compared in step 2 agree in.
FILL_BITS, STAR_BITS = 5, 7
#: Nodes of one component from which a bucket keeps it apart; segments at least, and of a batch.
CROWDED, LEAST_SEGMENTS, TOGETHER = 64, 6, 6
#: Share of the bits in which nodes that are alike may differ (a similarity of about 0.55); nodes of a class from which it is
#: compared block by block, and of a block.
ALIKE, CROWD, BLOCK = 0.25, 256, 1024
WORDS = [f"f{k}" for k in range(WIDE_WORDS)]
_SPREAD = np.random.default_rng(97).integers(1, 1 << 63, WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bits_apart(similarity: float) -> float:
    """The share of bits in which fingerprints of texts of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_apart(similarity: float, bits: int) -> int:
    """Of so many bits, those in which texts of this similarity differ at most: the mean and three standard deviations."""
    share = bits_apart(similarity)
    return math.ceil(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def segment_plan(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a segment, number of segments) for n fingerprints.

    A segment finds a pair that differs in at most one of its bits. The number of differing bits in the whole fingerprint varies
    from pair to pair (binomially); the recall is the mean over it, and pairs beyond most_apart() count as lost.
    """
    bits = min(40, max(8, math.ceil(math.log2(max(2, n))) - FILL_BITS))
    share, choose = bits_apart(similarity), math.comb
    most = most_apart(similarity, WIDE_BITS)
    weight = [choose(WIDE_BITS, d) * share**d * (1 - share) ** (WIDE_BITS - d) for d in range(most + 1)]
    hit = [(choose(WIDE_BITS - bits, d) + bits * choose(WIDE_BITS - bits, d - 1 if d else 0) * (d > 0)) / choose(WIDE_BITS, d) for d in range(most + 1)]
    number = LEAST_SEGMENTS
    while sum(w * (1 - (1 - h) ** number) for w, h in zip(weight, hit, strict=True)) < recall:
        number += 1
    return bits, number


def segment_bits(bits: int, number: int) -> np.ndarray:
    """The places of the bits of each segment, and of the STAR_BITS after them: disjoint segments of one order of all bits, then of the next."""
    draw, out = np.random.default_rng(5), []
    while len(out) < number:
        order = draw.permutation(WIDE_BITS)
        out += [np.take(order, range(k, k + bits + STAR_BITS), mode="wrap") for k in range(0, WIDE_BITS - bits + 1, bits)]
    return np.array(out[:number])


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of shingles, as sorted XXH64 hashes; empty without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(p, SEED) for p in parts), "<u8", max(1, len(words) - shingle + 1)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words of the set of shingles; a bit is 1 if it is set in over half of them."""
    ones = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        h = hashes[at : at + (1 << 12), None] * _SPREAD
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view("<i8")


def wide_fingerprints(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (of the text), digest (of the set of shingles), and the WORDS of its fingerprint."""
    Scratch(docs.sparkSession, "simhash")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, shingle) for t in batch.column(2).to_pylist()]
        prints = np.stack([wide_fingerprint(s) for s in sets]) if sets else np.zeros((0, WIDE_WORDS), np.int64)
        return pa.record_batch([*batch.columns[:2], pa.array(map(_digest, sets), pa.binary()), *map(pa.array, prints.T.copy())], names=["doc_id", "sha", "digest", *WORDS])

    schema = "doc_id long, sha string, digest binary, " + ", ".join(f"{w} long" for w in WORDS)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), _sha(text).alias("sha"), text.alias("text")), run, schema)


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, hashes (the set of shingles)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_hashes(t, shingle) for t in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return pa.record_batch([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "digest", "hashes"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, digest binary, hashes array<long>")


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _entries(nodes: DataFrame, plan: tuple[int, int], tables: range, radius: int) -> DataFrame:
    """Of nodes (id, part, WORDS), a row for each key in the balls around these segments: key, star, off, id, part, s0, s1. part is any class.

    Of two fingerprints that differ in one bit of a segment one has a 0 there, so a ball of radius 1 lists only keys with a 0 turned to 1.
    """
    places = segment_bits(*plan)
    bits = plan[0]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = np.column_stack([batch.column(w).to_numpy() for w in WORDS]) if len(batch) else np.zeros((0, WIDE_WORDS), np.int64)
        one = np.unpackbits(words.view(np.uint8).reshape(len(batch), -1), axis=1)
        keys, stars, offs, rows = [], [], [], []
        for k in tables:
            own = one[:, places[k]].astype(np.int64)
            key, table = own[:, :bits] @ (1 << np.arange(bits)), k << 48
            star = key | own[:, bits:] @ (1 << np.arange(bits, bits + STAR_BITS))
            keys.append(key | table)
            stars.append(star | table)
            offs.append(np.zeros(len(key), np.int32))
            rows.append(np.arange(len(key)))
            for j in range(bits if radius else 0):
                zero = np.flatnonzero(own[:, j] == 0)
                keys.append(key[zero] + (1 << j) | table)
                stars.append(np.full(len(zero), -1))
                offs.append(np.ones(len(zero), np.int32))
                rows.append(zero)
        at = pa.array(np.concatenate(rows))
        more = [batch.column(name).take(at) for name in ("id", "part", *WORDS[:SKETCH])]
        return pa.record_batch([*(pa.array(np.concatenate(x)) for x in (keys, stars, offs)), *more], names=["key", "star", "off", "id", "part", "s0", "s1"])

    return map_batches(nodes.select("id", "part", *WORDS), run, "key long, star long, off int, id long, part long, s0 long, s1 long")


def _differ(left: list[Column], right: list[Column]) -> Column:
    counts = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(left, right, strict=True)]
    return sum(counts[1:], counts[0])


class NearCopies:
    """Components of texts whose sets of shingles are similar."""

    def __init__(self, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"):
        self.scratch, self.similarity = Scratch(docs.sparkSession, "near-copies"), similarity
        self.docs, self.shingle, self.id, self.text = docs, shingle, id_col, text_col
        # bits of a sketch in which nodes that are close, and those that are alike, differ at most
        self.close, self.alike = most_apart(similarity, 64 * SKETCH), int(1.25 * ALIKE * 64 * SKETCH)
        self.prints = self.scratch.keep(wide_fingerprints(docs, shingle, id_col, text_col).filter("doc_id is not null"), "prints")
        groups = self.prints.groupBy("digest").agg(F.min("doc_id").alias("first"), *(F.min(w).alias(w) for w in WORDS))
        self.groups = self.scratch.keep(groups.withColumn("id", F.monotonically_increasing_id()), "distinct")
        self.nodes = self.groups.select("id", F.col("id").alias("part"), F.col("id").alias("alike"), *WORDS)
        self.plan = segment_plan(self.groups.count(), similarity)

    def _sets(self, ids: DataFrame) -> DataFrame:
        """id, hashes of these nodes. Only documents that may be among them are read and cut into shingles again."""
        of = self.scratch.keep(self.groups.select("id", "digest", F.col("first").alias("doc_id")).join(ids, "id", "left_semi"), "ends")
        may_be = hit_filter(of, F.col("doc_id"), of.count())(F.col(self.id).cast("long"))
        sets = shingle_sets(self.docs.filter(may_be), self.shingle, self.id, self.text)
        return sets.join(of, ["digest", "doc_id"]).select("id", "hashes").dropDuplicates(["id"])

    def _measured(self, pairs: DataFrame, most: int) -> DataFrame:
        """a, b, bits: the different pairs whose fingerprints differ in at most so many bits."""
        pairs = self.scratch.keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
        ends = [self.groups.select(F.col("id").alias(end), *(F.col(w).alias(f"{end}_{w}") for w in WORDS)) for end in ("a", "b")]
        both = pairs.join(ends[0], "a").join(ends[1], "b")
        bits = _differ([F.col(f"a_{w}") for w in WORDS], [F.col(f"b_{w}") for w in WORDS])
        out = self.scratch.keep(both.select("a", "b", bits.alias("bits")).filter(F.col("bits") <= most), "close")
        self.scratch.drop(pairs)
        return out

    def _links(self, close: DataFrame) -> DataFrame:
        """a, b: those of measured pairs that are similar."""
        near = close.filter(F.col("bits") <= most_apart(self.similarity, WIDE_BITS)).select("a", "b")
        sets = self.scratch.keep(self._sets(near.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
        out = self.scratch.keep(similar(near, sets, self.similarity), "links")
        self.scratch.drop(sets)
        return out

    def _contract(self, **pairs: DataFrame) -> None:
        """Join the classes of each named column that its pairs (a, b) connect. Only nodes that may be of such a class are shuffled: a filter tells them."""
        nodes, columns = self.nodes, ["id", "part", "alike", *WORDS]
        for column, some in pairs.items():
            now = self.nodes.select("id", column)
            ends = some.select("a", "b").join(now.withColumnsRenamed({"id": "a", column: "x"}), "a").join(now.withColumnsRenamed({"id": "b", column: "y"}), "b")
            found = components(ends.select("x", "y"), "x", "y").withColumnsRenamed({"node": column, "component": "to"})
            if not (n := found.count()):
                continue
            moves = F.coalesce(hit_filter(found, F.col(column), n)(F.col(column)), F.lit(True))
            moved = nodes.filter(moves).join(found, column, "left").withColumn(column, F.coalesce("to", column))
            nodes = nodes.filter(~moves).select(columns).unionByName(moved.select(columns))
        if nodes is not self.nodes:
            self.nodes = self.scratch.keep(nodes, "nodes")

    def _seen_as(self, column: Column, nodes: DataFrame | None = None) -> DataFrame:
        return (nodes or self.nodes).select("id", column.alias("part"), *WORDS)

    def _stars(self) -> DataFrame:
        """(a, b): each node and the first, in a random order, of its bucket under longer keys."""
        rows = _entries(self._seen_as(F.col("part")), self.plan, range(self.plan[1]), 0)
        node = F.struct(F.xxhash64("id", "star").alias("order"), "id", "s0", "s1")
        first = rows.groupBy("star").agg(F.min(node).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("star", "f")
        both = rows.join(first, "star").filter(F.col("id") != F.col("f.id"))
        return both.filter(_differ([F.col("s0"), F.col("s1")], [F.col("f.s0"), F.col("f.s1")]) <= self.alike).select(F.col("id").alias("a"), F.col("f.id").alias("b"))

    def _filled(self, centres: DataFrame) -> DataFrame:
        """key, dom, rep: the class that fills a bucket, if one does, and one of its nodes there."""
        by_part = centres.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "key").alias("order"), "id", "s0", "s1")).alias("rep")).filter(F.col("n") > CROWDED)
        most = by_part.groupBy("key").agg(F.max(F.struct("n", "part", "rep")).alias("x"))
        return self.scratch.keep(most.select("key", F.col("x.part").alias("dom"), F.col("x.rep").alias("rep")), "filled")

    def _to_filled(self) -> DataFrame | None:
        """(a, b): each node and one node of every other class that fills a bucket in its balls."""
        every, nodes = range(self.plan[1]), self._seen_as(F.col("alike"))
        filled = self._filled(_entries(nodes, self.plan, every, 0))
        if filled.isEmpty():
            return None
        both = _entries(nodes, self.plan, every, 1).join(filled, "key").filter("part != dom")
        return both.filter(_differ([F.col("s0"), F.col("s1")], [F.col("rep.s0"), F.col("rep.s1")]) <= self.alike).select(F.col("id").alias("a"), F.col("rep.id").alias("b"))

    def _inside_crowds(self, crowds: DataFrame) -> DataFrame:
        """(a, b): links that connect what all similar pairs inside these classes (alike) connect, but for pairs of one component."""
        sizes = self.nodes.join(crowds, "alike", "left_semi").groupBy("alike", "part").agg(F.count(F.lit(1)).alias("n"))
        sizes = sizes.groupBy("alike").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("all"))
        sizes = sizes.select("alike", F.col("most.part").alias("dom"), F.col("most.n").alias("n_core"), (F.col("all") - F.col("most.n")).alias("n_other")).filter("n_other > 0")
        rows = self.scratch.keep(self.nodes.join(sizes, "alike"), "crowds")
        sets = self._sets(rows.select("id"))
        # blocks of others come first; each meets every block, a block of the largest component only those of others
        others, cores = (F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_other", "n_core"))
        core = F.col("part") == F.col("dom")
        block = F.when(core, others + F.pmod(F.xxhash64("id"), cores)).otherwise(F.pmod(F.xxhash64("id"), others)).cast("int")
        last = F.when(core, others).otherwise(others + cores) - 1
        rows = rows.join(sets, "id").withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        rows = rows.select("alike", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "part", *WORDS, "hashes")
        rows = rows.repartition("alike", "lo", "hi").sortWithinPartitions("alike", "lo", "hi")
        most, similarity = most_apart(self.similarity, WIDE_BITS), self.similarity

        def run(batches):
            for batch, at in whole_groups(batches, ("alike", "lo", "hi")):
                lo, hi, mine, ids, part = (batch.column(k).to_numpy() for k in ("lo", "hi", "mine", "id", "part"))
                words = np.column_stack([batch.column(w).to_numpy() for w in WORDS]).view(np.uint64)
                hashes, ends = batch.column("hashes").flatten().to_numpy(), np.cumsum([0, *batch.column("hashes").value_lengths().to_pylist()])
                a, b = [], []
                for s, e in zip(at, at[1:], strict=False):
                    parts, low = np.unique(part[s:e], return_inverse=True)
                    joined = list(range(len(parts)))

                    def root(x, joined=joined):
                        while joined[x] != x:
                            joined[x] = x = joined[joined[x]]
                        return x

                    left, right = (s + np.flatnonzero(mine[s:e] == side[s]) for side in (lo, hi))
                    for x in left.tolist():
                        to = right[right > x] if lo[s] == hi[s] else right
                        to = to[(part[to] != part[x]) & (np.bitwise_count(words[to] ^ words[x]).sum(1, dtype=np.int32) <= most)]
                        for y in to.tolist():
                            p, q = root(low[x - s]), root(low[y - s])
                            if p != q and jaccard(hashes[ends[x] : ends[x + 1]], hashes[ends[y] : ends[y + 1]], similarity):
                                joined[max(p, q)] = min(p, q)
                                a.append(ids[x])
                                b.append(ids[y])
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        return self.scratch.keep(map_stream(rows, run, "a long, b long"), "links")

    def _matches(self, nodes: DataFrame, tables: range) -> DataFrame:
        """(a, b): all table matches of different classes (part) under these segments whose sketches are close."""
        centres, probes = (_entries(nodes, self.plan, tables, radius) for radius in (0, 1))
        filled = self._filled(centres)
        on = ["key"]
        if not filled.isEmpty():
            filled, on = filled.select("key", "dom"), ["key", "inside"]
            centres = centres.join(filled, "key", "left").withColumn("inside", F.coalesce(F.col("part") == F.col("dom"), F.lit(False)))
            # nodes of the class that fills a bucket look for the others only
            sides = F.when(F.col("dom").isNull() | (F.col("part") == F.col("dom")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
            probes = probes.join(filled, "key", "left").withColumn("inside", F.explode(sides))
        b = centres.select(*on, F.col("id").alias("b"), F.col("part").alias("part_b"), F.col("s0").alias("t0"), F.col("s1").alias("t1"))
        found = probes.withColumnRenamed("id", "a").join(b, on)
        close = _differ([F.col("s0"), F.col("s1")], [F.col("t0"), F.col("t1")]) <= self.close
        return found.filter((F.col("part") != F.col("part_b")) & ((F.col("off") == 1) | (F.col("a") < F.col("b"))) & close).select("a", "b")

    def components(self) -> DataFrame:
        """(doc_id, sha, component_id) of each row with a doc_id; component_id is the smallest doc_id of the group."""
        for step in (self._stars, self._to_filled):
            if (pairs := step()) is not None:
                close = self._measured(pairs, int(ALIKE * WIDE_BITS))
                self._contract(part=self._links(close), alike=close)
        crowds = self.scratch.keep(self.nodes.groupBy("alike").count().filter(F.col("count") > CROWD).select("alike", F.lit(True).alias("crowd")), "big")
        if not crowds.isEmpty():
            self._contract(part=self._inside_crowds(crowds))
        for first in range(0, self.plan[1], TOGETHER):
            seen = self._seen_as(F.when(F.col("crowd"), F.col("alike")).otherwise(F.col("part")), self.nodes.join(crowds, "alike", "left"))
            seen = self.scratch.keep(seen, "seen")
            pairs = self._matches(seen, range(first, min(self.plan[1], first + TOGETHER)))
            self._contract(part=self._links(self._measured(pairs, most_apart(self.similarity, WIDE_BITS))))
            self.scratch.drop(seen)
        classes = self.groups.select("digest", "id", "first").join(self.nodes.select("id", "part"), "id")
        lowest = classes.groupBy("part").agg(F.min("first").alias("component_id"))
        classes = classes.join(lowest, "part").select("digest", "component_id")
        out = self.scratch.keep(self.prints.select("doc_id", "sha", "digest").join(classes, "digest").select("doc_id", "sha", "component_id"), "classes")
        self.scratch.only(out)
        return out


def jaccard(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have at least this similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    either = np.sort(np.concatenate([x, y]))
    common = np.count_nonzero(either[1:] == either[:-1])
    return bool(common >= similarity * (len(either) - common) - 1e-9)


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of distinct pairs (a, b) whose sets of shingles (id, hashes) have at least this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(len(batch), bool)
        (xs, at_x), (ys, at_y) = ((batch.column(k).flatten().to_numpy(), np.cumsum([0, *batch.column(k).value_lengths().to_pylist()])) for k in (2, 3))
        for k in range(len(batch)):
            keep[k] = jaccard(xs[at_x[k] : at_x[k + 1]], ys[at_y[k] : at_y[k + 1]], similarity)
        return pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def survivors(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id is the smallest of its group of near copies.

    Texts without words (null, empty, white space) are copies of each other. Rows without a doc_id stay, as they can't be told apart. Rows
    that repeat a doc_id are grouped each by its own text; equal ones stay or go together. Other columns may have any names. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    found = NearCopies(docs, shingle, similarity, id_col, text_col).components()
    name, sha = fresh("gone", docs), fresh("gone_sha", docs)
    gone = scratch.keep(found.filter("doc_id != component_id").select(F.col("doc_id").alias(name), F.col("sha").alias(sha)).distinct(), "gone")
    # a filter over the ids that go spares the other documents the shuffle
    may_go = F.coalesce(hit_filter(gone, F.col(name), gone.count())(F.col(id_col).cast("long")), F.lit(False))
    rest = docs.filter(may_go).join(gone, (F.col(id_col).cast("long") == F.col(name)) & (_sha(F.coalesce(text_col, F.lit(""))) == F.col(sha)), "left_anti")
    return docs.filter(~may_go).unionByName(rest)
