"""Exact dedup by a log-structured merge index of text digests, in DataFrame operations only.

Writing. Each input partition is a memtable: its (digest, doc_id) rows are sorted and flushed, without a shuffle,
as a run (a Parquet file with a Bloom filter and min/max statistics on the digest). Compaction merges all runs to one
level sorted by digest, with the smallest identifier and the number of rows of each digest.

Reading. Runs are merged with the level; rows of digests that occur more than once are hits. A Bloom filter of their
ids, probed for every document, lets only hits be read again and travel with their text, to be compared byte for byte with the text of
the row that stays. A hit that differs (a digest collision) leaves the digest's group and is grouped by its text
instead, so a collision costs time, never a row.

Defined cases: a null text counts as empty. Of rows equal in text and doc_id the first one read is marked as kept; survivors() keeps the
one whose columns have the smallest hash. A null doc_id
sorts after all others. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, fresh, heavy_keys, salted_join

#: Bits of the hit filter for each hit, and the most bits it may have (8 MB, broadcast as a constant).
FILTER_BITS_PER_KEY, FILTER_MAX_BITS = 16, 1 << 26


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space. Single spaces, most of them, are not touched by the pattern."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def _order(doc_id: Column, rid: Column) -> Column:
    return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), rid.alias("rid"))


class ExactIndex:
    """A log-structured index of digests in the shared folder."""

    def __init__(self, spark: SparkSession, digest_bytes: int = 32, label: str = "exact-index"):
        self.spark, self.digest_bytes, self.scratch = spark, digest_bytes, Scratch(spark, label)
        self.runs: list[DataFrame] = []
        self.level: DataFrame | None = None

    def digest(self, text: Column) -> Column:
        return F.unhex(F.sha2(normalised(text).cast("binary"), 256))

    def key(self, sha: str = "sha") -> Column:
        return F.substring(F.col(sha), 1, self.digest_bytes)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Memtables to sorted runs: one file for each input partition, no shuffle."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), self.digest(F.col(text_col)).alias("sha"), F.monotonically_increasing_id().alias("rid"))
        rows = rows.sortWithinPartitions("sha", "doc_id")
        self.runs.append(self.scratch.keep(rows, "run", **{"parquet.bloom.filter.enabled#sha": "true", "parquet.bloom.filter.adaptive.enabled": "true"}))
        return self.runs[-1]

    def rows(self) -> DataFrame:
        out = self.runs[0].withColumn("run", F.lit(0))
        for k, run in enumerate(self.runs[1:], 1):
            out = out.unionAll(run.withColumn("run", F.lit(k)))
        return out.select("doc_id", "sha", F.struct("run", "rid").alias("rid")).withColumn("digest", self.key())

    def compact(self) -> DataFrame:
        """All runs to one level: digest, the row that stays (keep), n. Summed before the shuffle, so hot digests are cheap."""
        level = self.rows().groupBy("digest").agg(F.min(_order(F.col("doc_id"), F.col("rid"))).alias("keep"), F.count(F.lit(1)).alias("n"))
        self.level = self.scratch.keep(level.sortWithinPartitions("digest"), "level", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
        return self.level


def _places(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32) * 31 + F.pmod(h, F.lit(65521)), F.lit(bits))]


def hit_filter(frame: DataFrame, key: Column, n_keys: int):
    """A test, of plain columns, whether a column's value may be among frame's keys: a Bloom filter.

    Its words are one row, at most FILTER_MAX_BITS bits whatever n_keys is, that reaches the executors as a constant.
    A full filter lets every row through: more work, the same result.
    """
    bits = min(FILTER_MAX_BITS, max(1 << 12, 1 << (max(1, n_keys) * FILTER_BITS_PER_KEY - 1).bit_length()))
    marked = frame.select(F.explode(F.array(*_places(key, bits))).alias("p")).select(F.shiftright("p", 6).alias("i"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("w"))
    every = frame.sparkSession.range(bits // 64).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    words = marked.unionAll(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("bits"))
    words = row.collect()[0]["bits"]
    constant = frame.sparkSession.createDataFrame([(words,)], "bits array<long>")

    def may_hold(column: Column) -> Column:
        tests = [F.bit_get(F.element_at(constant.scalar(), (F.shiftright(p, 6) + 1).cast("int")), (p % 64).cast("int")) == 1 for p in _places(column, bits)]
        return tests[0] & tests[1]

    return may_hold


class ExactDedup:
    """One pass over a table: index, verified hits, and one result row for each document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32):
        self.docs, self.id, self.text = docs, F.col(id_col).cast("long"), F.col(text_col)
        self.index = ExactIndex(docs.sparkSession, digest_bytes)
        self.index.flush(docs, id_col, text_col)
        level = self.index.compact()
        total = level.agg(F.sum("n")).first()[0] or 0
        self.heavy = heavy_keys(level, ["digest"], "n", total)
        #: Each row of the table with its digest's entry.
        self.placed = self.index.scratch.keep(salted_join(self.index.rows(), level, ["digest"], self.heavy), "placed")
        self.collided = self.index.scratch.keep(self._differing().select("digest").distinct(), "collided")
        self.collisions = not self.collided.isEmpty()

    def _texts(self, docs: DataFrame) -> DataFrame:
        rows = docs.select(self.id.alias("doc_id"), normalised(self.text).alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
        return rows.withColumn("digest", self.index.key())

    def _may_be(self, ids: DataFrame) -> Column:
        """Whether a document's id may be among those in ids (column doc_id); a missing id always may."""
        return F.coalesce(hit_filter(ids, F.col("doc_id"), ids.count())(self.id), F.lit(True))

    def _differing(self) -> DataFrame:
        """Hits whose bytes differ from those of the row that stays. Only documents that may be hits are read again in full."""
        hits = self.placed.filter("n > 1")
        keys = self.index.level.filter("n > 1").select("digest", F.col("keep.doc_id").alias("keep_id"))
        kept = self._texts(self.docs.filter(self._may_be(keys.select(F.col("keep_id").alias("doc_id")))))
        kept = kept.join(keys, (kept.digest == keys.digest) & kept.doc_id.eqNullSafe(keys.keep_id)).select(kept.digest, F.col("norm").alias("keep_norm"))
        kept = kept.groupBy("digest").agg(F.min("keep_norm").alias("keep_norm"))
        texts = self._texts(self.docs.filter(self._may_be(hits.select("doc_id"))))
        return salted_join(texts, kept, ["digest"], self.heavy).filter(F.col("norm") != F.col("keep_norm"))

    def result(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of the table."""
        rows = self.placed
        if self.collisions:
            rows = rows.join(self.collided, "digest", "left_anti")
        out = rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        return out.unionByName(self._by_text()) if self.collisions else out

    def _by_text(self) -> DataFrame:
        """The documents of collided digests, grouped by their whole texts."""
        rows = self._texts(self.docs).join(self.collided, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id())
        rows = self.index.scratch.keep(rows, "by-text")
        groups = rows.groupBy("norm").agg(F.min(_order(F.col("doc_id"), F.col("rid"))).alias("keep"), F.count(F.lit(1)).alias("n"))
        return rows.join(groups, "norm").select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("keep.rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    def survivors(self) -> DataFrame:
        """The table's rows that stay, with all their columns. Documents whose id surely stays are passed on as they are."""
        rid, sha, own = (fresh(x, self.docs) for x in ("row", "sha", "own_sha"))
        result = self.index.scratch.keep(self.result().select("doc_id", "kept", "text_sha256"), "result")
        may_go = self._may_be(result.filter("not kept").select("doc_id").distinct())
        kept = result.filter("kept").select(F.col("doc_id").alias(rid), F.unhex("text_sha256").alias(sha))
        rest = self.docs.filter(may_go)
        rest = rest.join(kept, self.id.eqNullSafe(F.col(rid)) & (self.index.digest(self.text) == F.col(sha)), "left_semi")
        # rows equal in doc_id and text but not in other columns: the one whose columns' hash is smallest stays
        stay = rest.withColumns({rid: self.id, own: self.index.digest(self.text)})
        first = stay.groupBy(rid, own).agg(F.min_by(F.struct(*self.docs.columns), F.xxhash64(*self.docs.columns)).alias(sha))
        return self.docs.filter(~may_go).unionByName(first.select(f"`{sha}`.*"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each document; see the module."""
    return ExactDedup(docs, id_col, text_col, digest_bytes).result()
