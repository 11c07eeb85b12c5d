"""Mixing sources to target weights.

Tokens (words) are summed per source, targets follow from the weights, and each document is emitted floor(rate) times
plus once more with probability equal to the rate's fraction, where rate = target / source size. The random choice is
a hash of seed and doc_id, so reruns and retried tasks agree.

Weights 1, 2, 3 repeat over the sources in order of their code points, null last. Targets share 100 % of all sizes by
weight, but stop at `cap` times their source's size; the excess is shared again by weight until no target is above.
That fixed point is min(cap * size, level * weight), found by one sort of the sources.

Defined cases: a null text has size 0. A source without words has target 0 and its documents are not taken. Rows that
repeat a doc_id get the same number of copies. A null doc_id is hashed as the word null. Other columns are kept as they are, whatever
their names. Sources whose caps tie share the same level. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, heavy_keys

#: Up to these bytes (48 a row and the names) the table of rates is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: int, doc_id: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """From (source, source_size), one row a source: source, source_size, target, rate."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
    before = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = F.lit(0).cast("long")
    # level: what a unit of weight gets if all sources that cap out earlier are capped and this one is not
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), zero)) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)))
    w = w.withColumn("capped", F.col("most") / F.col("weight") < F.col("level"))
    w = w.withColumn("share", F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"])
    w = w.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("share") * F.col("weight"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return w.select("source", "source_size", "target", rate.alias("rate"))


def plan(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out: str = "__mix") -> DataFrame:
    """docs and a column `out`, which docs must not have: struct(size, source_size, target, copies)."""
    if out.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out}: give another name as out")
    scratch = Scratch(docs.sparkSession, "mixing")
    # sums are taken per task before the shuffle, so a source with a third of all rows is one row a task
    sizes = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    table = scratch.keep(rates(sizes, weights, cap), "rates")
    source, rate = fresh("rate_source", docs), fresh("rate", docs)
    right = table.select(F.col("source").alias(source), F.struct("source_size", "target", "rate").alias(rate))
    n, length = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    if n * 48 + (length or 0) <= BROADCAST_BYTES:
        joined = docs.join(F.broadcast(right), docs[source_col].eqNullSafe(right[source]), "left")
    else:
        joined = salted_left(docs, right, source_col, source, sizes_of(docs, source_col))
    whole = F.floor(F.col(rate)["rate"])
    copies = whole + F.when(uniform(seed, F.col(id_col)) < F.col(rate)["rate"] - whole, 1).otherwise(0)
    mix = F.struct(word_count(F.col(text_col)).alias("size"), F.col(rate)["source_size"].alias("source_size"), F.col(rate)["target"].alias("target"), copies.cast("long").alias("copies"))
    return joined.select(*docs.columns, mix.alias(out))


def sizes_of(docs: DataFrame, source_col: str) -> DataFrame:
    """source, n: rows of each source."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def salted_left(docs: DataFrame, right: DataFrame, source_col: str, source: str, rows: DataFrame, salts: int = 64) -> DataFrame:
    """docs left join right on the source (null is equal to null), where there are too many sources to broadcast.

    The sources with at least a 2,000th of all rows, 2,000 at most, are dealt to `salts` tasks each.
    """
    rows = Scratch(docs.sparkSession, "mixing").keep(rows, "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    heavy, salt = [fresh(x, docs, right) for x in ("heavy", "salt")]
    hot = F.broadcast(heavy_keys(rows, ["source"], "n", total).select(F.struct("source").alias(heavy)))
    left = docs.join(hot, docs[source_col].eqNullSafe(F.col(heavy)["source"]), "left")
    left = left.withColumn(salt, F.when(F.col(heavy).isNotNull(), F.floor(F.rand(7) * salts).cast("int")).otherwise(0)).drop(heavy)
    right = right.join(hot, right[source].eqNullSafe(F.col(heavy)["source"]), "left")
    right = right.select(*(c for c in right.columns if c != heavy), F.explode(F.when(F.col(heavy).isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias(salt + "_"))
    return left.join(right, left[source_col].eqNullSafe(right[source]) & (left[salt] == right[salt + "_"]), "left")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns of docs, whatever their names."""
    out = fresh("mix", docs)
    planned = plan(docs, out=out, **options).filter(F.col(out)["copies"] > 0)
    return planned.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(out)["copies"])).alias(out)).drop(out)
