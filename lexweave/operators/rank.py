"""Ranking of the licences of a document, inside its row: no shuffle, and the same on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import LICENSES

#: The first keeps its details always, the next two from this percentage on.
DETAILED, LEAST_PERCENT = 3, 20


def licence(ord_: Column, field: int) -> Column:
    """name (0), address (1) or id (2) of a licence."""
    return F.element_at(F.array(*[F.lit(row[field]) for row in LICENSES]), ord_ + 1)


def ranked(scored: DataFrame) -> DataFrame:
    """scores in order of falling percentage, then of the catalogue."""
    order = F.array_sort("scores", lambda a, b: F.when(a["pct"] > b["pct"], -1).when(a["pct"] < b["pct"], 1).otherwise(a["ord"] - b["ord"]))
    return scored.withColumn("scores", order)


def ranking(scored: DataFrame) -> DataFrame:
    """A row for each document and licence: doc_id, rank, ord, license_id, mct, pct, rounded, keeps_detail."""
    # the outer form: no test for empty arrays, which would make the scores twice
    rows = ranked(scored).select("doc_id", F.posexplode_outer("scores").alias("place", "s"))
    rank = F.col("place") + 1
    return rows.select("doc_id", rank.alias("rank"), "s.ord", licence(F.col("s.ord"), 2).alias("license_id"), "s.mct", "s.pct", F.floor(F.col("s.pct") + 0.5).alias("rounded"), keeps_detail(rank, F.col("s.pct")).alias("keeps_detail"))


def best(scored: DataFrame) -> DataFrame:
    """The first of each document's ranking."""
    rows = ranked(scored).select("doc_id", "n_chars", F.element_at("scores", 1).alias("s"))
    return rows.select("doc_id", "n_chars", "s.ord", licence(F.col("s.ord"), 0).alias("name"), licence(F.col("s.ord"), 2).alias("license_id"), "s.mct", "s.pct")


def keeps_detail(rank: Column, pct: Column) -> Column:
    return (rank == 1) | ((rank <= DETAILED) & (pct >= LEAST_PERCENT))
