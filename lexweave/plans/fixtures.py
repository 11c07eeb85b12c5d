"""Inputs that queries and their SQL build alike from whole tables: a diff, a place and a patch header for each part, and literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import diffs as D
from ..session import table

#: The segments of a part's diff: op and text, in SQL and as a column.
SEGMENTS = (
    (0, "p_name", lambda: F.col("p_name")),
    (-1, "p_brand", lambda: F.col("p_brand")),
    (1, "p_type || '<&' || chr(10)", lambda: F.concat("p_type", F.lit("<&\n"))),
    (0, "' of '", lambda: F.lit(" of ")),
    (1, "p_type", lambda: F.col("p_type")),
    (-1, "p_name || '>'", lambda: F.concat("p_name", F.lit(">"))),
)
DIFFS = "(SELECT p_partkey AS id, (p_size % 40)::INT AS place, [" + ", ".join(f"{{'op': {op}, 'text': {text}}}" for op, text, _ in SEGMENTS) + "] AS diff FROM part) AS v"

_SPAN = "CASE {n} WHEN 0 THEN {s} || ',0' WHEN 1 THEN ({s} + 1)::VARCHAR ELSE ({s} + 1) || ',' || {n} END"
HEADERS = f"""(SELECT *, '@@ -' || {_SPAN.format(s="start1", n="length1")} || ' +' || {_SPAN.format(s="start2", n="length2")} || ' @@' AS header
    FROM (SELECT p_partkey AS id, p_partkey::INT AS start1, (p_size % 3)::INT AS length1, (p_partkey + 7)::INT AS start2, (p_size % 5)::INT AS length2 FROM part)) AS v"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, place, diff."""
    segments = [F.struct(F.lit(op).alias("op"), text().alias("text")) for op, _, text in SEGMENTS]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 40).cast("int").alias("place"), F.array(*segments).alias("diff"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, start1, length1, start2, length2, header."""
    part = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("int"), F.col("p_size")
    rows = part.select(F.col("p_partkey").alias("id"), key.alias("start1"), (size % 3).cast("int").alias("length1"), (key + 7).alias("start2"), (size % 5).cast("int").alias("length2"))
    return rows.withColumn("header", D.patch_header(F.struct("start1", "length1", "start2", "length2")))


def quoted(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows: tuple, columns: str) -> str:
    """A table expression of literal rows."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows) + f") AS v({columns})"
