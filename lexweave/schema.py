"""Types of the engine's columns."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("op", T.IntegerType()), T.StructField("text", T.StringType())])
DIFF = T.ArrayType(SEGMENT)
HALF_MATCH = T.StructType([T.StructField(n, T.StringType()) for n in ("a_pre", "a_post", "b_pre", "b_post", "common")])
PATCH = T.StructType([T.StructField("diffs", DIFF), *(T.StructField(n, T.IntegerType()) for n in ("start1", "start2", "length1", "length2"))])
PATCHES = T.ArrayType(PATCH)
APPLIED = T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.ArrayType(T.BooleanType()))])
CATALOG = T.StructType([T.StructField("ord", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("name", "url", "license_id", "text"))])
