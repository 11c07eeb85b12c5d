"""The comparison in SQL: scalar functions and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import DEFAULT, Config
from ..core import codec, locate, patches, search, segments, tidy
from .diffs import _patch_rows, _patches, _plain


def register(spark: SparkSession, config: Config = DEFAULT) -> None:
    """Register text_diff, text_similarity, diff_tidy, diff_delta, locate_text, make_patch, apply_patch, and diff_segments for LATERAL."""

    def arrow(name, fn, kind):
        spark.udf.register(name, F.udf(lambda *v: None if any(x is None for x in v) else fn(*v), kind, useArrow=True))

    arrow("text_diff", lambda a, b: search.diff(a, b, True, config), schema.DIFF)
    arrow("text_similarity", lambda a, b: segments.equal_length(search.diff(a, b, True, config)) / max(1, len(a)), "double")
    arrow("diff_tidy", lambda d: tidy.efficiency(tidy.semantic(_plain(d)), config.edit_cost), schema.DIFF)
    arrow("diff_delta", lambda d: codec.to_delta(_plain(d)), "string")
    arrow("locate_text", lambda t, p, at: locate.locate(t, p, at, config), "int")
    arrow("make_patch", lambda a, b: _patch_rows(patches.make(a, b, config)), schema.PATCHES)
    arrow("apply_patch", lambda p, t: patches.apply(_patches(p), t, config), schema.APPLIED)

    @F.udtf(returnType="place int, op int, text string")
    class Segments:
        def eval(self, a: str, b: str):
            if a is not None and b is not None:
                for place, (op, text) in enumerate(search.diff(a, b, True, config)):
                    yield place, op, text

    spark.udtf.register("diff_segments", Segments)
