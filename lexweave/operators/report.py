"""The ranking as an HTML list, and its writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..config import DEFAULT, Config
from ..functions import diffs
from ..sources import catalog as licences
from . import rank, score

#: The wording and markup of an entry and of its details.
ENTRY = '<li><a href="%s" target="_blank" title="Show full license" style="color:inherit; text-decoration"><strong>%s</strong> - %d%% match into this license</a>'
DETAIL_OPEN, DETAIL_CLOSE = '<div><div style="font-size: 10px;">', "</div><br></div>"


def line(name: Column, url: Column, pct: Column) -> Column:
    return F.format_string(ENTRY, url, name, F.floor(pct + 0.5))


def detail(html: Column) -> Column:
    """The block of details, empty if there are none."""
    return F.when(html.isNotNull() & (html != ""), F.concat(F.lit(DETAIL_OPEN), html, F.lit(DETAIL_CLOSE))).otherwise(F.lit(""))


def assemble(entries: DataFrame) -> DataFrame:
    """doc_id, html: from (doc_id, rank, name, url, pct, diff_html), the entries in order of rank."""
    kept = F.when(rank.keeps_detail(F.col("rank"), F.col("pct")), F.col("diff_html"))
    item = F.concat(line(F.col("name"), F.col("url"), F.col("pct")), detail(kept), F.lit("</li>"))
    rows = entries.select("doc_id", F.struct("rank", item.alias("item")).alias("e"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"]), "").alias("html"))


def of_documents(docs: DataFrame, catalog: DataFrame, config: Config = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, html: the whole report of each non-empty document, with the diffs of the licences that keep their details.

    Ranked by line scores, made inside the row: no shuffle, and the same on a stream. Only the kept licences, three at most, are compared.
    """
    known = [licences.normalize(r[4]) for r in licences.rows()]
    shared = docs.sparkSession.sparkContext.broadcast(known)  # about 220 kB
    rows = rank.ranked(score.line_scores(score.spread(docs), catalog, id_col, text_col, keep_norm=True))
    # kept ones are the first of the ranking: no later one has a higher percentage
    first = F.filter("scores", lambda s, i: rank.keeps_detail(i + 1, s["pct"]))
    compare = F.udf(lambda norm, ords: [score.compare(norm, shared.value[k], config) for k in ords], schema.T.ArrayType(schema.DIFF), useArrow=True)
    rows = rows.select("doc_id", "scores", compare("norm", F.transform(first, lambda s: s["ord"])).alias("diffs"))
    html = F.transform("diffs", diffs.html)
    entry = lambda s, i: F.concat(line(rank.licence(s["ord"], 0), rank.licence(s["ord"], 1), s["pct"]), detail(F.get(html, i)), F.lit("</li>"))
    return rows.select("doc_id", F.array_join(F.transform("scores", entry), "").alias("html"))


def write(reports: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Add reports to a Parquet folder; those of a stream as they come, for which the running query is returned."""
    if reports.isStreaming:
        return reports.writeStream.format("parquet").option("checkpointLocation", checkpoint or f"{path}-checkpoint").start(path)
    reports.write.mode("append").parquet(path)
    return None
