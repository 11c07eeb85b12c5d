"""Scores of documents against the licence catalogue.

`line`: the share of a document's characters in sentences that also occur in the licence. Native: the catalogue's sentences (under
2,000, whatever the documents) are a constant, and a document's scores are one array made inside its row: one scan, no shuffle.

`diff` and `exact`: the share of a document's characters that a diff leaves equal. One Arrow pass over the documents; the catalogue is
held by the workers, so no text is repeated for each pair. `exact` searches without limit, `diff` within the config's budget.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EXACT, Config
from ..core import search, segments, tidy
from ..functions import text as text_functions
from ..session import importable
from ..sources import catalog as licences

SCORES = "array<struct<ord:int,mct:long,pct:double>>"


def non_empty(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a text; one of white space only is a text."""
    return docs.filter(F.length(text_col) > 0)


def percent(mct: Column, n_chars: Column) -> Column:
    return mct * F.lit(100.0) / n_chars


def rounded(pct: Column) -> Column:
    return F.floor(pct + 0.5)


#: Buckets of the constant table of sentences: a look-up compares with one or two of them.
BUCKETS = 4096


def sentence_table(catalog: DataFrame) -> Column:
    """array<array<struct<sentence, ords>>>, a constant: under 2,000 sentences of the 19 licences, by CRC-32 modulo BUCKETS."""
    ords: dict[str, set[int]] = {}
    for ord_, sentences in catalog.select("ord", text_functions.lines(F.col("norm_text"))).collect():  # one row a licence
        for sentence in sentences:
            ords.setdefault(sentence, set()).add(ord_)
    table: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for sentence, found in ords.items():
        table[zlib.crc32(sentence.encode()) % BUCKETS].append({"sentence": sentence, "ords": sorted(found)})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<sentence:string,ords:array<int>>>>")


def line_scores(docs: DataFrame, catalog: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_norm: bool = False) -> DataFrame:
    """doc_id, n_chars, scores: one struct (ord, mct, pct) for each licence in order, for each non-empty document; with keep_norm also its norm.

    All is done inside the row, without a join or shuffle, so rows that repeat a doc_id, or have none, are scored each.
    """
    rows = non_empty(docs, text_col).select(F.col(id_col).alias("doc_id"), text_functions.normalize(F.col(text_col)).alias("norm"))
    table = sentence_table(catalog)
    every = F.sequence(F.lit(0), F.lit(len(licences.LICENSES) - 1))

    def hit(line: Column) -> Column:
        bucket = F.element_at(table, (F.crc32(line.cast("binary")) % BUCKETS + 1).cast("int"))
        return F.struct(F.length(line).cast("long").alias("n"), F.get(F.filter(bucket, lambda x: x["sentence"] == line), F.lit(0))["ords"].alias("ords"))

    def score(hits: Column, n_chars: Column) -> Column:
        def one(ord_: Column) -> Column:
            mct = F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + F.when(F.array_contains(h["ords"], ord_), h["n"]).otherwise(0))
            return F.struct(ord_.alias("ord"), mct.alias("mct"), percent(mct, n_chars).alias("pct"))

        return F.transform(every, one)

    # a lambda's argument is evaluated once, a column that is put into a lambda for each licence
    hits = F.filter(F.transform(text_functions.lines(F.col("norm")), hit), lambda h: h["ords"].isNotNull())
    bound = F.array(F.struct(hits.alias("hits"), F.length("norm").alias("n_chars")))
    scores = F.transform(bound, lambda x: score(x["hits"], x["n_chars"]))[0]
    return rows.select("doc_id", F.length("norm").alias("n_chars"), scores.alias("scores"), *(["norm"] if keep_norm else []))


def compare(document: str, licence: str, config: Config = DEFAULT) -> segments.Diff:
    """The diff that is scored and shown: by lines first, then without short equalities."""
    return tidy.efficiency(search.diff(document, licence, True, config), config.edit_cost)


def diff_scores(docs: DataFrame, config: Config = DEFAULT, licence_folder: str | None = None, dom: bool = False, strict: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, scores, error for each non-empty document.

    With dom, licences are as they come back from a page. A comparison that fails gives null scores and its error, or with strict fails the query.
    """
    importable(docs.sparkSession)
    known = [licences.normalize(licences.through_page(r[4]) if dom else r[4]) for r in licences.rows(licence_folder)]
    shared = docs.sparkSession.sparkContext.broadcast(known)  # about 220 kB
    rows = non_empty(docs, text_col).select(F.col(id_col).alias("doc_id"), text_functions.normalize(F.col(text_col)).alias("norm"))
    rows = spread(rows)
    schema = rows.select("doc_id", F.length("norm").alias("n_chars"), F.lit(None).cast(SCORES).alias("scores"), F.lit(None).cast("string").alias("error")).schema

    def run(batches):
        for batch in batches:
            out, errors = [], []
            for document in batch.column(1).to_pylist():
                try:
                    counts = [segments.equal_length(compare(document, text, config)) for text in shared.value]
                    out.append([{"ord": k, "mct": n, "pct": n * 100.0 / len(document)} for k, n in enumerate(counts)])
                    errors.append(None)
                except (ValueError, RecursionError) as e:
                    if strict:
                        raise
                    out.append(None)
                    errors.append(str(e))
            kind = pa.list_(pa.struct([("ord", pa.int32()), ("mct", pa.int64()), ("pct", pa.float64())]))
            lengths = pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int32())
            yield pa.record_batch([batch.column(0), lengths, pa.array(out, kind), pa.array(errors, pa.string())], names=["doc_id", "n_chars", "scores", "error"])

    return rows.mapInArrow(run, schema)


def spread(rows: DataFrame) -> DataFrame:
    """A few large files would be a few long tasks: such rows are dealt to as many tasks as a shuffle has. More files stay as they are."""
    if rows.isStreaming:
        return rows
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n) if rows.rdd.getNumPartitions() < n else rows


def exact_scores(docs: DataFrame, **options) -> DataFrame:
    return diff_scores(docs, replace(EXACT), **options)
