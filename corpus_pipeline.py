"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents. Between stages
the rows are written as Parquet to the shared folder and read again, so each stage works on what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import byte_bpe, mixing, quality, simhash
from lexweave.llm.common import Scratch, fresh, table
from lexweave.llm.exact_dedup import ExactDedup

#: A document whose quality score is below this goes.
QUALITY_THRESHOLD = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker of the last stage remembers: fewer than in the operator's own query, as workers hold the other stages' tables too.
REMEMBERED = 200_000


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those labelled rows that are not held out.

    Null and empty texts have the score of no text; without labels of both classes all documents have one score. Rows that repeat
    go or stay together. Columns are passed on, whatever their names. Without documents there is nothing to learn and none stays.
    """
    learned = quality.learn(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs)
    return quality.score(docs, learned, keep=score).filter(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal up to white space, the one with the smallest doc_id; a null text is an empty one, a null doc_id comes last.

    Rows that repeat with their doc_id: one stays, of rows that differ in other columns that of the smallest hash.
    """
    return ExactDedup(docs).survivors()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies.

    Texts without words are one group. Rows without a doc_id stay; rows that repeat one are grouped each by its own text.
    """
    return simhash.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them.

    Documents without words count nothing, but are taken at their source's rate; a null source is a source. Rows that repeat a doc_id are taken equally often.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether the decoded ids are the text again; a null text has no ids, rows that repeat one row each."""
    ranks = public_tokenizers.path(RANKS)
    sha = fresh("sha", docs)
    marked = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    coded = byte_bpe.encode(marked, ranks, public_tokenizers.PATTERN, keep=("source", sha), decoded=True, remembered=REMEMBERED)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col(sha)).alias("round_trip"))


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Compression, SimHash and BPE can't be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
