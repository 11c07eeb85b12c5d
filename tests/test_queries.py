"""All queries against their SQL on the smallest data, and the column functions' defined cases."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexweave import schema
from lexweave.config import Config
from lexweave.core import search, segments
from lexweave.functions import diffs as D
from lexweave.functions import sql as S
from lexweave.functions import text as X
from lexweave.operators import rank, report, score
from lexweave.plans import registry
from lexweave.sources import catalog as licences
from lexweave.streaming import score_stream

FOLDER = "/root/testdata/sf0.001"
SLOW = {"license_match_chars", "best_license_by_diff", "document_report"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in ("part", "documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = rows(registry.QUERIES[name](spark, FOLDER).toPandas())
    want = rows(duck.sql(registry.SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - SLOW))
def test_runs(spark, duck, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_flagship(spark, duck):
    assert registry.flagship(spark, FOLDER).count() == 19 * duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_diff_scores_equal_plain_comparison(spark):
    texts = [(1, licences.rows()[1][4]), (2, "MIT License for all. " * 5), (3, None), (4, ""), (5, " ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("norm", F.lit("clash"))
    config = Config(budget=500)
    got = {r.doc_id: r for r in score.diff_scores(df, config).collect()}
    assert sorted(got) == [1, 2, 5]
    for k, text in texts:
        if k in got:
            norm = licences.normalize(text)
            want = [segments.equal_length(score.compare(norm, licences.normalize(r[4]), config)) for r in licences.rows()]
            assert [s.mct for s in got[k].scores] == want and got[k].n_chars == len(norm) and got[k].error is None
    first = {r.doc_id: r.license_id for r in rank.best(score.diff_scores(df, config)).collect()}
    assert first[1] == "MIT"


def test_every_licence_finds_itself(spark):
    table = licences.rows()
    df = spark.createDataFrame([(r[0], r[4]) for r in table], "doc_id int, text string")
    by_line = {r.doc_id: r for r in rank.best(score.line_scores(df, licences.catalog(spark))).collect()}
    for k, r in by_line.items():
        assert r.pct == 100.0
        assert r.ord == (2 if k == 3 else k) or table[k][4] == table[r.ord][4] or by_line[k].ord in (2, 3)
    # in a diff, a short notice is contained in its full text, which comes first
    by_diff = {r.doc_id: (r.ord, r.pct) for r in rank.best(score.diff_scores(df)).collect()}
    assert all(by_diff[k] == (k, 100.0) for k in range(19) if k not in (5, 7, 9))
    assert [by_diff[k] for k in (5, 7, 9)] == [(4, 100.0), (6, 100.0), (8, 100.0)]


def test_page_round_trip():
    table = licences.rows()
    mit = licences.normalize(licences.through_page(table[1][4]))
    assert mit.startswith('Copyright (c) <year> <copyright holders="">') and mit.endswith("SOFTWARE.\n</copyright></year>")
    assert licences.through_page("\na <b c d/> </x> e</b> f") == 'a <b c="" d=""> </x> e</b> f'.replace(" </x>", " ")
    assert len(table) == 19 and len({r[3] for r in table}) == 19


def test_error_boundary(spark):
    df = spark.createDataFrame([(1, "+%c3%xy"), (2, "+ok"), (3, None)], "id int, delta string")
    got = df.select("id", D.target_text(D.from_delta(F.lit(""), F.col("delta"), strict=False)).alias("t")).collect()
    assert {r.id: r.t for r in got} == {1: None, 2: "ok", 3: None}
    with pytest.raises(Exception, match="illegal escape"):
        df.select(D.from_delta(F.lit(""), F.col("delta"))).collect()


TEXTS = [("abc", "abd"), ("", "abc"), ("abc", ""), ("", ""), (None, "a"), ("a", None), ("é😀x", "é😀y"), ("same", "same"), ("123xyz", "xyz456")]


def test_text_functions(spark):
    df = spark.createDataFrame(TEXTS, "a string, b string")
    got = df.select("a", "b", X.common_prefix(F.col("a"), F.col("b")).alias("p"), X.common_suffix(F.col("a"), F.col("b")).alias("s"), X.common_overlap(F.col("a"), F.col("b")).alias("o")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert (r.p, r.s, r.o) == (None, None, None)
        else:
            assert (r.p, r.s, r.o) == (segments.common_prefix(r.a, r.b), segments.common_suffix(r.a, r.b), segments.common_overlap(r.a, r.b)), (r.a, r.b)
    space = "a \t\n\x0b\x0c\r\xa0     　﻿b\x85c.d"
    one = spark.createDataFrame([(space,)], "t string").select(X.normalize(F.col("t"))).first()[0]
    assert one == "a b\x85c.\nd" == licences.normalize(space)


def test_white_space_of_every_character(spark):
    """Java's own pattern names the characters that the common one names."""
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x10100))]
    found = spark.createDataFrame([(f"a{c}b", f"a {c}{c}") for c in every], "x string, y string").select(X.normalize(F.col("x")), X.normalize(F.col("y"))).collect()
    assert [tuple(r) for r in found] == [(licences.normalize(f"a{c}b"), licences.normalize(f"a {c}{c}")) for c in every]


def test_diff_functions_equal_core(spark):
    pairs = [p for p in TEXTS if None not in p] + [("The quick brown fox. " * 9, "The slow brown dog. " * 9)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", D.diff(F.col("a"), F.col("b")))
    got = df.select("a", "b", "d", D.source_text(F.col("d")).alias("s"), D.target_text(F.col("d")).alias("t"), D.edit_cost(F.col("d")).alias("c"), D.map_position(F.col("d"), F.lit(2)).alias("m"), D.equal_length(F.col("d")).alias("e")).collect()
    for r in got:
        diff = search.diff(r.a, r.b)
        assert [tuple(x) for x in r.d] == diff
        assert (r.s, r.t, r.c, r.m, r.e) == (r.a, r.b, segments.edit_cost(diff), segments.map_position(diff, 2), segments.equal_length(diff))
    nulls = spark.createDataFrame([(None, "a")], "a string, b string").select(D.diff(F.col("a"), F.col("b")).alias("d"), D.patch_make(F.col("a"), F.col("b")).alias("p")).first()
    assert (nulls.d, nulls.p) == (None, None)


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT text_similarity('abcd', 'abxd') AS s, diff_delta(text_diff('abc', 'abd')) AS d, locate_text('abcdef', 'de', 0) AS l, apply_patch(make_patch('abc', 'abd'), 'abc').text AS p").first()
    assert (row.s, row.d, row.l, row.p) == (0.75, "=2\t-1\t+d", 3, "abd")
    segs = spark.sql("SELECT t.k, s.op, s.text FROM VALUES (1, 'abc', 'abd'), (2, 'x', 'x') AS t(k, a, b), LATERAL diff_segments(t.a, t.b) s").collect()
    assert sorted(map(tuple, segs)) == [(1, -1, "c"), (1, 0, "ab"), (1, 1, "d"), (2, 0, "x")]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(k, r[4]) for k, r in enumerate(licences.rows()[:3])], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    run = score_stream(stream, Config(budget=500)).writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/at").start()
    try:
        run.processAllAvailable()
        assert {r.doc_id: r.license_id for r in spark.table("scored").collect()} == {0: "Unlicense", 1: "MIT", 2: "BSD-2-Clause"}
    finally:
        run.stop()


def test_ranking_ties_and_retention(spark):
    scores = [(1, 10, [(0, 5, 50.0), (1, 9, 90.0), (2, 9, 90.0), (3, 2, 20.0)])]
    df = spark.createDataFrame(scores, f"doc_id long, n_chars int, scores {score.SCORES}")
    got = [(r["rank"], r.ord, r.keeps_detail) for r in rank.ranking(df).orderBy("rank").collect()]
    assert got == [(1, 1, True), (2, 2, True), (3, 0, True), (4, 3, False)]
    entries = [(1, 1, "One", "u", 12.4, "<span>a</span>"), (1, 2, "Two", "u", 11.5, "<span>b</span>"), (1, 3, "Three", "u", 2.5, "<span>c</span>")]
    html = report.assemble(spark.createDataFrame(entries, "doc_id long, rank int, name string, url string, pct double, diff_html string")).first().html
    assert html.count("<li>") == 3 and html.count("<div>") == 1 and "- 12% match" in html


def test_rows_that_repeat_an_id_are_scored_each(spark):
    mit = licences.rows()[1][4]
    df = spark.createDataFrame([(1, mit), (1, mit), (None, mit), (2, mit + mit), (3, "Nothing.")], "doc_id long, text string")
    got = score.line_scores(df, licences.catalog(spark)).collect()
    assert sorted((r.doc_id or 0, r.scores[1].pct) for r in got)[:4] == [(0, 100.0), (1, 100.0), (1, 100.0), (2, pytest.approx(100, abs=3))]
    assert all(s.mct == 0 for r in got if r.doc_id == 3 for s in r.scores)


def test_report_of_documents(spark, tmp_path):
    table = licences.rows()
    df = spark.createDataFrame([(1, table[1][4]), (1, table[0][4]), (None, "Some <b>text</b>.")], "doc_id long, text string")
    found = report.of_documents(df, licences.catalog(spark), Config(budget=500))
    report.write(found, f"{tmp_path}/report")
    got = sorted(spark.read.parquet(f"{tmp_path}/report").collect(), key=lambda r: r.html)
    assert len(got) == 3 and all(r.html.count("<li>") == 19 == r.html.count("</li>") and 1 <= r.html.count("<div><div") <= 3 for r in got)
    mit = next(r.html for r in got if r.html.startswith(report.ENTRY % (table[1][2], table[1][1], 100)))
    assert mit.index("<span>") < mit.index("</li>")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    run = report.write(report.of_documents(stream, licences.catalog(spark), Config(budget=500)), f"{tmp_path}/streamed")
    try:
        run.processAllAvailable()
        assert sorted(r.html for r in spark.read.parquet(f"{tmp_path}/streamed").collect()) == [r.html for r in got]
    finally:
        run.stop()


def test_schema():
    assert schema.PATCH.fieldNames() == ["diffs", "start1", "start2", "length1", "length2"]


def test_plans_stay_native(spark, duck):
    """Line scores run without Python, without a cross join, and read two columns."""
    plan = registry.license_ranking(spark, FOLDER)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Python" not in physical and "Arrow" not in physical and "NestedLoop" not in physical and "Cartesian" not in physical
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in physical
    assert "Exchange" not in physical and "Join" not in physical and physical.count("FileScan") == 1


def test_entry_without_the_text_collection_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert set(e.queries()) == set(e.registry.QUERIES) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), check=True)


def test_catalog_data_source(spark):
    from lexweave.sources import datasource

    datasource.register(spark)
    df = spark.read.format("license_catalog").load()
    assert sorted(map(tuple, df.collect())) == sorted(licences.rows())
    assert spark.read.format("license_catalog").load(str(licences.TEXTS)).count() == 19
