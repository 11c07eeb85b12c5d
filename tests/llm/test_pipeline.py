"""The pipeline's stages on a small corpus, each against a plain version on its own input."""

import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexweave.llm import byte_bpe, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(12)
    word = lambda: draw.choice("bdfgklmnprst") + draw.choice("aeiou") + draw.choice(["n", "r", "ta", "lo", "mi"]) + str(draw.randrange(40))
    rows, labels = [], []

    def add(text, good=None):
        k = len(rows)
        rows.append((k, text, "en", f"s{k % 5}" if k % 11 else None, len(text or "")))
        if good is not None:
            labels.append((k, int(good), 0))
        return k

    for k in range(400):
        text = " ".join(word() for _ in range(draw.randint(60, 150)))
        good = draw.random() < 0.75
        add(text if good else " ".join(w.upper() + "!!" for w in text.split()), good if k % 3 else None)
    good_ones = [r[1] for r in rows if not r[1].isupper()]
    for text in good_ones[:30]:
        add(text.replace(" ", "  ", 3))  # exact but for white space
    for text in good_ones[30:60]:
        words = text.split()
        words[len(words) // 2] = "changed"
        add(" ".join(words))  # a near copy
    add(None)
    add("")
    place = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}


def test_stages(spark, folder, tmp_path):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, tables[-1], folder)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    rows = [t.collect() for t in tables]

    learned = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    accepted = {r.doc_id for r in quality.score(docs, learned).filter("predicted = 1").collect()}
    assert {r.doc_id for r in rows[1]} == accepted
    shouting = [r for r in rows[0] if r.text and r.text.isupper()]
    assert sum(r.doc_id in accepted for r in shouting) <= 0.05 * len(shouting)
    assert sum(r.doc_id in accepted for r in rows[0] if r.text and not r.text.isupper()) >= 0.97 * sum(bool(r.text) and not r.text.isupper() for r in rows[0])

    first = {}
    for r in sorted(rows[1]):
        first.setdefault(" ".join((r.text or "").split()), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(first.values())

    left, sets = sorted(rows[2]), {}
    stay = []
    for r in left:
        own = shingles(r.text)
        near = [k for k, other in sets.items() if len(own & other) >= 0.8 * len(own | other)]
        sets[r.doc_id] = own
        if not near:
            stay.append(r.doc_id)
    kept = {r.doc_id for r in rows[3]}
    gone = {r.doc_id for r in left} - set(stay)
    assert set(stay) <= kept and len(gone) > 20
    assert len(gone & kept) <= 0.1 * len(gone)  # the recall that is aimed at

    copies = Counter(r.doc_id for r in rows[4])
    size = {r.doc_id: len((r.text or "").split()) for r in rows[3]}
    assert max(copies.values()) <= 3 and set(copies) <= set(size)
    assert abs(sum(size[k] * n for k, n in copies.items()) - sum(size.values())) < 0.2 * sum(size.values())
    text = {r.doc_id: r.text for r in rows[3]}
    assert all(r.text == text[r.doc_id] for r in rows[4])

    ranks = byte_bpe.load_ranks(open(P.path(pipeline.RANKS), "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in rows[5]) == copies
    for r in rows[5]:
        ids = library.encode_ordinary(text[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.round_trip

    again = pipeline.run(spark, folder).select("doc_id", "n_tokens").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == dict(copies)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


#: Names that operators give to columns of their own, or did once.
NAMES = "size ids fp score copies mix __mix __size __copy __score __text score_text __sha __id row sha own_sha gone gone_sha __gone rate rate_source source_size target salt heavy level weight kept keep_id digest key star off part id a b s0 s1 text_to_encode".split()


def test_clashing_columns_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(150).withColumns({name: F.lit(name) for name in NAMES})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.select(NAMES).distinct().collect()
        assert [list(r) for r in rows] == [NAMES], name
    assert "ids" in pipeline.STAGES[-1][1](spark, docs, folder).columns


def test_mixing_of_many_sources(spark, folder, monkeypatch):
    """Rates joined by a salted shuffle give the same mixture as broadcast ones."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    count = lambda df: sorted((r.doc_id, r["count"]) for r in df.groupBy("doc_id").count().collect())
    one = count(pipeline.mix_sources(spark, docs, folder))
    monkeypatch.setattr(pipeline.mixing, "BROADCAST_BYTES", 0)
    assert count(pipeline.mix_sources(spark, docs, folder)) == one


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_nulls_in_any_column(spark, folder, name):
    long = "word " * 60_000
    rows = [(None, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (3, long, None, "s", 1), (4, long + "x", "en", "s", None)]
    out = dict(pipeline.STAGES)[name](spark, spark.createDataFrame(rows, COLUMNS), folder).collect()
    assert len(out) <= 3 * len(rows)
    if name == "near_dedup":
        assert sorted((r.doc_id is None, r.doc_id) for r in out) == [(False, 1), (False, 3), (False, 4), (True, None), (True, None)]
    if name == "exact_dedup":
        assert sorted(r.doc_id or 0 for r in out) == [0, 1, 3, 4]
