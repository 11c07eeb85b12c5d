"""The operators against brute force, libraries and round trips; and the cases that their docstrings define."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import byte_bpe, common, embedding_dedup, graph, language_id, learning, lexicon, mixing, quality, simhash, token_count, token_files, toxicity
from lexweave.llm.common import Memory, heavy_keys, salted_join
from lexweave.llm.exact_dedup import ExactDedup, dedup, hit_filter

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")
WORDS = P.path("word_bpe_49k.json")

TEXTS = [
    "The quick brown fox jumps over the lazy dog. Again and again.",
    "the  quick\tbrown\nfox",
    "",
    None,
    " ",
    "x" * 5000,
    "\n\n \t",
    "Été à la plage, où l'on s'amuse!",
    "naïve Σίσυφος ΟΔΟΣ 中文字 😀 \x1c \x85 　z",
    "<s> </s> <|endoftext|> <|ENDOFTEXT|> <unk> ▁ ▁▁a",
    "it's they'll  we've   I'm 12345 3.14!!! ...",
    "a b́ é   ​ end ",
    " lead and trail  ",
    "word, word. Word; word: (word) [word] word!? word's",
]
DOCS = "doc_id long, text string, lang string, source string, size long, fp string, ids string, copies int"


def documents(spark, texts=TEXTS, first=1):
    """Rows with columns whose names clash with those that operators use."""
    rows = [(first + k, t, ["en", "fr", None][k % 3], [f"s{k % 4}", None][k % 7 == 6], k, "x", "y", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def fuzz(n=300, seed=3):
    draw = random.Random(seed)
    parts = list("abcABC  \n\t.,'!?0123éèñßΣ 　▁中ひ😀\x00\x1c\x85\x0b\r<|>/`́​") + ["the ", "<s>", "<|endoftext|>", "'s", "'ll ", "  ", "tion", " \n", "Word, ", "Été. "]
    return ["".join(draw.choices(parts, k=draw.randint(0, 40))) for _ in range(n)]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# Exact dedup


def normal(text):
    out, space = [], False
    for c in text or "":
        is_space = c in " \t\n\x0b\x0c\r"
        if is_space and space:
            continue
        out.append(" " if is_space else c)
        space = is_space
    return "".join(out)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(spark, digest_bytes):
    texts = [*TEXTS, *TEXTS, "the quick brown fox", "the\r\nquick brown  fox", *fuzz(60), *fuzz(60)]
    df = documents(spark, texts)
    groups = defaultdict(list)
    for k, t in enumerate(texts, 1):
        groups[normal(t)].append(k)
    rows = dedup(df, digest_bytes=digest_bytes).collect()  # one byte: most groups collide, and texts decide
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[normal(texts[r.doc_id - 1])]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(normal(texts[r.doc_id - 1]).encode()).hexdigest()
    left = ExactDedup(df, digest_bytes=digest_bytes).survivors()
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(min(g) for g in groups.values())


def test_exact_dedup_defined_cases(spark):
    assert dedup(empty(spark)).count() == 0
    assert ExactDedup(empty(spark)).survivors().count() == 0
    rows = [(5, "a b"), (5, "a  b"), (None, "a b"), (7, "a\tb"), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup(df).collect()
    assert sum(r.kept for r in got) == 2 and {r.keep_id for r in got} == {5, 3}
    assert sorted(r.group_size for r in got) == [2, 2, 4, 4, 4, 4]
    assert sorted(r.doc_id for r in ExactDedup(df).survivors().collect()) == [3, 5]


def test_hit_filter_has_no_misses(spark):
    keys = spark.range(0, 4000, 2)
    may = hit_filter(keys, F.col("id"), 2000)
    got = {r.id for r in spark.range(4000).filter(may(F.col("id"))).collect()}
    assert got >= set(range(0, 4000, 2)) and len(got) < 2300


def test_salted_join_is_a_join(spark):
    left = spark.range(1000).select((F.col("id") % 7 * (F.col("id") % 3 == 0).cast("long")).alias("k"), F.col("id").alias("x"))
    right = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    heavy = heavy_keys(left.groupBy("k").count().withColumnRenamed("count", "n"), ["k"], "n", 1000, share=10, least=1)
    for how in ("inner", "left"):
        assert sorted(map(tuple, salted_join(left, right, ["k"], heavy, how).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


# Tokens


def test_token_counts(spark):
    import sentencepiece

    texts = [*TEXTS, *fuzz()]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in token_count.count_tokens(documents(spark, texts), PIECES, limit=20).collect()}
    for k, t in enumerate(texts, 1):
        n = len(sp.encode(t or "", num_threads=1))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 20), repr(t)
    assert token_count.count_tokens(empty(spark), PIECES).count() == 0


def test_whole_tokens_are_proven():
    with open(PIECES, "rb") as f:
        words = token_count.proven(f.read())
    assert len(words) > 10_000 and "the" in words
    model = open(PIECES, "rb").read()
    spec = token_count.fields(model)[token_count.NORMALIZER]
    changed = model.replace(spec, spec.replace(b"\x20\x00", b"\x20\x01"))  # drops spaces
    assert changed != model
    with pytest.raises(ValueError):
        token_count.proven(changed)


def test_token_files(spark, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = [*TEXTS, *fuzz()]
    df = documents(spark, texts).unionAll(documents(spark, [None], first=None or 9000).withColumn("doc_id", F.lit(None).cast("long")))
    path = f"{tmp_path}/ids"
    token_files.write(df, path, WORDS, end_id=2, partitions=5)
    tokenizer = Tokenizer.from_file(WORDS)
    rows = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *range(1, len(texts) + 1)]
    start = 0
    for r, t in zip(rows, [None, *texts], strict=True):
        assert list(r.ids) == tokenizer.encode(t or "", add_special_tokens=False).ids + [2], repr(t)
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += len(r.ids)
    for r in token_files.checksums(token_files.read(spark, path)).collect():
        ids = next(x.ids for x in rows if x.doc_id == r.doc_id)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    file = pq.ParquetFile(next((tmp_path / "ids").glob("part-*.parquet")))
    columns = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(5)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values() if c.num_values)


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write(empty(spark), f"{tmp_path}/none", WORDS)
    assert token_files.checksums(token_files.read(spark, f"{tmp_path}/none")).count() == 0


def test_byte_bpe(spark):
    import tiktoken

    texts = [*TEXTS, *fuzz()]
    ranks = byte_bpe.load_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode(documents(spark, texts), RANKS, P.PATTERN, keep=("source", "text"))
    for r in byte_bpe.decode(coded, RANKS).collect():
        assert list(r.ids) == library.encode_ordinary(r.text or ""), repr(r.text)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(empty(spark), RANKS, P.PATTERN), RANKS).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert byte_bpe.decode(null, RANKS).first().decoded is None


def test_backtracking_equals_merging():
    """A small vocabulary with many ties and dead ends."""
    ranks = {bytes([c]): k for k, c in enumerate(b"ab c")}
    for token in (b"aa", b"ab", b"ba", b"aab", b"abab", b"bb", b"aabb", b" a", b"baa", b"aaaa"):
        ranks[token] = len(ranks)
    encoder = byte_bpe.Encoder(ranks, byte_bpe.halves(ranks), P.PATTERN)
    draw = random.Random(1)
    for _ in range(3000):
        data = bytes(draw.choices(b"ab", k=draw.randint(1, 14)))
        if data not in ranks:
            assert encoder.piece(data) == [ranks[p] for p in byte_bpe.merge(data, ranks)[0]], data


def test_lexicon_forgets_and_grows():
    made = []

    def make(words):
        made.extend(words)
        return [np.array([len(w), w[0]], "<i4").tobytes() for w in words]

    some = lexicon.Lexicon(make, limit=50)
    some.NEWEST = 8
    draw = random.Random(2)
    for _ in range(30):
        words = [draw.choice("abcdefgh").encode() * draw.randint(1, 9) for _ in range(40)]
        buffer = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = ends - [len(w) for w in words]
        values, lengths = some.look_up(buffer, starts, ends)
        assert values.reshape(-1, 2).tolist() == [[len(w), w[0]] for w in words] and (lengths == 2).all()
    assert some.n <= 50 and len(made) < 1200
    long = b"z" * (lexicon.SPAN + 5)
    assert some.look_up(long, np.array([0]), np.array([len(long)]))[0].tolist() == [len(long), ord("z")]


def twins(n):
    """Two words of n bytes (a power of 2) that any polynomial hash modulo 2^64 takes for one from 1,024 bytes on: Thue-Morse and its complement."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_twins_share_a_hash():
    x, y = (np.frombuffer(w.encode(), np.uint8) for w in twins(2048))
    one = [lexicon.hashes(w, np.array([0]), np.array([2048])) for w in (x, y)]
    assert one[0] == one[1]


def test_words_that_collide(spark, tmp_path):
    """Alone, in turn, side by side in one text, and remembered from an earlier batch: ids are those of the libraries."""
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    texts = []
    for n in (512, 1024, 2048, 4096, 8192):
        x, y = twins(n)
        texts += [x, y, f"{x} {y}", f"the {y}, {x} and {y}", f"{y}{x}"]
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    ranks = byte_bpe.load_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for r in byte_bpe.encode(df, RANKS, P.PATTERN, keep=("text",), decoded=True).collect():
            assert list(r.ids) == library.encode_ordinary(r.text) and bytes(r.decoded).decode() == r.text
        token_files.write(df, f"{tmp_path}/ids", WORDS, end_id=2, partitions=1)
        tokenizer = Tokenizer.from_file(WORDS)
        for r in token_files.read(spark, f"{tmp_path}/ids").collect():
            assert list(r.ids) == tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
        for r in token_count.count_tokens(df, PIECES).collect():
            assert r.n_tokens == len(sp.encode(texts[r.doc_id], num_threads=1))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_a_worker_holds_the_tables_of_one_module():
    common.hold_tables_of("one")
    assert common.built(("x",), lambda: 1) == 1 and common.built(("x",), lambda: 2) == 1
    common.hold_tables_of("one")
    assert common.built(("x",), lambda: 2) == 1
    common.hold_tables_of("other")
    assert common.built(("x",), lambda: 2) == 2


def test_batches_are_bounded_by_rows_and_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, kept in (("64m", str(common.BATCH_BYTES)), ("100k", "100k")):
        spark.conf.set(name, given)
        common.Scratch(spark, "test")
        assert spark.conf.get(name) == kept
    rows = spark.range(40).select("id", F.expr("repeat('x', 10000)").alias("text")).coalesce(1)
    sizes = common.map_batches(rows, lambda b: pa.record_batch([pa.array([len(b)])], names=["n"]), "n long").collect()
    spark.conf.set(name, str(common.BATCH_BYTES))
    assert sum(r.n for r in sizes) == 40 and len(sizes) >= 3


def test_memory_keeps_two_generations():
    class Squares(Memory):
        LIMIT = 10

        def make(self, key):
            return len(key) ** 2

    some = Squares()
    for k in range(100):
        keys = {"x" * n for n in range(k, k + 5)}
        assert some.table(keys) == {key: len(key) ** 2 for key in keys}
    assert len(some.young) <= 15 and len(some.old) <= 15
    assert some.table(set()) == {}


# Learned operators


def made_up(spark, n=600, seed=4):
    """Documents of two languages, some toxic, some bad, and their labels."""
    draw = random.Random(seed)
    words = {"aa": ["bama", "dalo", "kina", "soto", "relu", "pim"], "bb": ["zwerk", "schlo", "grunz", "knapf", "trull", "wosch"]}
    docs, labels = [], []
    for k in range(n):
        lang = draw.choice(["aa", "bb"])
        text = [draw.choice(words[lang]) + draw.choice(["", "n", "s", "te"]) for _ in range(draw.randint(30, 120))]
        toxic, good = int(draw.random() < 0.3), int(draw.random() < 0.7)
        if toxic:
            for _ in range(max(3, len(text) // 20)):
                text[draw.randrange(len(text))] = draw.choice(["vilex", "scumbo", "idiotz"])
        if not good:
            text = [w.upper() + "!!" for w in text]
        docs.append((k, " ".join(text), lang if draw.random() < 0.9 else None, f"s{k % 3}"))
        labels.append((k, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def test_language(spark):
    docs, _ = made_up(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    odd = documents(spark, first=10_000)
    model = language_id.learn(docs)
    got = {r.doc_id: r for r in language_id.identify(docs.select("doc_id", "text").unionAll(odd.select("doc_id", "text")), model).collect()}
    assert all(got[k].held_out == held(k) for k in truth)
    right = [got[k].lang_pred == lang for k, lang in truth.items() if lang and held(k)]
    assert np.mean(right) > 0.98
    assert {got[10_000 + k].lang_pred for k in (2, 3, 4, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.learn(empty(spark))
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, nothing).collect()} == {("und", 0.0)}


def test_language_against_plain_counts():
    """Log-likelihoods by dictionaries of n-grams, one text after the other."""
    texts = ["Ab, ça va", "", "x", "a  b", "日本", "12 !"]
    bucket, doc = language_id.ngrams(texts)
    for k, t in enumerate(texts):
        alone, _ = language_id.ngrams([t])
        assert sorted(bucket[doc == k].tolist()) == sorted(alone.tolist())
        symbols = "  " + "".join(c if c.isalpha() else " " for c in t.lower()) + "  "
        grams = [symbols[i : i + n] for n in (1, 2, 3) for i in range(len(symbols) - n + 1) if symbols[i : i + n].strip()]
        assert len(alone) == len(grams)


@pytest.mark.parametrize(("together", "at_once"), [(400, 64), (3, 2)])
def test_language_against_plain_bayes(spark, monkeypatch, together, at_once):
    """Counts in dictionaries and likelihoods summed n-gram by n-gram, with many languages; in parts of the matrix it is the same."""
    import math

    monkeypatch.setattr(language_id, "TOGETHER", together)
    monkeypatch.setattr(language_id, "HELD", at_once)
    draw = random.Random(14)
    letters = "abcdefghijklmnop"
    rows = []
    for k in range(160):
        lang = f"l{k % 8}"
        own = letters[k % 8 : k % 8 + 6]
        rows.append((k, " ".join("".join(draw.choices(own, k=draw.randint(1, 6))) for _ in range(draw.randint(0, 12))), lang if k % 5 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    counts, docs = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for k, text, lang in rows:
        if lang and not held(k):
            docs[lang] += 1
            for b in language_id.ngrams([text])[0].tolist():
                counts[lang][b] += 1
    got = {r.doc_id: r for r in language_id.identify(df, language_id.learn(df)).collect()}
    assert len(got) == 160
    for k, text, _ in rows:
        grams = language_id.ngrams([text])[0].tolist()
        like = {x: math.log(docs[x] + 1) - math.log(sum(docs.values()) + len(docs)) + sum(math.log(counts[x][b] + 0.5) - math.log(sum(counts[x].values()) + 0.5 * language_id.BUCKETS) for b in grams) for x in docs}
        if not grams:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        top = max(like.values())
        assert like[got[k].lang_pred] == pytest.approx(top, abs=1e-3)
        assert got[k].score == pytest.approx(1 / sum(math.exp(v - top) for v in like.values()), abs=1e-3)


def test_toxicity_against_plain_counts(spark):
    """The chosen model from sets of word pairs, and each score from the ratios of a text's words."""
    import math

    docs, labels = made_up(spark, 300)
    (words, stems), w = toxicity.learn(docs, labels)
    sample, _ = learning.labelled_sample(docs, labels, "toxic", toxicity.FIT_ROWS)
    before = [defaultdict(set), defaultdict(set)]
    for r in sample.filter("not calibrates").collect():
        own = toxicity.words(r.text)
        for a, b in zip([None, *own], own, strict=False):
            before[r.y][b].add(a)
    every = sorted(set(before[0]) | set(before[1]))
    count = np.array([[len(before[y][x]) for y in (0, 1)] for x in every], float)
    plain = [toxicity.Model(np.array(list(map(toxicity.signed_hash, every))), count, count.sum(0), len(every), d) for d in toxicity.DISCOUNTS]
    assert any(set(m.ratios) >= set(words.ratios) and all(m.ratios[k] == pytest.approx(v) for k, v in words.ratios.items()) and m.rare == pytest.approx(words.rare) for m in plain)
    got = {r.doc_id: r.score for r in toxicity.score(docs, ((words, stems), w)).collect()}
    for r in docs.collect():
        ratios = []
        for x in toxicity.words(r.text):
            found = words.ratios.get(toxicity.signed_hash(x))
            if found is None and stems:
                found = stems.ratios.get(toxicity.signed_hash(b"\0" + x[: toxicity.STEM]))
            ratios.append(words.rare if found is None else found)
        n = max(2, math.ceil(0.01 * len(ratios)))
        z = w[0] + w[1] * sum(sorted(ratios)[-n:]) / n
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_against_plain_compression(spark):
    """Each score from the sizes of a text's blocks as the library compresses them."""
    import math

    import zstandard

    docs, labels = made_up(spark, 300)
    docs = docs.unionAll(spark.createDataFrame([(900, "bama dalo " * 3000, "aa", "s"), (901, None, None, None)], docs.schema))
    learned = quality.learn(docs, labels)
    bad, good = (zstandard.ZstdCompressionDict(d) for d in learned[0])
    got = {r.doc_id: r.score for r in quality.score(docs, learned).collect()}
    for r in docs.collect():
        data, sizes = (r.text or "").encode(), [0, 0, 0]
        for at in range(0, len(data), quality.BLOCK):
            for k, one in enumerate((bad, good, None)):
                c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=one, write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[k] += len(c.compress(data[at : at + quality.BLOCK]))
        x = ((sizes[1] - sizes[0]) / (sizes[0] + sizes[1]), sizes[2] / len(data)) if data else (0.0, 1.0)
        z = learned[1][0] + learned[1][1] * x[0] + learned[1][2] * x[1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), r.doc_id


def test_learned_rows_exclude_held_out(spark):
    docs, labels = made_up(spark, 200)
    sample, counts = learning.labelled_sample(docs, labels, "toxic", 10)
    texts = {r.text: r.doc_id for r in docs.collect()}
    rows = sample.collect()
    assert not any(held(texts[r.text]) for r in rows) and sorted(r.y for r in rows) == [0] * 10 + [1] * 10
    assert sum(counts.values()) == sum(not held(k) for k in range(200))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers(spark, module):
    docs, labels = made_up(spark)
    label = "toxic" if module is toxicity else "quality"
    truth = {r.doc_id: r[label] for r in labels.collect()}
    learned = module.learn(docs, labels)
    got = {r.doc_id: r for r in module.score(docs, learned).collect()}
    right = [got[k].predicted == y for k, y in truth.items() if held(k)]
    assert np.mean(right) > 0.95, np.mean(right)
    again = {r.doc_id: r.score for r in module.score(docs.repartition(7), module.learn(docs.repartition(5), labels.repartition(3))).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())
    odd = module.score(documents(spark), learned).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if not TEXTS[r.doc_id - 1]}) == 1
    none = module.learn(docs, labels.filter("false"))
    assert {r.score for r in module.score(documents(spark), none).collect()} == {0.5}
    one = module.learn(docs, labels.withColumn(label, F.lit(1)))
    assert {r.predicted for r in module.score(documents(spark), one).collect()} == {1}
    assert module.score(empty(spark), learned).count() == 0


def test_toxicity_model_is_kneser_ney():
    """Ratios by hand for three words."""
    word, count = np.array([1, 2, 3]), np.array([[4.0, 0.0], [0.0, 3.0], [2.0, 2.0]])
    total = np.array([6.0, 5.0])
    model = toxicity.Model(word, count, total, 3, 1.0)
    cut = np.array([1.2, 1.0])
    kept = np.maximum(count - cut, 0) / total
    back, shared = 1 - kept.sum(0), (count.sum(1) + 0.5) / (11 + 0.5 * 4)
    for k in range(3):
        p = kept[k] + back * shared[k]
        assert model.ratios[k + 1] == pytest.approx(np.log(p[1] / p[0]))


# SimHash


def plain_fingerprint(text, shingle=3):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = [*TEXTS, *fuzz(50), " ".join(map(str, range(200)))]
    rows = simhash.fingerprints(documents(spark, texts)).withColumn("hex", simhash.hexadecimal(F.col("fp"))).collect()
    assert [r.hex for r in sorted(rows)] == [f"{plain_fingerprint(t):016x}" for t in texts]


@pytest.mark.parametrize("crowd", [2000, 1, 0])
def test_simhash_links(spark, crowd):
    draw = random.Random(6)
    base = [draw.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in draw.sample(range(64), n)) for b in base for n in (0, 0, 1, 2, 2, 3, 4)}
    fps |= {base[0] ^ draw.getrandbits(32) for _ in range(30)} | {base[1] ^ draw.getrandbits(32) << 32 for _ in range(30)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = sorted(map(tuple, simhash.links(df, crowd=crowd).collect()))
    assert got == [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    with pytest.raises(ValueError):
        simhash.links(df, distance=3)


def test_simhash_components(spark):
    prints = spark.createDataFrame([(9, 0), (4, 1), (7, 3), (2, 0b111100000), (None, 0), (5, 0b1111), (6, 0b1111), (8, -1)], "doc_id long, fp long")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_dedup(prints).collect()}
    assert got == {(9, 0): 4, (4, 1): 4, (7, 3): 4, (2, 0b111100000): 2, (None, 0): 4, (5, 0b1111): 4, (6, 0b1111): 4, (8, -1): 8}
    assert simhash.near_dedup(simhash.fingerprints(empty(spark))).count() == 0


def test_near_copies(spark):
    draw = random.Random(8)
    fresh = lambda n: [f"{draw.choice('abcdefgh')}{draw.randrange(3000)}" for _ in range(n)]
    texts, group = [], []
    for g in range(30):
        base = fresh(300)
        for _ in range(4):
            copy = list(base)
            for p in draw.sample(range(300), 2):  # at most 10 of 296 shingles differ from the base's
                copy[p] = "changed" + str(draw.randrange(10**6))
            texts.append(" ".join(copy))
            group.append(g)
    texts += [" ".join(fresh(200)) for _ in range(50)]
    group += [f"alone {k}" for k in range(50)]
    kept = [r.doc_id for r in simhash.survivors(documents(spark, texts)).select("doc_id").collect()]
    assert len(kept) == len({group[k - 1] for k in kept}) == 80
    assert simhash.survivors(documents(spark)).columns == documents(spark).columns
    assert simhash.survivors(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert simhash.survivors(nulls).count() == 3


def test_near_copies_at_the_limit(spark):
    """Pairs of similarity 0.816 go to nearly the recall of the segments, pairs of 0.789 never."""
    draw = random.Random(21)
    texts = []
    for changes in [6] * 150 + [7] * 150:
        words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
        copy = list(words)
        for k in range(changes):  # far enough apart to change 5 of 296 shingles each
            copy[10 + 40 * k] = f"new{draw.randrange(10**6)}"
        texts += [" ".join(words), " ".join(copy)]
    kept = {r.doc_id for r in simhash.survivors(documents(spark, texts)).select("doc_id").collect()}
    missed = sum(2 * k + 2 in kept for k in range(150))
    wrong = sum(2 * k + 2 not in kept for k in range(150, 300))
    assert missed <= 20 and wrong == 0, (missed, wrong)
    assert all(2 * k + 1 in kept for k in range(300))


def similar_groups(texts, similarity=0.8, shingle=5):
    """The smallest number (from 1) of each text's group, by all pairs of sets of shingles."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set())
    low = list(range(len(texts)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return [root(k) + 1 for k in range(len(texts))]


@pytest.mark.parametrize(("crowded", "crowd", "block"), [(2, 256, 1024), (64, 256, 1024), (64, 20, 50)])
def test_near_copies_in_a_crowd(spark, monkeypatch, crowded, crowd, block):
    """Texts that share most of their words, some with a copy, beside one large group: as all pairs, whether buckets are filled, classes compared by blocks, or not."""
    for name, value in (("CROWDED", crowded), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(simhash, name, value)
    draw = random.Random(31)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(200), []
    for k in range(150):  # similarity 0.58 to each other
        own = [*passage, *fresh(70)]
        texts.append(" ".join(own))
        if k % 3 == 0:
            own[210] = own[240] = "other"
            texts.append(" ".join(own))
    base = fresh(300)
    for _ in range(300):  # one group
        copy = list(base)
        copy[draw.randrange(300)] = "changed" + str(draw.randrange(10**6))
        texts.append(" ".join(copy))
    kept = {r.doc_id for r in simhash.survivors(documents(spark, texts)).select("doc_id").collect()}
    true = set(similar_groups(texts))
    assert kept >= true and len(kept - true) <= 1  # the recall that segment_plan() aims at


def test_a_large_group_costs_few_pairs(spark, monkeypatch):
    """Candidates that are written stay below a few a text, though the group has nearly two million pairs."""
    draw = random.Random(32)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    texts = []
    for _ in range(2000):
        copy = list(base)
        for p in draw.sample(range(400), 3):
            copy[p] = str(draw.randrange(10**6))
        texts.append(" ".join(copy))
    written = []
    keep = common.Scratch.keep
    monkeypatch.setattr(common.Scratch, "keep", lambda self, df, name, **more: (out := keep(self, df, name, **more), written.append((name, out.count())))[0])
    kept = [r.doc_id for r in simhash.survivors(documents(spark, texts)).select("doc_id").collect()]
    assert kept == [1]
    assert sum(n for name, n in written if name == "candidates") < 12 * len(texts), written


def test_balls_meet_where_one_bit_differs(spark):
    """Two fingerprints share just one key of a segment if at most one bit of it differs, and none otherwise."""
    draw = np.random.default_rng(33)
    plan = (12, 6)
    places = simhash.segment_bits(*plan)
    x = draw.integers(0, 2, (40, simhash.WIDE_BITS)).astype(np.uint8)
    y = x.copy()
    for k in range(40):
        y[k, draw.choice(simhash.WIDE_BITS, 60, replace=False)] ^= 1
    rows = [(k, 0, *np.packbits(bits).view("<i8").tolist()) for k, bits in enumerate([*x, *y])]
    nodes = spark.createDataFrame(rows, ["id", "part", *simhash.WORDS])
    balls, centres = defaultdict(list), defaultdict(list)
    for r in simhash._entries(nodes, plan, range(6), 1).collect():
        balls[r.id].append(r.key)
    for r in simhash._entries(nodes, plan, range(6), 0).collect():
        centres[r.id].append(r.key)
    for k in range(40):
        for table in range(6):
            differ = int((x[k, places[table][:12]] != y[k, places[table][:12]]).sum())
            mine = lambda keys: {q for q in keys if q >> 48 == table}  # noqa: B023, E731
            met = (len(mine(balls[k]) & mine(centres[40 + k])), len(mine(balls[40 + k]) & mine(centres[k])))
            assert met == ((1, 1) if differ == 0 else (1, 0) if differ == 1 and sum(met) and met[0] else (0, 1) if differ == 1 else (0, 0))


def test_repeated_ids_keep_their_own_text(spark):
    text = " ".join(f"w{k}" for k in range(50))
    other = " ".join(f"v{k}" for k in range(50))
    rows = [(5, text), (5, other), (3, text + " more"), (None, text), (7, other), (7, other)]
    kept = simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(3, text + " more"), (5, other), (None, text)], key=str)


@pytest.mark.parametrize("few", [1 << 18, 60])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    draw = random.Random(9)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Embeddings


def brute_vectors(rows, threshold=0.93):
    ok = [(k, np.array(v, float), l) for k, v, l in rows if k is not None and v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = defaultdict(set)
    for i, (a, u, lu) in enumerate(ok):
        for b, v, lv in ok[:i]:
            if lu == lv and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                link[a].add(b)
                link[b].add(a)
    comp = {}
    for k in sorted(x for x, _, _ in rows if x is not None):
        if k not in comp:
            todo = [k]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = k
                    todo += link[x]
    return link, comp


def test_embeddings(spark):
    draw = np.random.default_rng(10)
    rows, k = [], 0
    for _ in range(60):
        base = draw.standard_normal(16)
        for _ in range(draw.integers(1, 5)):
            rows.append((k, (base + draw.standard_normal(16) * draw.choice([0.01, 0.1, 0.2])).tolist(), int(k % 2)))
            k += 1
    rows += [(1000 + j, [1.0] * 16, 0) for j in range(150)]  # more equal vectors than a window holds
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [float("nan")] * 16, 0), (2004, [float("inf")] * 16, 0), (2005, [1.0] * 16, None), (2006, [], 0), (2007, [1e-300] * 16, 0), (2008, [1.0] * 4, 0), (2009, [2.0] * 4, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    link, comp = brute_vectors([r for r in rows if r[0] != 2007])
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(df.withColumn("n_links", F.lit(1))).collect()}
    assert len(got) == len(rows)
    found, truth = sum(r.n_links for r in got.values() if r.vec_id < 1000), sum(len(link[x]) for x in link if x < 1000)
    assert 0.95 * truth <= found <= truth
    for j in range(150):
        assert (got[1000 + j].n_links, got[1000 + j].component_id) == (150, 1000)  # and the tiny vector of the same direction
    for x in (2000, 2001, 2002, 2003, 2004, 2005, 2006):
        assert (got[x].n_links, got[x].component_id, got[x].kept) == (0, x, True)
    assert got[2007].component_id == 1000 and got[2009].component_id == 2008
    wrong = [x for x, r in got.items() if x < 1000 and r.component_id != comp[x]]
    assert len(wrong) <= 0.05 * len(comp)


def test_links_outside_the_core(spark):
    """Two groups of equal vectors at cosine 0.95: the second is outside the first's core, and larger than the windows of all passes."""
    x, y = [1.0] + [0.0] * 7, [0.95, (1 - 0.95**2) ** 0.5] + [0.0] * 6
    rows = [(k, x if k < 2500 else y, 0) for k in range(5000)]
    got = embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), passes=4)
    assert {(r.n_links, r.component_id) for r in got.select("n_links", "component_id").distinct().collect()} == {(4999, 0)}


def test_dense_group(spark):
    """4,000 vectors of 64 dimensions whose mean cosine is 0.95: hardly any is in the core, and no window holds a vector's links."""
    draw = np.random.default_rng(5)
    base = draw.standard_normal(64)
    base /= np.linalg.norm(base)
    x = base + draw.standard_normal((4000, 64)) * (0.0526 / 64) ** 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_dedup(df).collect()}
    assert true.sum() > 7_000_000 and [got[k].n_links for k in range(4000)] == true.tolist()
    assert {r.component_id for r in got.values()} == {0}


def test_stars_connect():
    draw = np.random.default_rng(2)
    part = draw.integers(0, 60, 100)
    i, j = draw.integers(0, 100, 50), draw.integers(0, 100, 50)
    a, b = embedding_dedup._stars(part, i, j)

    def classes(pairs):
        low = {p: p for p in part.tolist()}
        for _ in low:
            for p, q in pairs:
                low[p] = low[q] = min(low[p], low[q])
        return low

    assert len(a) < 60 and classes(list(zip(a.tolist(), b.tolist(), strict=True))) == classes(list(zip(part[i].tolist(), part[j].tolist(), strict=True)))


def test_passes_follow_the_largest_label():
    assert embedding_dedup.passes_for(0, 0.93) == embedding_dedup.passes_for(20_000, 0.93) == embedding_dedup.PASSES
    assert embedding_dedup.passes_for(10**6, 0.93) < embedding_dedup.passes_for(10**8, 0.93) < 100


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_dedup(df).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id is None, r.n_links) for r in embedding_dedup.near_dedup(one).collect()) == [(False, 0), (True, 0)]


# Mixing


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    """Targets by the rule itself: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= above


def test_mixing(spark):
    draw = random.Random(11)
    rows = [(k, " ".join(["w"] * draw.randint(0, 60)) if k % 50 else None, draw.choices(["b", "a", "é", "zz", None, "tiny"], [50, 30, 5, 30, 10, 1])[0]) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("x"))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    targets, taken = water_fill(sizes), defaultdict(int)
    planned = mixing.plan(df).collect()
    for r in planned:
        assert r["__mix"].target == pytest.approx(targets[r.source]) and r["__mix"].source_size == sizes[r.source]
        assert r["__mix"].size == len((r.text or "").split()) and r["__mix"].copies <= 3
        taken[r.source] += r["__mix"].size * r["__mix"].copies
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.15 * t + 120
    copies = {r.doc_id: r["__mix"].copies for r in planned}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {k: c for k, c in copies.items() if c}
    assert copies == {r.doc_id: r["__mix"].copies for r in mixing.plan(df.repartition(9)).collect()}


def test_mixing_defined_cases(spark):
    assert mixing.mix(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, " \t", None)], "doc_id long, text string, source string")
    assert {(r["__mix"].size, r["__mix"].target, r["__mix"].copies) for r in mixing.plan(none).collect()} == {(0, 0.0, 0)}
    one = spark.createDataFrame([(1, "a b", "only"), (1, "a b", "only"), (None, "c", "only")], "doc_id long, text string, source string")
    assert {r["__mix"].copies for r in mixing.plan(one).collect()} == {1}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows of label 0 than the 20,000 that were once sampled."""
    n = 20_800
    ids = spark.range(n).withColumn("toxic", (F.col("id") % 50 == 0).cast("int"))
    labels = ids.select(F.col("id").alias("doc_id"), "toxic").persist()
    docs = ids.select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("plain"), F.when(F.col("toxic") == 1, "vile").otherwise("kind"), F.col("id").cast("string")).alias("text"))
    more = spark.range(n, 3 * n).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic"))
    labels, docs = labels.unionAll(more), docs.unionAll(more.select("doc_id", F.concat_ws(" ", F.lit("plain kind"), F.col("doc_id").cast("string")).alias("text")))
    seen = {}
    pairs = toxicity._pairs

    def counted(sample):
        seen.update({r.y: r["count"] for r in sample.groupBy("y").count().collect()})
        return pairs(sample)

    monkeypatch.setattr(toxicity, "_pairs", counted)
    toxicity.learn(docs, labels)
    want = defaultdict(int)
    for k in range(3 * n):
        if not held(k):
            want[int(k < n and k % 50 == 0)] += 1
    assert want[0] > 20_000 and seen == want
    monkeypatch.setattr(learning, "IDS", 100)  # by a shuffle
    assert learning.labelled_sample(docs, labels, "toxic", None)[0].groupBy("y").count().rdd.collectAsMap() == want


def test_rows_that_stand_for_several():
    """A curve from rows with their numbers is that of the rows repeated."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (40, 1)).astype(float)
    y, times = (x[:, 0] + rng.normal(0, 2, 40) > 0).astype(float), rng.integers(1, 9, 40).astype(float)
    many = times.astype(int)
    weight = learning.class_weights(y, {0: 70, 1: 30}, times)
    long = learning.class_weights(np.repeat(y, many), {0: 70, 1: 30})
    assert np.allclose(np.repeat(weight, many), long)
    assert np.allclose(learning.logistic(x, y, weight, times=times), learning.logistic(np.repeat(x, many, axis=0), np.repeat(y, many), long))
