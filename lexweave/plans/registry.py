"""All queries of the text-comparison engine, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXACT
from ..functions import diffs as D
from ..functions import text as X
from ..operators import rank, report, score
from ..session import importable, table
from ..sources import catalog as licences
from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that checks it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


SPACES = X.SPACE_RE2 + "+"
NORM = f"replace(regexp_replace(text, '{SPACES}', ' ', 'g'), '.', '.' || chr(10))"
LINES = "regexp_extract_all({}, '[^\\n]*\\n|[^\\n]+')"
CATALOG = fixtures.values(licences.rows(), "ord, name, url, license_id, text")
DIFFS, HEADERS = fixtures.DIFFS, fixtures.HEADERS
#: Pairs of texts: each part's name and the next one's.
PAIRS = "(SELECT p.p_partkey AS id, p.p_name AS a, q.p_name AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_ranking(spark, sf_dir)


def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """left join right, dealt by the keys to all tasks of a shuffle: what follows costs far more than its rows' bytes tell."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.repartition(n, *keys), list(keys))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b"))
    return joined(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")), after, "id")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of longer texts: each turn of a conversation and the next."""
    t = table(spark, sf_dir, "conversations")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return joined(t.select("conv_id", "turn", F.col("text").alias("a")), after, "conv_id", "turn")


def line_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.line_scores(table(spark, sf_dir, "documents"), licences.catalog(spark))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of all documents as entries of a report; an entry's details are the licence's id."""
    rows = rank.ranking(line_scores(spark, sf_dir))
    return rows.select("doc_id", "rank", rank.licence(F.col("ord"), 0).alias("name"), rank.licence(F.col("ord"), 1).alias("url"), "pct", F.concat(F.lit("<span>"), "license_id", F.lit("</span>")).alias("diff_html"))


LINE_SCORES = f"""
WITH c AS (SELECT ord, license_id, name, url, {NORM} AS norm FROM {CATALOG}),
s AS (SELECT DISTINCT ord, unnest({LINES.format("norm")}) AS sentence FROM c),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {NORM} AS norm FROM documents WHERE length(text) > 0),
e AS (SELECT rid, unnest({LINES.format("norm")}) AS sentence FROM d),
m AS (SELECT rid, ord, sum(length(sentence)) AS mct FROM e JOIN s USING (sentence) GROUP BY 1, 2),
p AS (SELECT rid, doc_id, length(norm)::INT AS n_chars, c.ord, c.license_id, c.name, c.url, coalesce(mct, 0)::BIGINT AS mct,
             coalesce(mct, 0) * 100.0::DOUBLE / length(norm) AS pct
      FROM d CROSS JOIN (SELECT ord, license_id, name, url FROM c) c LEFT JOIN m USING (rid, ord)),
r AS (SELECT *, '<span>' || license_id || '</span>' AS diff_html, row_number() OVER (PARTITION BY rid ORDER BY pct DESC, ord)::INT AS rank FROM p)
"""


# The catalogue and its texts


@query(f"SELECT ord, name, url, license_id FROM {CATALOG}")
def catalog_scan(spark, sf_dir):
    return licences.catalog(spark).select("ord", "name", "url", "license_id")


@query(f"SELECT license_id, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes FROM {CATALOG}")
def catalog_text_stats(spark, sf_dir):
    files = licences.scan_texts(spark, f"file://{licences.TEXTS}")
    return files.select("license_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))


@query(f"SELECT ord, license_id, {NORM} AS norm_text, length({NORM})::INT AS n_chars FROM {CATALOG}")
def catalog_normalized(spark, sf_dir):
    return licences.catalog(spark).select("ord", "license_id", "norm_text", F.length("norm_text").alias("n_chars"))


@query(f"SELECT doc_id, {NORM} AS norm_text FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("norm_text"))


@query("SELECT doc_id, length(text)::INT AS n_chars FROM documents WHERE length(text) > 0")
def non_empty_documents(spark, sf_dir):
    return score.non_empty(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").alias("n_chars"))


@query(f"SELECT doc_id, ord, license_id FROM documents CROSS JOIN {CATALOG} WHERE length(documents.text) > 0")
def document_license_pairs(spark, sf_dir):
    keys = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(row[2]).alias("license_id")) for k, row in enumerate(licences.LICENSES)])
    return score.non_empty(table(spark, sf_dir, "documents")).select("doc_id", F.explode(keys).alias("c")).select("doc_id", "c.*")


# Scores and ranking


@query(LINE_SCORES + "SELECT doc_id, ord, mct, pct FROM p WHERE mct > 0")
def sentence_overlap(spark, sf_dir):
    found = F.filter("scores", lambda s: s["mct"] > 0)
    return line_scores(spark, sf_dir).select("doc_id", found.alias("scores")).select("doc_id", F.explode_outer("scores").alias("s")).select("doc_id", "s.*").filter("mct > 0")


@query(LINE_SCORES + "SELECT doc_id, rank, ord, license_id, mct, pct, floor(pct + 0.5)::BIGINT AS rounded, rank = 1 OR (rank <= 3 AND pct >= 20) AS keeps_detail FROM r")
def license_ranking(spark, sf_dir):
    return rank.ranking(line_scores(spark, sf_dir))


@query(LINE_SCORES + "SELECT doc_id, n_chars, ord, name, license_id, mct, pct FROM r WHERE rank = 1")
def best_license(spark, sf_dir):
    return rank.best(line_scores(spark, sf_dir))


@query(
    f"""
WITH c AS (SELECT ord, license_id, {NORM} AS norm FROM {CATALOG}),
l AS (SELECT DISTINCT line FROM (SELECT unnest({LINES.format("text")}) AS line FROM documents) WHERE regexp_matches(line, '(?i)licen[cs]e')),
n AS (SELECT line, {NORM.replace("text", "line")} AS norm FROM l)
SELECT line, ord, license_id FROM n LEFT JOIN c ON contains(c.norm, n.norm)
"""
)
def license_lines(spark, sf_dir):
    """Lines of documents that name a licence, and the licences that contain them; null where none does."""
    each = table(spark, sf_dir, "documents").select(F.explode(X.lines(F.col("text"))).alias("line")).filter(F.col("line").rlike("(?i)licen[cs]e")).distinct()
    known = F.broadcast(licences.catalog(spark).select("ord", "license_id", "norm_text"))
    return each.join(known, F.contains("norm_text", X.normalize(F.col("line"))), "left").select("line", "ord", "license_id")


@query()
def license_match_chars(spark, sf_dir):
    """The diff score: characters that a diff of bounded work leaves equal."""
    found = score.diff_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.ord", "s.mct")


@query()
def pair_metrics(spark, sf_dir):
    found = score.diff_scores(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    names = F.array(*[F.lit(row[0]) for row in licences.LICENSES])
    return found.select("doc_id", "n_chars", F.explode("scores").alias("s")).select("doc_id", "n_chars", "s.mct", "s.pct", F.element_at(names, F.col("s.ord") + 1).alias("name"))


@query()
def best_license_by_diff(spark, sf_dir):
    return rank.best(score.diff_scores(table(spark, sf_dir, "documents")))


@query(
    f"""SELECT id, coalesce(list_sum([length(x.text) FOR x IN diff IF x.op = 0]), 0)::INT AS mct,
    coalesce(list_sum([length(x.text) FOR x IN diff IF x.op = 0]), 0) * 100.0::DOUBLE / length(list_aggregate([x.text FOR x IN diff IF x.op <> 1], 'string_agg', '')) AS pct
    FROM {DIFFS} WHERE len(diff) > 0"""
)
def match_percent_from_segments(spark, sf_dir):
    d = fixtures.diffs(spark, sf_dir).filter(F.size("diff") > 0).withColumn("mct", D.equal_length(F.col("diff")))
    return d.select("id", "mct", score.percent(F.col("mct"), F.length(D.source_text(F.col("diff")))).alias("pct"))


@query(LINE_SCORES + "SELECT doc_id, rank, pct, floor(pct + 0.5)::BIGINT AS rounded FROM r")
def rounded_percent(spark, sf_dir):
    return entries(spark, sf_dir).select("doc_id", "rank", "pct", score.rounded(F.col("pct")).alias("rounded"))


# Pairs of texts


def _prefix_sql(a: str, b: str) -> str:
    return f"coalesce(list_max([k FOR k IN range(1, least(length({a}), length({b})) + 1) IF left({a}, k) = left({b}, k)]), 0)::INT"


@query(f"SELECT id, {_prefix_sql('a', 'b')} AS n FROM {PAIRS}")
def common_prefix_len(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", X.common_prefix(F.col("a"), F.col("b")).alias("n"))


@query(f"SELECT id, {_prefix_sql('reverse(a)', 'reverse(b)')} AS n FROM {PAIRS}")
def common_suffix_len(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", X.common_suffix(F.col("a"), F.col("b")).alias("n"))


@query(f"SELECT id, coalesce(list_max([k FOR k IN range(1, least(length(a), length(b)) + 1) IF right(a, k) = left(b, k)]), 0)::INT AS n FROM {PAIRS}")
def common_overlap_len(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", X.common_overlap(F.col("a"), F.col("b")).alias("n"))


@query(
    f"""SELECT id, CASE WHEN contains(a, b) THEN length(b) WHEN contains(b, a) THEN length(a) END::INT AS common,
    CASE WHEN contains(a, b) THEN strpos(a, b) - 1 WHEN contains(b, a) THEN strpos(b, a) - 1 END::INT AS at FROM {PAIRS}"""
)
def containment_fast_path(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    common = F.when(F.contains(a, b), F.length(b)).when(F.contains(b, a), F.length(a))
    at = F.when(F.contains(a, b), F.position(b, a) - 1).when(F.contains(b, a), F.position(a, b) - 1)
    return pairs(spark, sf_dir).select("id", common.alias("common"), at.alias("at"))


LCS = f"""
WITH RECURSIVE p AS (SELECT id, a, b FROM {PAIRS}),
dp(id, a, b, i, cells) AS (
  SELECT id, a, b, 0, [0 FOR _ IN range(length(b) + 1)] FROM p
  UNION ALL
  SELECT id, a, b, i + 1, list_reduce(list_prepend([0]::INT[], [[j]::INT[] FOR j IN range(1, length(b) + 1)]),
    LAMBDA acc, jj: list_append(acc, CASE WHEN a[i + 1] = b[jj[1]] THEN cells[jj[1]] + 1 ELSE greatest(acc[jj[1]], cells[jj[1] + 1]) END)::INT[])
  FROM dp WHERE i < length(a))
SELECT id, cells[-1]::INT AS lcs FROM dp WHERE i = length(a)
"""


@query(LCS)
def diff_exact_lcs(spark, sf_dir):
    importable(spark)
    return pairs(spark, sf_dir).select("id", D.equal_length(D.diff(F.col("a"), F.col("b"), False, EXACT)).alias("lcs"))


@query(f"SELECT id, a AS source, b AS target, true AS same FROM {PAIRS}")
def diff_short_texts(spark, sf_dir):
    """Diffs of all pairs, by the texts that they lead from and to."""
    importable(spark)
    d = pairs(spark, sf_dir).withColumn("diff", D.diff(F.col("a"), F.col("b")))
    same = (F.length("a") - D.equal_length(F.col("diff"))) <= D.edit_cost(F.col("diff"))
    return d.select("id", D.source_text(F.col("diff")).alias("source"), D.target_text(F.col("diff")).alias("target"), same.alias("same"))


@query()
def diff_turns(spark, sf_dir):
    """Diffs of each conversation's neighbouring turns, segment by segment."""
    importable(spark)
    d = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(D.diff(F.col("a"), F.col("b"))).alias("place", "s"))
    return d.select("conv_id", "turn", "place", "s.op", "s.text")


@query("SELECT conv_id, turn, '' AS a_pre, '' AS a_post, '<' AS b_pre, '>' AS b_post, text AS common FROM conversations WHERE length(text) > 1")
def half_match(spark, sf_dir):
    """Each turn and the same between brackets: all of it is the common middle."""
    importable(spark)
    t = table(spark, sf_dir, "conversations").filter(F.length("text") > 1)
    return t.select("conv_id", "turn", D.half_match(F.col("text"), F.concat(F.lit("<"), "text", F.lit(">"))).alias("h")).select("conv_id", "turn", "h.*")


@query(
    f"""WITH p AS (SELECT conv_id, turn, {LINES.format('text')} AS l FROM conversations),
    q AS (SELECT p.conv_id, p.turn, p.l AS la, n.l AS lb, list_concat(p.l, n.l) AS xs FROM p JOIN p n ON n.conv_id = p.conv_id AND n.turn = p.turn + 1),
    u AS (SELECT *, [x FOR x, k IN xs IF list_position(xs, x) = k] AS d FROM q)
    SELECT conv_id, turn, array_to_string([list_position(d, x)::INT FOR x IN la], ',') AS codes1, array_to_string([list_position(d, x)::INT FOR x IN lb], ',') AS codes2, array_to_string(list_prepend('', d), '|') AS lines FROM u"""
)
def line_dictionary(spark, sf_dir):
    d = turns(spark, sf_dir).select("conv_id", "turn", X.line_dictionary(F.col("a"), F.col("b")).alias("x"))
    joined = lambda name: F.array_join(F.col(f"x.{name}").cast("array<string>"), ",").alias(name)
    return d.select("conv_id", "turn", joined("codes1"), joined("codes2"), F.array_join("x.lines", "|").alias("lines"))


@query("SELECT t.conv_id, t.turn, t.text AS a, n.text AS b FROM conversations t JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1")
def line_dictionary_roundtrip(spark, sf_dir):
    d = turns(spark, sf_dir).select("conv_id", "turn", X.line_dictionary(F.col("a"), F.col("b")).alias("x"))
    back = lambda name: X.from_codes(F.col(f"x.{name}"), F.col("x.lines"))
    return d.select("conv_id", "turn", back("codes1").alias("a"), back("codes2").alias("b"))


# Clean-ups


#: A clean-up keeps the texts that a diff leads from and to; its other results are pinned by tests.
TURNS = "SELECT t.conv_id, t.turn, t.text AS source, n.text AS target FROM conversations t JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1"


def _tidied(spark: SparkSession, sf_dir: str, tidy: Callable[[Column], Column]) -> DataFrame:
    importable(spark)
    d = turns(spark, sf_dir).select("conv_id", "turn", tidy(D.diff(F.col("a"), F.col("b"))).alias("tidied"))
    return d.select("conv_id", "turn", D.source_text(F.col("tidied")).alias("source"), D.target_text(F.col("tidied")).alias("target"))


@query(TURNS)
def cleanup_merge(spark, sf_dir):
    return _tidied(spark, sf_dir, D.merge)


@query(TURNS)
def cleanup_semantic(spark, sf_dir):
    return _tidied(spark, sf_dir, D.semantic)


@query(TURNS)
def cleanup_lossless(spark, sf_dir):
    return _tidied(spark, sf_dir, D.lossless)


@query(TURNS)
def cleanup_efficiency(spark, sf_dir):
    return _tidied(spark, sf_dir, D.efficiency)


# Reading diffs


def _before(op: int) -> str:
    return f"coalesce(list_sum([length(x.text) FOR x, k IN diff IF k < i AND x.op <> {op}]), 0)"


@query(
    f"""WITH d AS (SELECT id, place, diff, unnest(range(1, len(diff) + 1)) AS i FROM {DIFFS}),
    s AS (SELECT id, place, i, diff[i].op AS op, length(diff[i].text) AS n, {_before(1)} AS before, {_before(-1)} AS after FROM d),
    h AS (SELECT id, place, arg_min(CASE WHEN op = -1 THEN after ELSE after + place - before END, i) AS at FROM s WHERE op <> 1 AND before + n > place GROUP BY 1, 2),
    e AS (SELECT id, place, coalesce(list_sum([length(x.text) FOR x IN diff IF x.op <> -1]), 0) + place - coalesce(list_sum([length(x.text) FOR x IN diff IF x.op <> 1]), 0) AS at FROM {DIFFS})
    SELECT e.id, e.place, coalesce(h.at, e.at)::INT AS at FROM e LEFT JOIN h USING (id)"""
)
def position_map(spark, sf_dir):
    return fixtures.diffs(spark, sf_dir).select("id", "place", D.map_position(F.col("diff"), F.col("place")).alias("at"))


HTML = "replace(replace(replace(replace(x.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&para;<br>')"
HTML = f"CASE x.op WHEN 1 THEN '<ins style=\"background:#e6ffe6;\">' || {HTML} || '</ins>' WHEN -1 THEN '<del style=\"background:#ffe6e6;\">' || {HTML} || '</del>' ELSE '<span>' || {HTML} || '</span>' END"


@query(f"SELECT id, array_to_string([{HTML} FOR x IN diff], '') AS html FROM {DIFFS}")
def diff_html(spark, sf_dir):
    return fixtures.diffs(spark, sf_dir).select("id", D.html(F.col("diff")).alias("html"))


@query(f"SELECT id, array_to_string([x.text FOR x IN diff IF x.op <> 1], '') AS text FROM {DIFFS}")
def diff_source_text(spark, sf_dir):
    return fixtures.diffs(spark, sf_dir).select("id", D.source_text(F.col("diff")).alias("text"))


@query(f"SELECT id, array_to_string([x.text FOR x IN diff IF x.op <> -1], '') AS text FROM {DIFFS}")
def diff_target_text(spark, sf_dir):
    return fixtures.diffs(spark, sf_dir).select("id", D.target_text(F.col("diff")).alias("text"))


@query(
    f"""WITH d AS (SELECT id, diff, unnest(range(1, len(diff) + 1)) AS i FROM {DIFFS}),
    r AS (SELECT id, len([x FOR x, k IN diff IF k < i AND x.op = 0]) AS run, diff[i].op AS op, length(diff[i].text) AS n FROM d),
    g AS (SELECT id, run, greatest(coalesce(sum(n) FILTER (op = 1), 0), coalesce(sum(n) FILTER (op = -1), 0)) AS cost FROM r GROUP BY 1, 2)
    SELECT v.id, coalesce(sum(cost), 0)::INT AS cost FROM {DIFFS} LEFT JOIN g USING (id) GROUP BY 1"""
)
def diff_levenshtein(spark, sf_dir):
    return fixtures.diffs(spark, sf_dir).select("id", D.edit_cost(F.col("diff")).alias("cost"))


@query(
    f"""SELECT id, array_to_string([CASE x.op WHEN 1 THEN '+' || replace(replace(replace(x.text, '<', '%3C'), '>', '%3E'), chr(10), '%0A')
    WHEN -1 THEN '-' || length(x.text) ELSE '=' || length(x.text) END FOR x IN diff], chr(9)) AS delta FROM {DIFFS}"""
)
def delta_encode(spark, sf_dir):
    importable(spark)
    return fixtures.diffs(spark, sf_dir).select("id", D.to_delta(F.col("diff")).alias("delta"))


@query(f"SELECT id, b AS target FROM {PAIRS}")
def delta_decode(spark, sf_dir):
    """The second text of each pair, read back from the first and a delta."""
    importable(spark)
    delta = D.to_delta(D.diff(F.col("a"), F.col("b")))
    return pairs(spark, sf_dir).select("id", D.target_text(D.from_delta(F.col("a"), delta)).alias("target"))


# Location


@query(
    f"""SELECT id, CASE WHEN a = pattern THEN 0 WHEN length(a) = 0 THEN -1 WHEN substr(a, spot + 1, length(pattern)) = pattern THEN spot END::INT AS place
    FROM (SELECT id, a, right(a, 4) AS pattern, greatest(length(a) - 4, 0) AS spot FROM {PAIRS})"""
)
def match_exact(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", X.exact_location(F.col("a"), F.right("a", F.lit(4)), F.greatest(F.length("a") - 4, F.lit(0))).alias("place"))


#: Fewest errors from each place, by a table of edit distances from the right, then the place of least badness.
FUZZY = f"""
WITH RECURSIVE p AS (SELECT id, a, left(b, 32) AS pattern FROM {PAIRS}),
dp(id, a, r, i, cells) AS (
  SELECT id, reverse(a), reverse(pattern), 0, [k::INT FOR k IN range(length(pattern) + 1)] FROM p
  UNION ALL
  SELECT id, a, r, i + 1, list_reduce(list_prepend([0]::INT[], [[k]::INT[] FOR k IN range(1, length(r) + 1)]),
    LAMBDA acc, k: list_append(acc, least(cells[k[1]] + CASE WHEN r[k[1]] = a[i + 1] THEN 0 ELSE 1 END, acc[k[1]] + 1, cells[k[1] + 1] + 1))::INT[])
  FROM dp WHERE i < length(a)),
s AS (SELECT id, length(a) - i AS spot, cells[-1] AS errors, length(r) AS n, cells[-1] / length(r)::DOUBLE + (length(a) - i) / 1000.0::DOUBLE AS badness FROM dp WHERE i > 0 AND length(r) > 0),
f AS (SELECT id, spot FROM s WHERE errors < n AND badness <= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY badness, errors DESC, spot) = 1)
SELECT p.id, CASE WHEN a = pattern THEN 0 WHEN length(a) = 0 THEN -1 WHEN starts_with(a, pattern) THEN 0 ELSE coalesce(f.spot, -1) END::INT AS place
FROM p LEFT JOIN f USING (id)
"""


@query(FUZZY)
def match_fuzzy(spark, sf_dir):
    """Where the next part's name, or its first 32 characters, is best found in a part's name."""
    importable(spark)
    return pairs(spark, sf_dir).select("id", D.locate_fuzzy(F.col("a"), F.substring("b", 1, 32), F.lit(0)).alias("place"))


@query(
    """WITH c AS (SELECT p_partkey AS id, p_name AS p, unnest(range(1, length(p_name) + 1)) AS i FROM part)
    SELECT id, p[i] AS c, bit_or(1 << (length(p) - i)::INT)::INT AS bits FROM c GROUP BY 1, 2"""
)
def bitap_alphabet(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("p"))
    return p.select("id", F.explode(D.bitap_alphabet(F.col("p"))).alias("c", "bits"))


# Patches


@query()
def patch_make(spark, sf_dir):
    importable(spark)
    made = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(D.patch_make(F.col("a"), F.col("b"))).alias("place", "p"))
    return made.select("conv_id", "turn", "place", D.patch_header(F.col("p")).alias("header"), F.size("p.diffs").alias("n_segments"))


@query(f"SELECT id, b AS text, true AS applied FROM {PAIRS}")
def patch_roundtrip(spark, sf_dir):
    importable(spark)
    done = pairs(spark, sf_dir).select("id", D.patch_apply(D.patch_make(F.col("a"), F.col("b")), F.col("a")).alias("r"))
    return done.select("id", "r.text", F.forall("r.applied", lambda x: x).alias("applied"))


@query(f"SELECT id, true AS same FROM {PAIRS}")
def patch_text(spark, sf_dir):
    """Patches written, read, and written again."""
    importable(spark)
    text = D.patch_to_text(D.patch_make(F.col("a"), F.col("b")))
    return pairs(spark, sf_dir).select("id", text.alias("t")).select("id", (D.patch_to_text(D.patch_from_text(F.col("t"))) == F.col("t")).alias("same"))


@query("SELECT t.conv_id, t.turn, n.text AS text, true AS applied FROM conversations t JOIN conversations n ON n.conv_id = t.conv_id AND n.turn = t.turn + 1")
def patch_turns(spark, sf_dir):
    """Patches of longer texts, in several places and pieces, written, read and applied."""
    importable(spark)
    made = D.patch_from_text(D.patch_to_text(D.patch_make(F.col("a"), F.col("b"))))
    done = turns(spark, sf_dir).select("conv_id", "turn", D.patch_apply(made, F.col("a")).alias("r"))
    return done.select("conv_id", "turn", "r.text", F.forall("r.applied", lambda x: x).alias("applied"))


@query(f"SELECT id, a AS text, true AS refused_delta, true AS refused_patch FROM {PAIRS}")
def refused_input(spark, sf_dir):
    """The error boundary: a delta that is too long and a patch without a header give null, and other columns of the row stay."""
    importable(spark)
    delta = F.concat(F.lit("="), (F.length("a") + 1).cast("string"))
    some = pairs(spark, sf_dir).select("id", F.col("a").alias("text"), D.from_delta(F.col("a"), delta, strict=False).alias("d"), D.patch_from_text(F.concat(F.lit("@ "), "a"), strict=False).alias("p"))
    return some.select("id", "text", F.col("d").isNull().alias("refused_delta"), F.col("p").isNull().alias("refused_patch"))


@query(f"SELECT id, start1, length1, start2, length2 FROM {HEADERS}")
def patch_header_parse(spark, sf_dir):
    return fixtures.headers(spark, sf_dir).select("id", D.parse_header(F.col("header")).alias("h")).select("id", "h.*")


@query(f"SELECT id, header FROM {HEADERS}")
def patch_header_format(spark, sf_dir):
    patch = F.struct("start1", "length1", "start2", "length2")
    return fixtures.headers(spark, sf_dir).select("id", patch.alias("p")).select("id", D.patch_header(F.col("p")).alias("header"))


# The report


KEPT = "CASE WHEN rank = 1 OR (rank <= 3 AND pct >= 20) THEN diff_html END"
_OPEN, _CLOSE = report.ENTRY.replace("%%", "%").rsplit("%d", 1)
_HREF, _NAME, _AFTER = _OPEN.split("%s")
LINE = f"'{_HREF}' || url || '{_NAME}' || name || '{_AFTER}' || floor(pct + 0.5)::BIGINT || '{_CLOSE}'"


@query(LINE_SCORES + f"SELECT doc_id, rank, {KEPT} AS diff_html FROM r")
def top3_retention(spark, sf_dir):
    r = entries(spark, sf_dir)
    return r.select("doc_id", "rank", F.when(rank.keeps_detail(F.col("rank"), F.col("pct")), F.col("diff_html")).alias("diff_html"))


@query(LINE_SCORES + f"SELECT doc_id, rank, {LINE} AS line FROM r")
def report_line(spark, sf_dir):
    return entries(spark, sf_dir).select("doc_id", "rank", report.line(F.col("name"), F.col("url"), F.col("pct")).alias("line"))


DETAIL = f"coalesce('{report.DETAIL_OPEN}' || {KEPT} || '{report.DETAIL_CLOSE}', '')"


@query(LINE_SCORES + f"SELECT any_value(doc_id) AS doc_id, string_agg({LINE} || {DETAIL} || '</li>', '' ORDER BY rank) AS html FROM r GROUP BY rid")
def report_html(spark, sf_dir):
    return report.assemble(entries(spark, sf_dir))


@query()
def document_report(spark, sf_dir):
    """The whole report of each document: ranking, and the diffs of the licences that keep their details."""
    importable(spark)
    return report.of_documents(table(spark, sf_dir, "documents"), licences.catalog(spark))
