"""The thin queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan

    docs = table(spark, sf_dir, "documents")
    out = fresh("mix", docs)
    m = F.col(out)
    found = plan(docs, out=out)
    return found.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"), m["copies"].alias("copies"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS most FROM s),
l AS (SELECT *, (SELECT sum(source_size) FROM s) AS total, (SELECT sum(weight) FROM w) AS weights,
             coalesce(sum(most) OVER b, 0) AS most_before, coalesce(sum(weight) OVER b, 0) AS weight_before
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (total - most_before)::DOUBLE / (weights - weight_before)::DOUBLE AS level FROM l),
c AS (SELECT *, most / weight < level AS capped FROM v),
t AS (SELECT *, (SELECT level FROM c WHERE NOT capped ORDER BY most / weight, source NULLS LAST LIMIT 1) AS share FROM c),
r AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE least(most::DOUBLE, share * weight) END AS target FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM r),
u AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.rate,
             ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS chance
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM u)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM k
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup, "op10_mixing": op10_mixing}
SQL = {"op5_exact_dedup": OP5_SQL, "op10_mixing": OP10_SQL}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_files

    path = Scratch(spark, "op6").path("ids")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(token_files.read(spark, path))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import byte_bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES |= {"op2_token_counts": op2_token_counts, "op6_token_files": op6_token_files, "op9_byte_bpe": op9_byte_bpe}


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.5)


QUERIES |= {"op3_language": op3_language, "op4_toxicity": op4_toxicity, "op8_quality": op8_quality}


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprints, hexadecimal, near_dedup

    found = near_dedup(fingerprints(table(spark, sf_dir, "documents"), shingle=3), distance=2)
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES |= {"op7_simhash": op7_simhash}


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES |= {"op1_embedding_dedup": op1_embedding_dedup}


#: Brute force over all pairs of a label, and reachability.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON p.a = r.reached),
m AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY 1)
SELECT m.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""

SQL["op1_embedding_dedup"] = OP1_SQL
