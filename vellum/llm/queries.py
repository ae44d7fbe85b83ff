"""One query per training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, extract, gif, lines, negatives, packing, pii, quality, sharding, simhash, toxicity, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies on this machine and on each executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer("word_bpe_49k.json"), digests=True)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.store_texts(table(spark, sf_dir, "documents")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))  # no table labels pages; the explicit rules do


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe_chunks, op2_quality_rules, op3_simhash, op4_url_filters, op5_line_dedup, op6_pii_spans, op7_gif_media,
        op8_best_fit_packing, op9_shard_shuffle, op10_toxicity, op11_hard_negatives,
        op12_html_extraction, op13_vector_codes,
    )
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _codes_sql() -> str:
    """The rounds of vector codes as one table expression each."""
    assign = """
{name} AS MATERIALIZED (SELECT vec_id, n, p, v, i, d FROM (SELECT r.vec_id, r.n, r.p, r.v, b.i,
    list_sum(list_transform(list_zip(r.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts r JOIN {book} b ON r.p = b.p)
  QUALIFY row_number() OVER (PARTITION BY n, p ORDER BY d, i) = 1)"""
    update = """
b{k} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.v, b.v) AS v FROM b{before} b LEFT JOIN
  (SELECT p, i, list(v ORDER BY j) AS v FROM (SELECT p, i, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS v
      FROM (SELECT p, i, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM a{k}) GROUP BY p, i, j) GROUP BY p, i) m ON b.p = m.p AND b.i = m.i)"""
    rounds = ",".join(
        assign.format(name=f"a{k}", book=f"b{k - 1}") + "," + update.format(k=k, before=k - 1) for k in range(1, codes.ROUNDS + 1)
    )
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n,
    list_transform(embedding, lambda x: floor({codes.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
parts AS MATERIALIZED (SELECT vec_id, n, p, v[p * len(v) // 8 + 1 : (p + 1) * len(v) // 8] AS v FROM kept, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS i, v FROM parts WHERE n <= {codes.ENTRIES}),{rounds},{assign.format(name="last", book=f"b{codes.ROUNDS}")},
coded AS (SELECT n, string_agg(printf('%02x', i), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY n)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM b{codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (n)"""


#: The others need learned models, fingerprints, tokenizers, media or checksums that SQL lacks; tests hold them
#: against brute-force versions.
ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""",
    "op13_vector_codes": _codes_sql(),
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT *, list_filter(string_split_regex(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
e AS (SELECT *, array_to_string(w, ' ') AS k, doc_id * 100000 + n AS p FROM w WHERE len(w) > 0),
c AS (SELECT k, any_value(w) AS w, min(p) AS p FROM e GROUP BY k), m AS (FROM c WHERE len(w) >= 5),
v AS (SELECT k, p, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m)),
slot AS (SELECT v, i, min(p) AS low FROM v GROUP BY ALL),
longer AS (SELECT v, min(p) AS low FROM v GROUP BY v),
late AS (SELECT v.k FROM v JOIN slot ON v.v = slot.v AND v.i = slot.i WHERE low < p
  UNION SELECT m.k FROM m JOIN longer ON v = k WHERE low < p
  UNION SELECT v.k FROM v JOIN m ON v.v = m.k WHERE m.p < v.p),
gone AS (SELECT DISTINCT e.doc_id, e.n FROM e JOIN c USING (k) WHERE e.p <> c.p OR k IN (FROM late)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.n) FILTER (g.n IS NULL), '') AS kept
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM t""",
}
