"""Queries of the operators, one each, with production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from bidframe.llm import (collocations, decontaminate, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, mixing,
                          pii, quality, secrets, substring_dedup, toxicity, url_filter)
from bidframe.llm.common import table


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _counted(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _counted(pii.find(docs, pii.train(docs)), pii.KINDS)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, pages.select(F.col("html").alias("text"))).select(
        "page_id", "host", "path", "rule", "verdict", "score", F.array_join("words", " ").alias("words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"), k=4, percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.cycle_weights(docs)).select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _counted(secrets.scan(docs, secrets.train(docs)), secrets.KINDS)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(spark, f"{sf_dir}/documents.parquet")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_url_filter, op3_decontaminate, op4_quality, op5_jaccard_join,
                            op6_substring_dedup, op7_toxicity, op8_mixing, op9_embedding_dedup, op10_secrets, op11_exact_dedup,
                            op12_collocations, op13_hard_negatives)}

ORACLES: dict[str, str] = {
    "op11_exact_dedup": f"""
WITH normal AS (SELECT doc_id, translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY t)""",
    # Closed form of the water-filling: sources in order of size by weight; those before the
    # first that its share fits are at their cap.
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || CAST(doc_id AS VARCHAR)) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
ranked AS (
  SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
         CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS used,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS left_weight,
         row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS n
  FROM weighed
  WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (budget - used) / CAST(left_weight AS DOUBLE) AS lam, n FROM ranked
  WHERE weight * ((budget - used) / CAST(left_weight AS DOUBLE)) < cap ORDER BY n LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(weight AS DOUBLE) * coalesce((SELECT lam FROM level), 1e300), CAST(cap AS DOUBLE)) AS target
  FROM ranked),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS part,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken
FROM placed""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, words, array_to_string(list_slice(w, i, i + words - 1), ' ') AS phrase
  FROM placed, (VALUES (1), (2), (3), (4), (5)) AS v(words) WHERE i + words - 1 <= len(w)),
counts AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE words > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r,
         CAST(1000::HUGEINT * c.a * s.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score, s.n
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates) c
  JOIN sizes s ON s.lang = c.lang
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.words), ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, words - size + 2)) AS i
        FROM (SELECT *, unnest(range(2, words)) AS size FROM candidates)) ),
longer AS (SELECT lang, phrase, max(a) AS a FROM parts GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN longer p ON p.lang = w.lang AND p.phrase = w.phrase
  WHERE p.a IS NULL OR 100 * p.a < 100 * w.a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
  FROM kept) WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH fit AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM fit a JOIN fit b ON a.id % 100 = 0 AND a.id <> b.id),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10""",
}
