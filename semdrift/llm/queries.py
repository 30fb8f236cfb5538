"""The operators as named queries over the given tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.llm import (
    audit, contextmix, decontaminate, exact, htmltree, lines, packing, pivotsearch, quality, resample, simhash, tokenfiles, toxicity,
)
from semdrift.llm.common import crc_mod, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A-Z alone, in SQL.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), remainder != 0)
    return _judged(toxicity.score(docs, model), remainder == 0)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = f"""
WITH normal AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM normal JOIN groups USING (text_sha256)
"""


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_boilerplate(docs, n_lines="n_lines", n_dropped="n_dropped").drop("source")


_BARE = "trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"
ORACLES["op4_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || source, '') AS host, text FROM documents),
lines AS (
  SELECT row, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
totals AS (SELECT host, count(*) AS host_pages FROM docs GROUP BY 1),
pages AS (
  SELECT host, {_BARE} AS bare, count(DISTINCT row) AS pages FROM lines WHERE {_BARE} <> '' GROUP BY 1, 2),
drops AS (
  SELECT host, bare, true AS hit FROM pages JOIN totals USING (host)
  WHERE pages >= {lines.MIN_PAGES} AND pages >= host_pages * CAST({lines.RATIO} AS DOUBLE)),
marked AS (
  SELECT l.row, l.line, l.pos, coalesce(d.hit, false) AS hit
  FROM lines l LEFT JOIN drops d ON d.host = l.host AND d.bare = {_BARE.replace('line', 'l.line')})
SELECT min(d.doc_id) AS doc_id,
       CASE WHEN min(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.hit), '') END AS text,
       CAST(count(m.pos) AS BIGINT) AS n_lines, CAST(count(m.pos) FILTER (m.hit) AS BIGINT) AS n_dropped
FROM docs d LEFT JOIN marked m USING (row) GROUP BY row
"""


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_AT = decontaminate.WINDOW
ORACLES["op5_decontaminate"] = f"""
WITH doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {_AT}) AS size,
         array_to_string(w[i:i + least(len(w), {_AT}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {_AT} + 1, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, i, g.size, item_id FROM grams g JOIN windows x ON x.size = g.size AND x.gram = g.gram),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, remainder = read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3)
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), remainder != 1)
    return _judged(quality.score(docs.select("doc_id", "text"), model), remainder == 1)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc_mod(F.col("doc_id"), 7)
    scored = contextmix.lm_scores(read_table(spark, sf_dir, "documents"), remainder != 2)
    return scored.withColumn("held_out", remainder == 2)


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return htmltree.extract(pages, htmltree.fit(pages))


@query
def op10_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return tokenfiles.token_files(read_table(spark, sf_dir, "documents"), path)


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", read_table(spark, sf_dir, "labels"))


_FAILS = "CASE letter {} END".format(" ".join(f"WHEN '{x}' THEN fails_{x.lower()}" for x in audit.FILTERS))
ORACLES["op11_filter_audit"] = f"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM words GROUP BY t),
known AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, len(w) < 50 AS fails_a, 100 * len(list_distinct(w)) < 65 * len(w) AS fails_b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS fails_c,
         regexp_matches(t, '[#$%&*|]') AS fails_d, words.doc_id > first_id AS fails_e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM words JOIN firsts USING (t) LEFT JOIN known ON known.doc_id = words.doc_id),
kinds AS (
  SELECT part, fails_a, fails_b, fails_c, fails_d, fails_e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic,
         fails_a::INT + fails_b::INT + fails_c::INT + fails_d::INT + fails_e::INT AS failed
  FROM judged GROUP BY part, fails_a, fails_b, fails_c, fails_d, fails_e),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, letter, n, good, toxic, failed, {_FAILS} AS fails,
         (fails_a AND contains(before, 'A')) OR (fails_b AND contains(before, 'B')) OR (fails_c AND contains(before, 'C'))
         OR (fails_d AND contains(before, 'D')) OR (fails_e AND contains(before, 'E')) AS gone
  FROM kinds, steps),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0) AS unique_fails,
         coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""


@query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivotsearch.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLES["op12_exact_top_k"] = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score
FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


@query
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SIZE = resample.BUCKETS
ORACLES["op13_importance_resample"] = f"""
WITH RECURSIVE steps(byte, k, crc) AS (
  SELECT byte, 0, CAST(byte AS UBIGINT) FROM (SELECT unnest(range(256)) AS byte)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, CAST(3988292384 AS UBIGINT)) ELSE crc >> 1 END FROM steps WHERE k < 8),
crcs AS (SELECT byte, crc FROM steps WHERE k = 8),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item_words AS (SELECT {_WORDS} AS w FROM benchmark),
sizes AS (SELECT unnest([1, 2, 3]) AS size),
doc_runs AS (
  SELECT doc_id, feature, count(*) AS n
  FROM (SELECT doc_id, array_to_string(w[i:i + size - 1], ' ') AS feature
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size))
  GROUP BY doc_id, feature),
item_runs AS (
  SELECT feature, count(*) AS n
  FROM (SELECT array_to_string(w[i:i + size - 1], ' ') AS feature
        FROM (SELECT w, size, unnest(range(1, len(w) - size + 2)) AS i FROM item_words, sizes WHERE len(w) >= size))
  GROUP BY feature),
features AS (SELECT feature, hex(encode(feature)) AS code FROM (SELECT feature FROM doc_runs UNION SELECT feature FROM item_runs)),
walked(feature, code, pos, crc) AS (
  SELECT feature, code, 1, CAST(4294967295 AS UBIGINT) FROM features
  UNION ALL
  SELECT feature, code, pos + 2, xor(walked.crc >> 8, crcs.crc)
  FROM walked JOIN crcs ON crcs.byte = xor(walked.crc & 255, CAST('0x' || code[pos:pos + 1] AS UBIGINT)) WHERE pos < len(code)),
buckets AS (SELECT feature, CAST(xor(crc, CAST(4294967295 AS UBIGINT)) % {_SIZE} AS BIGINT) AS bucket FROM walked WHERE pos > len(code)),
source AS (SELECT bucket, sum(n) AS s FROM doc_runs JOIN buckets USING (feature) GROUP BY bucket),
target AS (SELECT bucket, sum(n) AS t FROM item_runs JOIN buckets USING (feature) GROUP BY bucket),
totals AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM doc_runs) AS all_s, (SELECT coalesce(sum(n), 0) FROM item_runs) AS all_t),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(all_s + {_SIZE} AS DOUBLE))
                                     / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(all_t + {_SIZE} AS DOUBLE)))) AS BIGINT) AS gain
  FROM (SELECT unnest(range({_SIZE})) AS bucket) LEFT JOIN source USING (bucket) LEFT JOIN target USING (bucket), totals),
weights AS (
  SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight
  FROM doc_runs JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('{resample.SEED}:' || doc_id)[1:8] AS UBIGINT) AS DOUBLE) + 0.5)
                                                         / 4294967296))) AS BIGINT) AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible
  FROM scored WHERE n_words >= {resample.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= eligible * {resample.SHARE} // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
