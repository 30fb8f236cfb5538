"""Registry of named queries, their SQL twins, and the SQL of shared views."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from semdrift.config import ERAS
from semdrift.functions import text as X
from semdrift.functions.stopwords import DEFAULT
from semdrift.functions.names import GAPS, UNSAFE
from semdrift.session import ship_package
from semdrift.sources.corpus import TITLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _shipped(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    return run


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if key in QUERIES:
            raise KeyError(key)
        QUERIES[key] = _shipped(fn)
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


# ------------------------------------------------------------------ SQL text helpers


def sub(expr: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({expr}, '{quoted(pattern)}', '{to}', 'g')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, X.SPACE + '+')})"


def era_case(year: str) -> str:
    arms = " ".join(f"WHEN {year} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in ERAS)
    return f"CASE {arms} ELSE 'Unknown' END"


def safe_name(expr: str) -> str:
    return f"regexp_replace({sub(sub(expr, UNSAFE, '_'), GAPS, '_')}, '^_+|_+$', '', 'g')"


def normalised(expr: str) -> str:
    for pattern in (X.ORDER_NO, X.NUMERIC_DATE, X.CITATION, X.URL):
        expr = sub(expr, pattern)
    return squeeze(sub(f"lower({expr})", X.NON_ALPHA))


def stopword_list() -> str:
    return ", ".join(f"'{quoted(w)}'" for w in DEFAULT)


def content_list(normal: str) -> str:
    """SQL list of content words of a normalised text."""
    return f"list_filter(string_split({normal}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({stopword_list()}))"


CORPUS = f"""
base AS (
  SELECT doc_id, text, lang, source, CAST(1994 + doc_id % 32 AS INTEGER) AS year,
         strftime(make_date(1994 + doc_id % 32, 1 + doc_id % 12, 1 + doc_id % 28), '%Y-%m-%d') AS date,
         CAST(12890 + doc_id AS VARCHAR) AS eo_number,
         {squeeze(f"regexp_extract(text, '{TITLE}', 1)")} AS title
  FROM documents),
corpus AS (
  SELECT *, {era_case('year')} AS president,
         'EO_' || eo_number || '_' || date || '_' || substring({safe_name('title')}, 1, 50) || '.txt' AS filename
  FROM base)
"""

# Vectors with the metadata of the corpus rule; their label serves as a ready cluster.
LABELLED = f"""
labelled AS (
  SELECT vec_id, embedding, CAST(label AS BIGINT) AS cluster, CAST(1994 + vec_id % 32 AS INTEGER) AS year,
         {era_case('(1994 + vec_id % 32)')} AS president, 'V' || vec_id AS filename
  FROM embeddings)
"""

CENTROIDS = f"""{LABELLED},
elements AS (
  SELECT year, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM labelled),
centroids AS (SELECT year, pos, avg(v) AS v FROM elements GROUP BY year, pos),
steps AS (
  SELECT year, pos, v, lag(v) OVER (PARTITION BY pos ORDER BY year) AS before,
         lag(year) OVER (PARTITION BY pos ORDER BY year) AS from_year FROM centroids),
drift AS (
  SELECT from_year, year AS to_year,
         1 - (CASE WHEN sqrt(sum(v * v)) * sqrt(sum(before * before)) > 0
              THEN sum(v * before) / (sqrt(sum(v * v)) * sqrt(sum(before * before))) ELSE 0 END) AS drift
  FROM steps WHERE from_year IS NOT NULL GROUP BY from_year, year)
"""
