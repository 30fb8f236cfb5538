"""Documents in, year-over-year drift out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.config import CleanSettings, EmbedSettings
from semdrift.operators import drift, embed, meta
from semdrift.operators.clean import content_text
from semdrift.plans.catalog.base import CORPUS, query
from semdrift.plans.catalog.vector_queries import hash_vectors
from semdrift.session import ship_package
from semdrift.sources.corpus import corpus

DIM = EmbedSettings().dim


def corpus_drift(spark: SparkSession, sf_dir: str, dim: int = DIM) -> DataFrame:
    """Clean, embed, read the year off the document key, average per year, compare neighbours.

    One narrow stage up to the vectors; the only shuffle carries one partial
    mean per year and task.
    """
    ship_package(spark)
    docs = corpus(spark, sf_dir).select("filename", content_text(F.col("text"), CleanSettings()).alias("text"))
    vectors = embed.embed_documents(docs, "filename", dim)
    dated = meta.parse_keys(vectors.select("filename", "embedding"))
    return drift.consecutive_drift(drift.yearly_centroids(dated))


def register() -> None:
    docs = hash_vectors("documents", "doc_id", "d")

    @query("a05_corpus_drift", f"""WITH {CORPUS.strip()}, {docs},
kept AS (SELECT DISTINCT d.doc_id, year FROM d_vectors d JOIN corpus USING (doc_id)),
counts AS (SELECT year, count(*) AS n FROM d_words JOIN corpus USING (doc_id) WHERE length(d_words.text) > 50 GROUP BY year),
sums AS (SELECT year, pos, sum(value) AS s FROM d_vectors JOIN corpus USING (doc_id) GROUP BY ALL),
grid AS (SELECT year, pos, coalesce(s, 0) / n AS v FROM counts
         CROSS JOIN (SELECT unnest(generate_series(1, {DIM})) AS pos) LEFT JOIN sums USING (year, pos)),
steps AS (SELECT year, pos, v, lag(v) OVER (PARTITION BY pos ORDER BY year) AS before,
                 lag(year) OVER (PARTITION BY pos ORDER BY year) AS from_year FROM grid)
SELECT from_year, year AS to_year, round(1 - sum(v * before) / (sqrt(sum(v * v)) * sqrt(sum(before * before))), 6) AS drift
FROM steps WHERE from_year IS NOT NULL GROUP BY ALL""")
    def a05_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
        return corpus_drift(spark, sf_dir).withColumn("drift", F.round("drift", 6))
