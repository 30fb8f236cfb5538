"""Metadata read from document keys, eras and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.config import ERAS
from semdrift.functions import names as N
from semdrift.operators.skew import lookup_join


def parse_keys(documents: DataFrame, key: str = "filename") -> DataFrame:
    """Number, date and year text out of the document key."""
    parsed = documents.withColumn("eo_number", N.key_number(F.col(key))).withColumn("date", N.key_date(F.col(key)))
    return parsed.withColumn("year", N.year_text(F.col("date")))


def era_table(spark: SparkSession, rules=ERAS) -> DataFrame:
    rows = [(i, low, high, name) for i, (low, high, name) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule int, low int, high int, era string")


#: Rules up to which the eras are one expression.
FEW_RULES = 200


def era_lookup(documents: DataFrame, rules: DataFrame, year: str = "year") -> DataFrame:
    """First rule whose inclusive range holds the year.

    A few rules become one expression over the documents. Of more, only distinct years (a year text has
    four characters) meet the rule table; the documents then look their year up.
    """
    listed = rules.orderBy("rule").limit(FEW_RULES + 1).collect()
    number = N.year_number(F.col(year))
    if len(listed) <= FEW_RULES:
        era = F.lit(None).cast("string")
        for rule in reversed(listed):
            era = F.when(number.between(rule["low"], rule["high"]), F.lit(rule["era"])).otherwise(era)
        return documents.withColumn("president", F.coalesce(era, F.lit("Unknown")))
    years = documents.select(year).distinct().withColumn("_n", number)
    hits = years.join(F.broadcast(rules), F.col("_n").between(F.col("low"), F.col("high")), "left")
    known = hits.groupBy(year).agg(F.min_by("era", "rule").alias("_era"))
    return lookup_join(documents, known, year, documents.columns[0]).withColumn(
        "president", F.coalesce("_era", F.lit("Unknown"))
    ).drop("_era")


def override_president(documents: DataFrame, stats: DataFrame) -> DataFrame:
    """President of the first statistics row with the same number, else the one at hand.

    "First" is by ``filename``. Numbers are compared as text; an empty
    number is no number and matches nothing.
    """
    first = stats.filter(F.col("eo_number").cast("string") != "").groupBy(F.col("eo_number").cast("string").alias("eo_number")).agg(
        F.min_by("president", "filename").alias("_president")
    )
    joined = lookup_join(documents, first, "eo_number", "filename")
    return joined.withColumn("president", F.coalesce("_president", "president")).drop("_president")


def metadata_frame(documents: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(filename, eo_number, date, year, president) for every document key."""
    parsed = parse_keys(documents.select("filename")).withColumn("president", N.era_of(F.col("year")))
    if stats is not None:
        parsed = override_president(parsed, stats)
    return parsed.select("filename", "eo_number", "date", "year", "president")


def align(vectors: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """Vectors that have metadata, and the other way round; both sides hold one row per key."""
    return vectors.join(metadata, key)


def with_valid_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Numeric years only."""
    return df.withColumn(year, N.year_number(F.col(year).cast("string"))).filter(F.col(year).isNotNull())
