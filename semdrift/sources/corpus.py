"""The corpus view over a ``documents`` table without dates, numbers and titles of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.functions.names import document_key, era_of
from semdrift.functions.text import NON_SPACE, SPACE, collapse_space

TITLE = f"^{SPACE}*((?:{NON_SPACE}+{SPACE}+){{0,7}}{NON_SPACE}+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table of fewer splits than cores; a larger one is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with derived number, date, title, president and key."""
    d = texts(spark, sf_dir)
    year = (F.lit(1994) + F.col("doc_id") % 32).cast("int")
    date = F.make_date(year, (1 + F.col("doc_id") % 12).cast("int"), (1 + F.col("doc_id") % 28).cast("int"))
    return (
        d.select("doc_id", "text", "lang", "source", year.alias("year"), date.cast("string").alias("date"))
        .withColumn("eo_number", (F.lit(12890) + F.col("doc_id")).cast("string"))
        .withColumn("title", collapse_space(F.regexp_extract("text", TITLE, 1)))
        .withColumn("president", era_of(F.col("year").cast("string")))
        .withColumn("filename", document_key(F.col("eo_number"), F.col("date"), F.col("title")))
    )
