"""The batch operators on documents that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.config import CleanSettings
from semdrift.operators.clean import content_text
from semdrift.operators.drift import consecutive_drift
from semdrift.operators.embed import hash_embedding
from semdrift.operators.meta import with_valid_year


def landed_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below ``path`` (a folder or a pattern)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def clean_and_embed(documents: DataFrame, key: str, dim: int, settings: CleanSettings = CleanSettings(),
                    min_chars: int = 50) -> DataFrame:
    """Stateless: the column functions of the batch path, for a stream or a table."""
    cleaned = documents.select(key, content_text(F.col("text"), settings).alias("text"))
    vector = hash_embedding(F.col("text"), dim, min_chars=min_chars)
    done = cleaned.select(key, "text", F.md5("text").alias("content_md5"), vector.alias("embedding"))
    return done.filter("embedding IS NOT NULL")


def first_copies(documents: DataFrame, key: list[str], event_time: str, late: str = "1 day") -> DataFrame:
    """First copy of every key within the late-data bound; older state is dropped."""
    return documents.withWatermark(event_time, late).dropDuplicatesWithinWatermark(key)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that has landed, append it to a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def partial_sums(vectors: DataFrame, vec_col: str = "embedding", year: str = "year") -> DataFrame:
    """(year, n, total): what a micro-batch adds to the yearly centroids."""
    valid = with_valid_year(vectors.select(year, vec_col), year)
    vec = array_to_vector(F.col(vec_col).cast("array<double>"))
    summed = valid.groupBy(year).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(vec).alias("_t"))
    return summed.select(F.col(year).alias("year"), "n", vector_to_array("_t").alias("total"))


def add_partials(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Sink of a stream: one folder of partial sums per micro-batch, rewritten when a batch is retried."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial_sums(transform(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def run_centroids(stream: DataFrame, path: str, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(add_partials(path)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def merged_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(year, n, centroid) from all micro-batches so far."""
    parts = spark.read.schema("year int, n bigint, total array<double>, batch bigint").parquet(path)
    merged = parts.groupBy("year").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("_t"))
    return merged.select(
        "year", "n", F.transform(vector_to_array("_t"), lambda x: x / F.col("n")).alias("centroid")
    )


def merged_drift(spark: SparkSession, path: str) -> DataFrame:
    return consecutive_drift(merged_centroids(spark, path))


def compact_partials(spark: SparkSession, path: str, target: str) -> None:
    """Merge the micro-batch folders into one, so that reads stay small."""
    parts = spark.read.schema("year int, n bigint, total array<double>, batch bigint").parquet(path)
    merged = parts.groupBy("year").agg(
        F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("_t"), F.max("batch").alias("batch")
    )
    merged.select("year", "n", vector_to_array("_t").alias("total"), "batch").write.mode("overwrite").partitionBy(
        "batch"
    ).parquet(target)
