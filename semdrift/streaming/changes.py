"""Yearly centroids over documents that come, change and go.

The feed holds versions of documents: (key, version, year, embedding,
deleted), in any order, also twice. Of each document the highest version counts. A
micro-batch takes back what the versions it replaces had added: partial sums
carry a sign, so the sum of all partials is that of the documents as they are. Sums and the versions that
count are tables committed by manifests, the sums first; both name the micro-batch they were made from, so a
batch that is run again after a failure adds nothing twice. Folders of partial sums are
merged as they become many.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.operators.drift import consecutive_drift
from semdrift.operators.meta import with_valid_year
from semdrift.operators.skew import latest_per_key
from semdrift.plans.manifest import Store
from semdrift.session import scratch_tables, write_and_read

VERSIONS, SUMS = "versions", "sums"
FEED = "key string, version bigint, year string, embedding array<float>, deleted boolean"



def signed_sums(rows: DataFrame) -> DataFrame:
    """(year, n, total): sums over (year, embedding, sign), combined before the shuffle; versions without a valid year add nothing."""
    valid = with_valid_year(rows.select("year", "embedding", "sign"), "year")
    signed = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("sign"))
    summed = valid.select("year", "sign", array_to_vector(signed).alias("_v")).groupBy("year").agg(
        F.sum("sign").cast("bigint").alias("n"), Summarizer.sum(F.col("_v")).alias("_t"))
    return summed.select(F.col("year").cast("int").alias("year"), "n", vector_to_array("_t").alias("total"))


def merged_sums(sums: DataFrame) -> DataFrame:
    merged = sums.groupBy("year").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("total")).alias("_t"))
    return merged.select("year", "n", vector_to_array("_t").alias("total"))


def apply_changes(store: Store, feed: DataFrame, step: str) -> None:
    """Bring versions and sums up to date with the rows of ``feed``; ``step`` names them."""
    newest = write_and_read(latest_per_key(feed.select("key", "version", "year", "embedding", "deleted"), "key", ["version"]), "feed-newest")
    known = store.read(VERSIONS)
    if known is None:
        old = newest.limit(0)
    else:
        old = known.join(newest.select("key"), "key", "left_semi")
    old = write_and_read(old, "feed-replaced")
    # A version that is not above the known one changes nothing, whenever it comes.
    late = newest.join(old.select("key", F.col("version").alias("_known")), "key").filter("version <= _known").select("key")
    new = newest.join(late, "key", "left_anti")
    replaced = old.join(late, "key", "left_anti")
    signed = new.filter("NOT deleted").withColumn("sign", F.lit(1)).unionByName(replaced.filter("NOT deleted").withColumn("sign", F.lit(-1)))
    store.append(SUMS, step, signed_sums(signed), merge=merged_sums)
    bare = F.when(F.col("deleted"), F.lit(None)).otherwise(F.col("embedding")).alias("embedding")
    store.append(VERSIONS, step, new.select("key", "version", "year", bare, "deleted"), replaced.select("key"), "key")


def run_changes(stream: DataFrame, root: str, checkpoint: str) -> None:
    """Process the versions that have landed and stop."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        with scratch_tables(batch.sparkSession):
            apply_changes(Store(batch.sparkSession, root), batch, f"batch {batch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_centroids(spark: SparkSession, root: str) -> DataFrame:
    """(year, n, centroid) of the documents as they are now; a year without documents is absent."""
    sums = Store(spark, root).read(SUMS)
    if sums is None:
        return spark.createDataFrame([], "year int, n bigint, centroid array<double>")
    now = merged_sums(sums).filter("n > 0")
    return now.select("year", "n", F.transform("total", lambda x: x / F.col("n")).alias("centroid"))


def current_drift(spark: SparkSession, root: str) -> DataFrame:
    return consecutive_drift(current_centroids(spark, root))
