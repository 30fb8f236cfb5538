"""Yearly centroids, consecutive drift, trend and composition counts."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.functions.vectors import cosine
from semdrift.operators.meta import with_valid_year

# Windows below run over one row per year: a year text has four characters,
# so they never see more than ten thousand rows.


def yearly_centroids(vectors: DataFrame, vec_col: str = "embedding", year: str = "year") -> DataFrame:
    """(year, n, centroid): mean vector of every valid year, combined on the map side."""
    valid = with_valid_year(vectors.select(year, vec_col), year)
    vec = array_to_vector(F.col(vec_col).cast("array<double>"))
    return valid.groupBy(year).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(vec).alias("_c")).select(
        F.col(year).alias("year"), "n", vector_to_array("_c").alias("centroid")
    )


def consecutive_drift(centroids: DataFrame) -> DataFrame:
    """(from_year, to_year, drift): cosine distance to the previous present year."""
    by_year = Window.orderBy("year")
    paired = centroids.select(
        F.lag("year").over(by_year).alias("from_year"), F.col("year").alias("to_year"),
        F.lag("centroid").over(by_year).alias("_before"), "centroid",
    )
    return paired.filter(F.col("from_year").isNotNull()).select(
        "from_year", "to_year", (1 - cosine(F.col("centroid"), F.col("_before"))).alias("drift")
    )


def centroid_positions(centroids: DataFrame) -> DataFrame:
    """(year, idx, position): score of each centroid on their first principal axis.

    The year with the largest absolute score has a positive one (of equals,
    the earliest). A single year sits at 0.
    """
    idx = (F.row_number().over(Window.orderBy("year")) - 1).alias("idx")
    listed = centroids.select("year", idx, array_to_vector("centroid").alias("_v")).persist()
    try:
        seen = listed.agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("m")).head()
        if seen["n"] < 2:
            rows = [(r["year"], r["idx"], 0.0) for r in listed.select("year", "idx").collect()]
        else:
            axis = PCA(k=1, inputCol="_v", outputCol="_p").fit(listed).pc.toArray()[:, 0]
            mean = seen["m"].toArray()
            scores = [(r["year"], r["idx"], float((r["_v"].toArray() - mean) @ axis)) for r in listed.orderBy("year").collect()]
            top = max(scores, key=lambda s: (abs(s[2]), -s[0]))
            sign = -1.0 if top[2] < 0 else 1.0
            rows = [(y, i, sign * s) for y, i, s in scores]  # one row per year
    finally:
        listed.unpersist()
    return centroids.sparkSession.createDataFrame(rows, "year int, idx int, position double")


def trend(positions: DataFrame) -> DataFrame:
    """(slope, intercept, n_years): least squares of the position on the year's index; slope 0 for one year."""
    return positions.agg(
        F.coalesce(F.regr_slope("position", "idx"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept("position", "idx"), F.avg("position")).alias("intercept"),
        F.count(F.lit(1)).alias("n_years"),
    )


def cluster_sizes(labelled: DataFrame, cluster: str = "cluster") -> DataFrame:
    return labelled.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def cluster_by_group(labelled: DataFrame, cluster: str = "cluster", group: str = "president") -> DataFrame:
    """Counts per cluster and group; a row without group is not counted."""
    known = labelled.filter(F.col(group).isNotNull())
    return known.groupBy(F.col(cluster).alias("cluster"), group).agg(F.count(F.lit(1)).alias("n"))


def cluster_by_year(labelled: DataFrame, cluster: str = "cluster", year: str = "year") -> DataFrame:
    known = labelled.filter(F.col(year).isNotNull() & (F.col(year).cast("string") != "Unknown"))
    return known.groupBy(F.col(cluster).alias("cluster"), year).agg(F.count(F.lit(1)).alias("n")).orderBy("cluster", year)


def counts_by(df: DataFrame, group: str) -> DataFrame:
    """Counts per group, most frequent first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group)


def counts_by_year(df: DataFrame, year: str = "year") -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("n")).orderBy(year)
