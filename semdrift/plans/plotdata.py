"""Tables behind the charts; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.config import PRESIDENTS
from semdrift.operators.meta import with_valid_year


def scatter_by_president(coords: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """(key, x, y, president) without the unknown ones."""
    return coords.join(metadata, key).filter(F.col("president") != "Unknown").select(key, "x", "y", "president")


def scatter_by_cluster(coords: DataFrame, labels: DataFrame, key: str = "filename") -> DataFrame:
    return coords.join(labels, key).select(key, "x", "y", "cluster")


def drift_bars(drift: DataFrame) -> DataFrame:
    label = F.concat_ws("-", F.col("from_year").cast("string"), F.col("to_year").cast("string"))
    return drift.select(label.alias("label"), "drift")


def gravity_line(positions: DataFrame, trend: DataFrame) -> DataFrame:
    """(year, position, fitted, slope): empty for a single year. ``trend`` is one row."""
    line = positions.join(F.broadcast(trend), F.col("n_years") > 1)
    return line.select("year", "position", (F.col("intercept") + F.col("slope") * F.col("idx")).alias("fitted"), "slope")


def variance_bars(variance: DataFrame, first: int = 20) -> DataFrame:
    return variance.filter(F.col("component") <= first).select("component", "explained_variance")


def variance_curve(variance: DataFrame, mark: float = 95.0) -> DataFrame:
    percent = F.col("cumulative_variance") * 100
    return variance.select("component", percent.alias("cumulative_percent"), F.lit(mark).alias("mark"))


def composition_heatmap(labelled: DataFrame, presidents: Sequence[str] = PRESIDENTS, cluster: str = "cluster") -> DataFrame:
    """Share of each known president per cluster; a cluster without any has a row of zeros."""
    counts = labelled.groupBy(F.col(cluster).alias("cluster")).pivot("president", list(presidents)).agg(F.count(F.lit(1)))
    counts = counts.fillna(0)
    total = sum((F.col(p) for p in presidents), F.lit(0))
    return counts.select("cluster", *[(F.col(p) / F.greatest(total, F.lit(1))).alias(p) for p in presidents])


def year_series(coords: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """(key, year, component, value, president): two long series over the numeric years."""
    points = with_valid_year(coords.join(metadata, key))
    pieces = F.explode(F.array(
        F.struct(F.lit("pc1").alias("component"), F.col("x").alias("value")),
        F.struct(F.lit("pc2").alias("component"), F.col("y").alias("value")),
    ))
    return points.select(key, "year", "president", pieces.alias("p")).select(
        key, "year", "p.component", "p.value", "president"
    )


def year_trends(series: DataFrame) -> DataFrame:
    """(component, slope, intercept): least squares against the year, for more than one row."""
    fits = series.groupBy("component").agg(
        F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("intercept"),
        F.count(F.lit(1)).alias("_n"),
    )
    return fits.filter(F.col("_n") > 1).drop("_n")


def timeline_frames(coords: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """Points in the order of their year, the animation frame."""
    points = with_valid_year(coords.join(metadata, key))
    return points.select(F.col("year").alias("frame"), key, "x", "y", "president").orderBy("frame", key)


def president_panels(coords: DataFrame, metadata: DataFrame, presidents: Sequence[str] = PRESIDENTS,
                     key: str = "filename") -> DataFrame:
    """(panel, president, n, key, x, y, year) for the listed presidents; panels count only present ones.

    The grey background of every panel is the coordinate table itself.
    """
    points = coords.join(metadata, key)
    rank = F.array_position(F.array(*[F.lit(p) for p in presidents]), F.col("president"))
    known = points.withColumn("_rank", rank).filter(F.col("_rank") > 0)
    titles = known.groupBy("_rank").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "panel", F.row_number().over(Window.orderBy("_rank"))
    )  # at most one row per listed president
    return known.join(F.broadcast(titles), "_rank").select(
        "panel", "president", "n", key, "x", "y", F.col("year").cast("string").try_cast("int").alias("year")
    )


def centroid_trajectory(coords: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """(year, x, y, annotated): mean point per year, every second one annotated."""
    means = with_valid_year(coords.join(metadata, key)).groupBy("year").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    idx = F.row_number().over(Window.orderBy("year")) - 1  # one row per year
    return means.withColumn("annotated", idx % 2 == 0)
