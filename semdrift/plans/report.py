"""Export tables and the summary report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.operators.skew import lookup_join


def metadata_with_stats(metadata: DataFrame, stats: DataFrame, key: str = "filename") -> DataFrame:
    """Every metadata row with its measures; columns both sides have come from the metadata."""
    extra = [c for c in stats.columns if c == key or c not in metadata.columns]
    return lookup_join(metadata, stats.select(*extra), key, key)


def coordinate_export(coords: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    return coords.join(metadata, key).select("x", "y", key, "president", "year")


def cluster_export(labels: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    return labels.join(metadata, key).select(key, "president", "year", "cluster")


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """(cluster, count, president): size and most frequent president, the first by name on ties."""
    counts = labelled.groupBy("cluster", "president").agg(F.count(F.lit(1)).alias("n"))
    modal = F.min_by("president", F.when(F.col("president").isNotNull(), F.struct(-F.col("n"), "president")))
    return counts.groupBy("cluster").agg(
        F.sum("n").alias("count"), F.coalesce(modal, F.lit("Unknown")).alias("president")
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"),
        F.min("drift").alias("min_drift"), F.sum("drift").alias("total_change"),
    )


def overview(metadata: DataFrame) -> DataFrame:
    return metadata.agg(
        F.count(F.lit(1)).alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


def president_share(metadata: DataFrame) -> DataFrame:
    """(president, n, percent), most frequent first; the window sees one row per president."""
    counts = metadata.groupBy("president").agg(F.count(F.lit(1)).alias("n"))
    percent = F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1)
    shares = counts.select("president", "n", percent.alias("percent")).filter(F.col("president").isNotNull())
    return shares.orderBy(F.desc("n"), "president")


def top_transitions(drift: DataFrame, k: int = 3) -> DataFrame:
    return drift.orderBy(F.desc("drift"), "from_year").limit(k)


def cluster_lines(stats: DataFrame) -> DataFrame:
    line = F.format_string("- Cluster %d: %d orders (primarily %s)", "cluster", "count", "president")
    return stats.select("cluster", line.alias("line"))


def _lines(df: DataFrame, section: int, line, order=None) -> DataFrame:
    order = F.lit(0).cast("double") if order is None else order.cast("double")
    return df.select(F.lit(section).alias("section"), order.alias("at"), F.lit("").alias("tie"), line.alias("line"))


def summary_report(metadata: DataFrame, drift: DataFrame, stats: DataFrame, title: str, generated: str) -> DataFrame:
    """(seq, line): the markdown report. Every part has a line per group or fewer."""
    spark = metadata.sparkSession

    def fixed(section: int, *texts: str) -> DataFrame:
        rows = [(section, float(i), "", t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "section int, at double, tie string, line string")

    seen, moves = overview(metadata), drift_summary(drift)
    shares = president_share(metadata)
    share_line = F.format_string("- %s: %d orders (%.1f%%)", "president", "n", "percent")
    top = top_transitions(drift)
    arrow = F.format_string("- %d → %d: %.3f", "from_year", "to_year", "drift")
    parts = [
        fixed(0, f"# {title}", f"Generated: {generated}", "", "## Dataset Overview"),
        _lines(seen, 1, F.format_string("- Total executive orders analyzed: %d", "documents")),
        _lines(seen, 2, F.concat(F.lit("- Date range: "), F.col("first_year").cast("string"), F.lit(" - "),
                                 F.col("last_year").cast("string"))),
        fixed(3, "", "### Distribution by President"),
        shares.select(F.lit(4).alias("section"), (-F.col("n")).cast("double").alias("at"),
                      F.col("president").alias("tie"), share_line.alias("line")),
        fixed(5, "", "## Semantic Drift Analysis"),
        _lines(moves, 6, F.format_string("- Mean semantic drift between years: %.3f", "mean_drift")),
        _lines(moves, 7, F.format_string("- Maximum drift: %.3f", "max_drift")),
        fixed(8, "", "### Most Significant Transitions:"),
        top.select(F.lit(9).alias("section"), (-F.col("drift")).alias("at"),
                   F.lpad(F.col("from_year").cast("string"), 6, "0").alias("tie"), arrow.alias("line")),
        fixed(10, "", "## Kmeans Clustering Results"),
        _lines(stats.agg(F.count(F.lit(1)).alias("k")), 11, F.format_string("- Number of clusters: %d", "k")),
        fixed(12, "", "### Cluster Sizes:"),
        _lines(cluster_lines(stats), 13, F.col("line"), F.col("cluster")),
        fixed(14, ""),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    seq = F.row_number().over(Window.orderBy("section", "at", "tie"))  # a report's worth of lines
    return whole.select(seq.alias("seq"), "line")


def key_findings(trend: DataFrame, best_k: int, variance_needed: DataFrame) -> DataFrame:
    """One row: direction and slope of the trend, chosen k, components for the variance mark."""
    direction = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    needed = variance_needed.head()[0]
    return trend.select(
        direction.alias("direction"), "slope", F.lit(best_k).alias("best_k"), F.lit(needed).alias("n_components")
    )
