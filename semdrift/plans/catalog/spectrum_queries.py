"""Checks of principal axes and what rests on them against SQL that finds the same numbers another way.

SQL has no eigenvectors, but it has the sums of powers of all eigenvalues (traces of
powers of the correlation matrix), the equations that axes must satisfy, and, where the first
eigenvalue stands apart, the first axis itself by repeated multiplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.operators import drift, reduce
from semdrift.plans import plotdata
from semdrift.plans.catalog.analysis_queries import _positions, rounded
from semdrift.plans.catalog.base import CENTROIDS, ORACLES, query
from semdrift.plans.catalog.vector_queries import DIM, LONG, vectors

SCALED = f"""{LONG},
s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos),
z AS (SELECT vec_id, pos, (v - m) / sd AS z FROM long JOIN s USING (pos))"""

POWERS = f"""WITH {SCALED},
c1 AS (SELECT a.pos AS i, b.pos AS j, avg(a.z * b.z) AS c FROM z a JOIN z b USING (vec_id) GROUP BY ALL),
c2 AS (SELECT x.i, y.j, sum(x.c * y.c) AS c FROM c1 x JOIN c1 y ON x.j = y.i GROUP BY ALL),
c3 AS (SELECT x.i, y.j, sum(x.c * y.c) AS c FROM c2 x JOIN c1 y ON x.j = y.i GROUP BY ALL)
SELECT 1 AS power, round(sum(c), 4) AS total FROM c1 WHERE i = j
UNION ALL SELECT 2, round(sum(c), 4) FROM c2 WHERE i = j
UNION ALL SELECT 3, round(sum(c), 4) FROM c3 WHERE i = j
UNION ALL SELECT 4, round(sum(c * c), 4) FROM c2
UNION ALL SELECT 5, round(sum(x.c * y.c), 4) FROM c2 x JOIN c3 y ON x.i = y.i AND x.j = y.j
UNION ALL SELECT 6, round(sum(c * c), 4) FROM c3"""


def _all_axes(spark, sf_dir) -> tuple[DataFrame, reduce.PcaFit]:
    return reduce.pca_coordinates(vectors(spark, sf_dir), "vec_id", "embedding", DIM)


@query("r03_spectrum_powers", POWERS)
def r03_powers(spark, sf_dir):
    """Sums of powers of all eigenvalues of the correlation matrix; six of them tie the spectrum down."""
    _, fit = _all_axes(spark, sf_dir)
    values = fit.ratio * DIM
    return spark.createDataFrame([(p, round(float((values ** p).sum()), 4)) for p in range(1, 7)], "power int, total double")


@query("r02_axis_equations", f"""SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS product, true AS eigen
FROM (SELECT unnest(range(1, 51)) AS a), (SELECT unnest(range(1, 51)) AS b) WHERE a <= b""")
def r02_equations(spark, sf_dir):
    """Products of the 50 axes, and whether the correlation matrix only stretches each (from its rows, summed by Spark)."""
    v = vectors(spark, sf_dir)
    coords, fit = reduce.pca_coordinates(v, "vec_id", "embedding", 50)
    scaled, _ = reduce.standardise(v, "embedding")
    # The correlation matrix times an axis is the mean of the rows, each times its score.
    long = reduce.long_form(scaled, "vec_id", "scaled").withColumnRenamed("value", "z")
    scores = reduce.long_form(coords, "vec_id", "pos").select("vec_id", F.col("pos").alias("axis"), F.col("value").alias("score"))
    times = long.join(scores, "vec_id").groupBy("axis", "pos").agg(F.avg(F.col("z") * F.col("score")).alias("image"))
    axes = spark.createDataFrame(
        [(i + 1, j + 1, float(x), float(r) * DIM) for i, (axis, r) in enumerate(zip(fit.components, fit.ratio)) for j, x in enumerate(axis)],
        "axis int, pos int, loading double, value double",
    )
    off = times.join(axes, ["axis", "pos"]).groupBy("axis").agg(
        (F.sqrt(F.sum(F.pow(F.col("image") - F.col("value") * F.col("loading"), 2))) < 1e-6).alias("eigen"))
    a = axes.select(F.col("axis").alias("a"), "pos", F.col("loading").alias("x"))
    b = axes.select(F.col("axis").alias("b"), "pos", F.col("loading").alias("y"))
    products = a.join(b, "pos").filter("a <= b").groupBy("a", "b").agg((F.round(F.sum(F.col("x") * F.col("y")), 6) + F.lit(0.0)).alias("product"))
    return products.join(off, F.col("axis") == F.col("a")).select(
        F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.abs("product").alias("product"), "eigen")


@query("r06_scores_apart", f"""SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, 0.0 AS product
FROM (SELECT unnest(range(1, {DIM + 1})) AS a), (SELECT unnest(range(1, {DIM + 1})) AS b) WHERE a < b""")
def r06_apart(spark, sf_dir):
    """Scores on different axes have nothing in common; with r06_projection_lengths only principal axes do both."""
    coords, _ = _all_axes(spark, sf_dir)
    long = reduce.long_form(coords, "vec_id", "pos").select("vec_id", "pos", "value")
    a, b = (long.select("vec_id", F.col("pos").alias(n), F.col("value").alias(f"v{n}")) for n in "ab")
    met = a.join(b, "vec_id").filter("a < b").groupBy("a", "b").agg(F.abs(F.round(F.avg(F.col("va") * F.col("vb")), 6)).alias("product"))
    return met.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "product")


# Shares of the dimensions in all variance, largest first: a variance table that SQL has, too.
SHARES = f"""{LONG},
shares AS (SELECT pos, var_pop(v) AS x FROM long GROUP BY pos),
table_ AS (SELECT row_number() OVER (ORDER BY x DESC, pos) AS component, x / (SELECT sum(x) FROM shares) AS explained_variance FROM shares),
variance AS (SELECT *, sum(explained_variance) OVER (ORDER BY component) AS cumulative_variance FROM table_)"""


def _shares(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    scaler = reduce.moments(v, "embedding")
    variance = scaler.products.diagonal()
    rows = spark.createDataFrame([(i, float(x / variance.sum())) for i, x in enumerate(variance)], "pos int, explained_variance double")
    nth = F.row_number().over(Window.orderBy(F.desc("explained_variance"), "pos"))  # one row per dimension
    return reduce.cumulative(rows.select(nth.alias("component"), "explained_variance"))


@query("r04_cumulative_shares", f"WITH {SHARES} SELECT CAST(component AS INT) AS component, round(explained_variance, 8) AS explained_variance, round(cumulative_variance, 8) AS cumulative_variance FROM variance")
def r04_shares(spark, sf_dir):
    return rounded(_shares(spark, sf_dir), "explained_variance", "cumulative_variance", digits=8)


@query("r05_shares_needed", f"""WITH {SHARES}
SELECT share, CAST(coalesce(min(component) FILTER (cumulative_variance >= share), max(component) + 1) AS INT) AS n_components
FROM variance, (SELECT unnest([0.25, 0.5, 0.95, 1.5]::DOUBLE[]) AS share) GROUP BY share""")
def r05_shares(spark, sf_dir):
    """Components for several marks, one of which none reaches."""
    table = _shares(spark, sf_dir)
    parts = [reduce.components_needed(table, s).select(F.lit(s).alias("share"), "n_components") for s in (0.25, 0.5, 0.95, 1.5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("v05_share_bars", f"WITH {SHARES} SELECT CAST(component AS INT) AS component, round(explained_variance, 8) AS explained_variance FROM variance WHERE component <= 20")
def v05_bars(spark, sf_dir):
    return rounded(plotdata.variance_bars(_shares(spark, sf_dir)), "explained_variance", digits=8)


@query("v05_share_curve", f"""WITH {SHARES} SELECT CAST(component AS INT) AS component, round(cumulative_variance * 100, 6) AS cumulative_percent,
CAST(95.0 AS DOUBLE) AS mark FROM variance""")
def v05_curve(spark, sf_dir):
    return rounded(plotdata.variance_curve(_shares(spark, sf_dir)), "cumulative_percent")


# Scores of the yearly centroids on their first axis are the first eigenvector of their products, times its length.
POSITIONS = f"""{CENTROIDS},
numbered AS (SELECT year, pos, v - avg(v) OVER (PARTITION BY pos) AS v, dense_rank() OVER (ORDER BY year) AS n FROM centroids),
lists AS (SELECT n, min(year) AS year, list(v ORDER BY pos) AS x FROM numbered GROUP BY n),
grams AS (SELECT a.n, list(list_dot_product(a.x, b.x) ORDER BY b.n) AS g FROM lists a, lists b GROUP BY a.n),
gram AS (SELECT list(g ORDER BY n) AS g, count(*) AS years FROM grams),
walk(step, u) AS (
  SELECT 0, list_transform(range(1, years + 1), lambda i: CAST(1 + i % 3 + 0.01 * i AS DOUBLE)) FROM gram
  UNION ALL
  SELECT step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
  FROM (SELECT step, list_transform(g, lambda row: list_dot_product(row, u)) AS w FROM walk, gram WHERE step < 3000)),
first AS (SELECT u, list_dot_product(u, list_transform(g, lambda row: list_dot_product(row, u))) AS value FROM walk, gram WHERE step = 3000),
scores AS (SELECT year, n, u[n] * sqrt(value) AS score FROM lists, first),
positions AS (
  SELECT year, n - 1 AS idx, score * (SELECT CASE WHEN arg_max(score, abs(score)) < 0 THEN -1 ELSE 1 END FROM scores) AS position FROM scores),
line AS (SELECT regr_slope(position, idx) AS slope, regr_intercept(position, idx) AS intercept, count(*) AS n_years FROM positions)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("a06_positions_by_products", _recursive(f"WITH {POSITIONS} SELECT year, CAST(idx AS BIGINT) AS idx, round(position, 5) AS position FROM positions"))
def a06_positions(spark, sf_dir):
    return rounded(_positions(spark, sf_dir).withColumn("idx", F.col("idx").cast("bigint")), "position", digits=5)


@query("a07_trend_by_products", _recursive(f"WITH {POSITIONS} SELECT round(slope, 5) AS slope, round(intercept, 5) AS intercept, n_years FROM line"))
def a07_trend(spark, sf_dir):
    return rounded(drift.trend(_positions(spark, sf_dir)), "slope", "intercept", digits=5)


@query("v04_line_by_products", _recursive(f"""WITH {POSITIONS}
SELECT year, round(position, 5) AS position, round(intercept + slope * idx, 5) AS fitted, round(slope, 5) AS slope FROM positions, line"""))
def v04_line(spark, sf_dir):
    positions = _positions(spark, sf_dir)
    return rounded(plotdata.gravity_line(positions, drift.trend(positions)), "position", "fitted", "slope", digits=5)


@query("x11_trend_finding", _recursive(f"""WITH {POSITIONS}
SELECT CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, round(slope, 5) AS slope FROM line"""))
def x11_trend(spark, sf_dir):
    """The trend part of the key findings."""
    from semdrift.plans import report

    found = report.key_findings(drift.trend(_positions(spark, sf_dir)), 2, spark.createDataFrame([(1,)], "n int"))
    return rounded(found.select("direction", "slope"), "slope", digits=5)


# The plain queries of the same numbers have the same twins.
ORACLES["a06_centroid_positions"] = ORACLES["a06_positions_by_products"]
ORACLES["a07_trend"] = ORACLES["a07_trend_by_products"]
ORACLES["v04_gravity_line_on_axis"] = ORACLES["v04_line_by_products"]


def register() -> None:
    """All queries here are registered with the module."""
