"""Drift, composition, plot tables, exports, reports, training batches and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.config import PRESIDENTS, CleanSettings, EmbedSettings
from semdrift.functions.names import era_of
from semdrift.operators import batches, cluster, drift, reduce
from semdrift.operators.skew import number_rows
from semdrift.plans import plotdata, report
from semdrift.plans.catalog.base import CENTROIDS, CORPUS, LABELLED, query
from semdrift.plans.catalog.vector_queries import long_rounded, vectors
from semdrift.session import scratch_path, write_and_read
from semdrift.sources import landed, sinks
from semdrift.sources.corpus import corpus, table
from semdrift.streaming import changes, stream


def labelled(spark, sf_dir) -> DataFrame:
    """Vectors with year and president by the corpus rule; the ready label is the cluster."""
    year = (F.lit(1994) + F.col("vec_id") % 32).cast("int")
    return vectors(spark, sf_dir).select(
        "vec_id", "embedding", F.col("label").cast("bigint").alias("cluster"), year.alias("year"),
        era_of(year.cast("string")).alias("president"), F.concat(F.lit("V"), F.col("vec_id")).alias("filename"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def metadata(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).select("filename", "year", "president")


def coords(spark, sf_dir) -> DataFrame:
    """The first two vector elements as plot coordinates."""
    two = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xy")]
    return vectors(spark, sf_dir).select(F.concat(F.lit("V"), F.col("vec_id")).alias("filename"), *two)


def labels(spark, sf_dir) -> DataFrame:
    return labelled(spark, sf_dir).select("filename", "cluster")


XY = "CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y"


def yearly_drift(spark, sf_dir) -> DataFrame:
    return drift.consecutive_drift(drift.yearly_centroids(labelled(spark, sf_dir)))


# ----------------------------------------------------------------- drift and counts


@query("a01_cluster_sizes", f"WITH {LABELLED} SELECT cluster, count(*) AS n FROM labelled GROUP BY cluster")
def a01(spark, sf_dir):
    return drift.cluster_sizes(labelled(spark, sf_dir))


@query("a02_cluster_by_president", f"WITH {LABELLED} SELECT cluster, president, count(*) AS n FROM labelled GROUP BY ALL")
def a02(spark, sf_dir):
    return drift.cluster_by_group(labelled(spark, sf_dir))


@query("a03_cluster_by_year", f"""WITH {LABELLED}
SELECT cluster, y AS year, count(*) AS n FROM (
  SELECT cluster, CASE WHEN president = 'Bush' THEN 'Unknown' ELSE CAST(year AS VARCHAR) END AS y FROM labelled)
WHERE y <> 'Unknown' GROUP BY ALL""")
def a03(spark, sf_dir):
    """Years of one era are taken for unknown, as a key without date gives them."""
    year = F.when(F.col("president") == "Bush", "Unknown").otherwise(F.col("year").cast("string"))
    return drift.cluster_by_year(labelled(spark, sf_dir).withColumn("year", year))


@query("a04_yearly_centroids", f"WITH {CENTROIDS} SELECT year, CAST(pos AS BIGINT) AS pos, round(v, 6) AS value FROM centroids")
def a04(spark, sf_dir):
    return long_rounded(drift.yearly_centroids(labelled(spark, sf_dir)), "year", "centroid")


@query("a05_yearly_drift", f"WITH {CENTROIDS} SELECT from_year, to_year, round(drift, 6) AS drift FROM drift")
def a05(spark, sf_dir):
    return rounded(yearly_drift(spark, sf_dir), "drift")


def _positions(spark, sf_dir) -> DataFrame:
    return drift.centroid_positions(drift.yearly_centroids(labelled(spark, sf_dir)))


@query("a06_centroid_positions")
def a06(spark, sf_dir):
    return rounded(_positions(spark, sf_dir).withColumn("idx", F.col("idx").cast("bigint")), "position", digits=5)


@query("a07_trend")
def a07(spark, sf_dir):
    return rounded(drift.trend(_positions(spark, sf_dir)), "slope", "intercept", digits=5)


@query("a08_no_valid_years", "SELECT CAST(NULL AS INTEGER) AS from_year, CAST(NULL AS INTEGER) AS to_year, CAST(NULL AS DOUBLE) AS drift FROM embeddings WHERE label < -1000")
def a08(spark, sf_dir):
    """All years unknown: no centroid, no drift, the same columns."""
    unknown = labelled(spark, sf_dir).withColumn("year", F.lit("Unknown"))
    return drift.consecutive_drift(drift.yearly_centroids(unknown))


@query("a09_analyse_all")
def a09(spark, sf_dir):
    """k-means and density clustering with their model selection, composition of the chosen clusters, drift."""
    points = labelled(spark, sf_dir)
    sweep = cluster.kmeans_select(points, "vec_id", "embedding")
    dense = cluster.dbscan_sweep(points, "vec_id", "embedding")
    chosen = cluster.assign(points.drop("cluster"), "embedding", sweep.best.centers)
    by_president = drift.cluster_by_group(chosen).select(
        F.lit("kmeans").alias("part"), F.concat_ws("/", "cluster", "president").alias("name"), F.col("n").cast("double").alias("value"))
    by_density = drift.cluster_sizes(dense.labels).select(
        F.lit("dbscan").alias("part"), F.col("cluster").cast("string").alias("name"), F.col("n").cast("double").alias("value"))
    moves = yearly_drift(spark, sf_dir).select(
        F.lit("drift").alias("part"), F.concat_ws("-", "from_year", "to_year").alias("name"), F.col("drift").alias("value"))
    return by_president.unionByName(by_density).unionByName(moves)


@query("a10_counts_by_president", f"WITH {CORPUS} SELECT president, count(*) AS n FROM corpus GROUP BY president")
def a10(spark, sf_dir):
    return drift.counts_by(corpus(spark, sf_dir), "president")


@query("a11_counts_by_year", f"WITH {CORPUS} SELECT year, count(*) AS n FROM corpus GROUP BY year")
def a11(spark, sf_dir):
    return drift.counts_by_year(corpus(spark, sf_dir))


# ------------------------------------------------------------------------ plot tables


@query("v01_scatter_by_president", f"WITH {LABELLED} SELECT filename, {XY}, president FROM labelled WHERE president <> 'Unknown'")
def v01(spark, sf_dir):
    return plotdata.scatter_by_president(coords(spark, sf_dir), metadata(spark, sf_dir))


@query("v02_scatter_by_cluster", f"WITH {LABELLED} SELECT filename, {XY}, cluster FROM labelled")
def v02(spark, sf_dir):
    return plotdata.scatter_by_cluster(coords(spark, sf_dir), labels(spark, sf_dir))


@query("v03_drift_bars", f"WITH {CENTROIDS} SELECT from_year || '-' || to_year AS label, round(drift, 6) AS drift FROM drift")
def v03(spark, sf_dir):
    return rounded(plotdata.drift_bars(yearly_drift(spark, sf_dir)), "drift")


# The first centroid element as position: the line through it has a twin.
@query("v04_gravity_line", f"""WITH {CENTROIDS},
p AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS idx, v AS position FROM centroids WHERE pos = 1),
t AS (SELECT regr_slope(position, idx) AS slope, regr_intercept(position, idx) AS intercept FROM p)
SELECT year, round(position, 6) AS position, round(intercept + slope * idx, 6) AS fitted, round(slope, 6) AS slope FROM p, t""")
def v04(spark, sf_dir):
    from pyspark.sql.window import Window

    centroids = drift.yearly_centroids(labelled(spark, sf_dir))
    idx = F.row_number().over(Window.orderBy("year")) - 1  # one row per year
    positions = centroids.select("year", idx.alias("idx"), F.get("centroid", F.lit(0)).alias("position"))
    return rounded(plotdata.gravity_line(positions, drift.trend(positions)), "position", "fitted", "slope")


@query("v04_gravity_line_on_axis")
def v04_axis(spark, sf_dir):
    positions = _positions(spark, sf_dir)
    return rounded(plotdata.gravity_line(positions, drift.trend(positions)), "position", "fitted", "slope", digits=5)


def _variance(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return reduce.variance_table(v, reduce.pca_coordinates(v, "vec_id", "embedding")[1])


@query("v05_variance_bars")
def v05_bars(spark, sf_dir):
    return plotdata.variance_bars(_variance(spark, sf_dir))


@query("v05_variance_curve")
def v05_curve(spark, sf_dir):
    return plotdata.variance_curve(_variance(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (president = '{p}') AS {p}" for p in PRESIDENTS)
_TOTAL = "greatest(" + " + ".join(PRESIDENTS) + ", 1)"


@query("v06_composition_heatmap", f"""WITH {LABELLED}, c AS (SELECT cluster, {_COUNTS} FROM labelled GROUP BY cluster)
SELECT cluster, {', '.join(f'round({p} / {_TOTAL}, 6) AS {p}' for p in PRESIDENTS)} FROM c""")
def v06(spark, sf_dir):
    return rounded(plotdata.composition_heatmap(labelled(spark, sf_dir)), *PRESIDENTS)


SERIES = f"""{LABELLED}, c AS (SELECT filename, year, president, {XY} FROM labelled),
series AS (SELECT filename, year, 'pc1' AS component, x AS value, president FROM c
           UNION ALL SELECT filename, year, 'pc2', y, president FROM c)"""


@query("v07_year_series", f"WITH {SERIES} SELECT * FROM series")
def v07(spark, sf_dir):
    return plotdata.year_series(coords(spark, sf_dir), metadata(spark, sf_dir))


@query("v07_year_trends", f"""WITH {SERIES}
SELECT component, round(regr_slope(value, year), 6) AS slope, round(regr_intercept(value, year), 4) AS intercept
FROM series GROUP BY component""")
def v07_trends(spark, sf_dir):
    fits = plotdata.year_trends(plotdata.year_series(coords(spark, sf_dir), metadata(spark, sf_dir)))
    return fits.select("component", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("v08_timeline_frames", f"WITH {LABELLED} SELECT year AS frame, filename, {XY}, president FROM labelled")
def v08(spark, sf_dir):
    return plotdata.timeline_frames(coords(spark, sf_dir), metadata(spark, sf_dir))


_ERA_ORDER = "CASE president " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRESIDENTS)) + " END"


@query("v09_president_panels", f"""WITH {LABELLED},
known AS (SELECT *, {_ERA_ORDER} AS r FROM labelled WHERE president <> 'Unknown'),
titles AS (SELECT r, row_number() OVER (ORDER BY r) AS panel, count(*) AS n FROM known GROUP BY r)
SELECT panel, president, n, filename, {XY}, year FROM known JOIN titles USING (r)""")
def v09(spark, sf_dir):
    return plotdata.president_panels(coords(spark, sf_dir), metadata(spark, sf_dir)).withColumn("panel", F.col("panel").cast("bigint"))


@query("v10_centroid_trajectory", f"""WITH {LABELLED},
m AS (SELECT year, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y FROM labelled GROUP BY year)
SELECT year, round(x, 6) AS x, round(y, 6) AS y, (row_number() OVER (ORDER BY year) - 1) % 2 = 0 AS annotated FROM m""")
def v10(spark, sf_dir):
    return rounded(plotdata.centroid_trajectory(coords(spark, sf_dir), metadata(spark, sf_dir)), "x", "y")


# ------------------------------------------------------------------ exports and report


@query("x02_coordinate_export", f"WITH {LABELLED} SELECT {XY}, filename, president, year FROM labelled")
def x02(spark, sf_dir):
    return report.coordinate_export(coords(spark, sf_dir), metadata(spark, sf_dir))


@query("x03_cluster_export", f"WITH {LABELLED} SELECT filename, president, year, cluster FROM labelled")
def x03(spark, sf_dir):
    return report.cluster_export(labels(spark, sf_dir), metadata(spark, sf_dir))


STATS = f"""{LABELLED},
per AS (SELECT cluster, president, count(*) AS n FROM labelled GROUP BY ALL),
stats AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS count, first(president ORDER BY n DESC, president) AS president FROM per GROUP BY cluster)"""


@query("x04_cluster_stats", f"WITH {STATS} SELECT * FROM stats")
def x04(spark, sf_dir):
    return report.cluster_stats(labelled(spark, sf_dir))


@query("x05_drift_summary", f"""WITH {CENTROIDS} SELECT round(avg(drift), 6) AS mean_drift, round(max(drift), 6) AS max_drift,
round(min(drift), 6) AS min_drift, round(sum(drift), 6) AS total_change FROM drift""")
def x05(spark, sf_dir):
    found = report.drift_summary(yearly_drift(spark, sf_dir))
    return rounded(found, *found.columns)


@query("x06_overview", f"WITH {LABELLED} SELECT count(*) AS documents, min(year) AS first_year, max(year) AS last_year FROM labelled")
def x06(spark, sf_dir):
    return report.overview(metadata(spark, sf_dir))


@query("x07_president_share", f"""WITH {CORPUS}
SELECT president, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percent FROM corpus GROUP BY president""")
def x07(spark, sf_dir):
    return report.president_share(corpus(spark, sf_dir))


@query("x08_top_transitions", f"WITH {CENTROIDS} SELECT from_year, to_year, round(drift, 6) AS drift FROM drift ORDER BY drift.drift DESC, from_year LIMIT 3")
def x08(spark, sf_dir):
    return rounded(report.top_transitions(yearly_drift(spark, sf_dir)), "drift")


CLUSTER_LINE = "'- Cluster ' || cluster || ': ' || count || ' orders (primarily ' || president || ')'"


@query("x09_cluster_lines", f"WITH {STATS} SELECT cluster, {CLUSTER_LINE} AS line FROM stats")
def x09(spark, sf_dir):
    return report.cluster_lines(report.cluster_stats(labelled(spark, sf_dir)))


@query("x10_summary_report", f"""WITH {CENTROIDS},
per AS (SELECT cluster, president, count(*) AS n FROM labelled GROUP BY ALL),
stats AS (SELECT cluster, CAST(sum(n) AS BIGINT) AS count, first(president ORDER BY n DESC, president) AS president FROM per GROUP BY cluster),
shares AS (SELECT president, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM labelled GROUP BY president),
lines(section, place, tie, line) AS (
  SELECT 0, 0.0::DOUBLE, '', '# Corpus Analysis Summary Report' UNION ALL SELECT 0, 1, '', 'Generated: 2026-01-01 00:00:00'
  UNION ALL SELECT 0, 2, '', '' UNION ALL SELECT 0, 3, '', '## Dataset Overview'
  UNION ALL SELECT 1, 0, '', '- Total executive orders analyzed: ' || count(*) FROM labelled
  UNION ALL SELECT 2, 0, '', '- Date range: ' || min(year) || ' - ' || max(year) FROM labelled
  UNION ALL SELECT 3, 0, '', '' UNION ALL SELECT 3, 1, '', '### Distribution by President'
  UNION ALL SELECT 4, -n, president, '- ' || president || ': ' || n || ' orders (' || printf('%.1f', pct) || '%)' FROM shares
  UNION ALL SELECT 5, 0, '', '' UNION ALL SELECT 5, 1, '', '## Semantic Drift Analysis'
  UNION ALL SELECT 6, 0, '', '- Mean semantic drift between years: ' || printf('%.3f', avg(drift)) FROM drift
  UNION ALL SELECT 7, 0, '', '- Maximum drift: ' || printf('%.3f', max(drift)) FROM drift
  UNION ALL SELECT 8, 0, '', '' UNION ALL SELECT 8, 1, '', '### Most Significant Transitions:'
  UNION ALL SELECT 9, -d, lpad(CAST(from_year AS VARCHAR), 6, '0'), '- ' || from_year || ' → ' || to_year || ': ' || printf('%.3f', d)
    FROM (SELECT from_year, to_year, drift AS d FROM drift ORDER BY d DESC, from_year LIMIT 3)
  UNION ALL SELECT 10, 0, '', '' UNION ALL SELECT 10, 1, '', '## Kmeans Clustering Results'
  UNION ALL SELECT 11, 0, '', '- Number of clusters: ' || count(*) FROM stats
  UNION ALL SELECT 12, 0, '', '' UNION ALL SELECT 12, 1, '', '### Cluster Sizes:'
  UNION ALL SELECT 13, cluster, '', {CLUSTER_LINE} FROM stats
  UNION ALL SELECT 14, 0, '', '')
SELECT row_number() OVER (ORDER BY section, place, tie) AS seq, line FROM lines""")
def x10(spark, sf_dir):
    stats = report.cluster_stats(labelled(spark, sf_dir))
    lines = report.summary_report(metadata(spark, sf_dir), yearly_drift(spark, sf_dir), stats,
                                  "Corpus Analysis Summary Report", "2026-01-01 00:00:00")
    return lines.withColumn("seq", F.col("seq").cast("bigint"))


@query("x11_key_findings")
def x11(spark, sf_dir):
    v = vectors(spark, sf_dir)
    sweep = cluster.kmeans_select(v, "vec_id", "embedding")
    needed = reduce.components_needed(_variance(spark, sf_dir))
    return report.key_findings(drift.trend(_positions(spark, sf_dir)), sweep.best.k, needed)


@query("s14_coordinate_tables", f"""WITH {LABELLED},
long AS (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos),
sizes AS (SELECT vec_id, sum(((v - m) / sd) * ((v - m) / sd)) AS squares FROM long JOIN s USING (pos) GROUP BY vec_id)
SELECT filename, round(squares, 5) AS squares, CAST(64 AS BIGINT) AS axes, CAST(64 AS BIGINT) AS variance_rows, CAST(1.0 AS DOUBLE) AS variance
FROM labelled JOIN sizes USING (vec_id)""")
def s14(spark, sf_dir):
    """Coordinates, variance table and model are written and read back; the stored model gives the stored coordinates."""
    root = scratch_path(spark, "reduction")
    v = labelled(spark, sf_dir)
    coords, scaler, fit = reduce.reduce_points(v, "vec_id", "embedding", 64)
    sinks.write_table(coords, f"{root}/coordinates")
    sinks.write_csv(reduce.variance_table(v, fit), f"{root}/variance.csv")
    sinks.write_table(reduce.model_table(spark, scaler, fit), f"{root}/model")
    variance = sinks.read_csv_records(reduce.variance_table(v, fit), f"{root}/variance.csv")
    scaler, fit = reduce.read_model(spark.read.parquet(f"{root}/model"))
    again = v.select("vec_id", "filename", fit.project(F.col("embedding").cast("array<double>"), scaler=scaler).alias("again"))
    both = spark.read.parquet(f"{root}/coordinates").join(again, "vec_id")
    # A coordinate table that differs from what the stored model gives would show in the products.
    squares = F.aggregate(F.zip_with("pos", "again", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    shares = variance.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("explained_variance"), 6).alias("whole")).head()
    return both.select(
        "filename", F.round(squares, 5).alias("squares"), F.lit(fit.k).cast("bigint").alias("axes"),
        F.lit(shares["n"]).cast("bigint").alias("variance_rows"), F.lit(shares["whole"]).alias("variance"))


@query("s15_composition_table", f"WITH {LABELLED} SELECT cluster, president, count(*) AS n FROM labelled GROUP BY ALL")
def s15(spark, sf_dir):
    root = scratch_path(spark, "clusters")
    counts = drift.cluster_by_group(labelled(spark, sf_dir))
    sinks.write_csv(counts, f"{root}/composition.csv")
    sinks.write_table(labels(spark, sf_dir), f"{root}/labels")
    sinks.write_csv(yearly_drift(spark, sf_dir), f"{root}/drift.csv")
    return sinks.read_csv_records(counts, f"{root}/composition.csv")


@query("s15_labels_and_drift", f"""WITH {CENTROIDS}
SELECT 'label' AS kind, filename AS name, CAST(cluster AS DOUBLE) AS value FROM labelled
UNION ALL SELECT 'drift', from_year || '-' || to_year, round(drift, 6) FROM drift""")
def s15_read_back(spark, sf_dir):
    """The label table and the drift file, read back."""
    root = scratch_path(spark, "clusters")
    moves = yearly_drift(spark, sf_dir)
    sinks.write_table(labels(spark, sf_dir), f"{root}/labels")
    sinks.write_csv(moves, f"{root}/drift.csv")
    stored = spark.read.parquet(f"{root}/labels").select(F.lit("label").alias("kind"), F.col("filename").alias("name"), F.col("cluster").cast("double").alias("value"))
    again = sinks.read_csv_records(moves, f"{root}/drift.csv")
    return stored.unionByName(again.select(F.lit("drift").alias("kind"), F.concat_ws("-", "from_year", "to_year").alias("name"), F.round("drift", 6).alias("value")))


@query("s17_export", f"""WITH {LABELLED}
SELECT 'csv' AS format, filename, president, year, cluster FROM labelled
UNION ALL SELECT 'json', filename, president, year, cluster FROM labelled""")
def s17(spark, sf_dir):
    rows = report.cluster_export(labels(spark, sf_dir), metadata(spark, sf_dir))
    paths = sinks.export(rows, scratch_path(spark, "exports"), "clusters", sinks.run_stamp())
    as_csv = sinks.read_csv_records(rows, paths["csv"]).withColumn("format", F.lit("csv"))
    return as_csv.unionByName(sinks.read_json_records(rows, paths["json"]).withColumn("format", F.lit("json")))


# ----------------------------------------------------------------- training batches

# A turn and the next one are a pair; where a third follows, the record has three texts.
TURNS = """turns AS (
  SELECT a.conv_id * 1000 + a.turn AS id, a.role, a.turn, a.text AS t1, b.text AS t2, c.text AS t3,
         length(a.text) % 4 AS kind
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  LEFT JOIN conversations c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2)"""


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")

    def later(step: int, name: str) -> DataFrame:
        return c.select("conv_id", (F.col("turn") - step).alias("turn"), F.col("text").alias(name))

    return c.withColumnRenamed("text", "t1").join(later(1, "t2"), ["conv_id", "turn"]).join(
        later(2, "t3"), ["conv_id", "turn"], "left"
    ).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "turn", "t1", "t2", "t3",
             (F.length("t1") % 4).alias("kind"))


def lines(spark, sf_dir) -> DataFrame:
    """JSON records in all accepted shapes, by the length of the first text."""
    t = turns(spark, sf_dir)
    pair = F.array("t1", "t2")
    line = (
        F.when(F.col("kind") == 0, F.to_json(pair))
        .when(F.col("kind") == 1, F.to_json(F.struct(pair.alias("texts"))))
        .when(F.col("kind") == 2, F.to_json(F.struct(F.col("t2").alias("response"), F.col("t1").alias("context"))))
        .otherwise(F.to_json(F.struct(F.col("t2").alias("response"))))
    )
    return t.select("id", line.alias("line"))


def samples(spark, sf_dir) -> DataFrame:
    """(dataset, id, texts): opening turns, whose records may have three texts, and the others by role."""
    opening = F.col("turn") == 0
    name = F.when(opening & F.col("t3").isNotNull(), "triples").otherwise(F.col("role"))
    listed = F.when(opening & F.col("t3").isNotNull(), F.array("t1", "t2", "t3")).otherwise(F.array("t1", "t2"))
    return turns(spark, sf_dir).select(name.alias("dataset"), "id", listed.alias("texts"))


SAMPLES = f"""{TURNS},
samples AS (SELECT CASE WHEN turn = 0 AND t3 IS NOT NULL THEN 'triples' ELSE role END AS dataset, id,
            CASE WHEN turn = 0 AND t3 IS NOT NULL THEN [t1, t2, t3] ELSE [t1, t2] END AS texts FROM turns)"""


@query("p01_unify_records", f"WITH {TURNS} SELECT id, t1 || '|' || t2 AS texts FROM turns WHERE kind <= 1")
def p01(spark, sf_dir):
    unified = lines(spark, sf_dir).select("id", batches.unify_record(F.col("line")).alias("t"))
    return unified.filter(F.col("t").isNotNull()).select("id", F.array_join("t", "|").alias("texts"))


@query("p02_response_context", f"WITH {TURNS} SELECT id, t2 || '|' || t1 AS texts FROM turns WHERE kind = 2")
def p02(spark, sf_dir):
    paired = lines(spark, sf_dir).select("id", batches.response_context(F.col("line")).alias("t"))
    return paired.filter(F.col("t").isNotNull()).select("id", F.array_join("t", "|").alias("texts"))


@query("s18_training_files", f"WITH {TURNS} SELECT t1 || '|' || t2 AS texts FROM turns WHERE kind <= 1")
def s18(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    lines(spark, sf_dir).select("line").write.option("compression", "gzip").text(path)
    unified = landed.read_training_lines(spark, path).select(batches.unify_record(F.col("line")).alias("t"))
    return unified.filter(F.col("t").isNotNull()).select(F.array_join("t", "|").alias("texts"))


# Datasets by role alone mix two and three texts.
MIXED = f"""{SAMPLES}, mixed AS (SELECT t.role AS dataset, s.id, CAST(len(s.texts) AS BIGINT) AS arity FROM samples s JOIN turns t USING (id)),
per AS (SELECT dataset, arity, count(*) AS n FROM mixed GROUP BY ALL),
verdict AS (SELECT dataset, first(arity ORDER BY n DESC, arity) AS common, count(*) AS n_arities, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY dataset)"""


def _mixed(spark, sf_dir) -> DataFrame:
    roles = turns(spark, sf_dir).select("id", "role")
    return samples(spark, sf_dir).drop("dataset").join(roles, "id").withColumnRenamed("role", "dataset")


@query("p03_arity_verdicts", f"WITH {MIXED} SELECT dataset, common, n_arities, n, n_arities = 1 AND common IN (2, 3) AS ok FROM verdict")
def p03(spark, sf_dir):
    return batches.check_arity(_mixed(spark, sf_dir))[0].withColumn("common", F.col("common").cast("bigint"))


@query("p03_arity_rejects", f"WITH {MIXED} SELECT m.dataset, m.id, m.arity FROM mixed m JOIN verdict v USING (dataset) WHERE m.arity <> v.common OR m.arity NOT IN (2, 3)")
def p03_rejects(spark, sf_dir):
    return batches.check_arity(_mixed(spark, sf_dir))[1].select("dataset", "id", F.col("arity").cast("bigint").alias("arity"))


WEIGHTS = [("assistant", 2, 2), ("triples", 1, 3), ("user", 3, 2)]
PLAN = batches.BatchPlan(batch_size=4, workers=2, datasets_per_batch=2)
_UNIT = "CAST(('0x' || substr(md5('42:' || {batch} || ':' || {draw}), 1, 12)) AS BIGINT) / 281474976710656.0"


def _pick_sql(unit: str, choices) -> str:
    total, upto, arms = sum(w for _, w in choices), 0, []
    for name, weight in choices[:-1]:
        upto += weight
        arms.append(f"WHEN ({unit}) * {total} < {upto} THEN '{name}'")
    return f"CASE {' '.join(arms)} ELSE '{choices[-1][0]}' END" if arms else f"'{choices[-1][0]}'"


_FIRST = _pick_sql(_UNIT.format(batch="batch", draw="0"), [(n, w) for n, w, _ in WEIGHTS])
_LATER = _pick_sql(_UNIT.format(batch="batch", draw="draw"), [(n, w) for n, w, a in WEIGHTS if a == 2])

DRAWS = f"""{SAMPLES},
size AS (SELECT CAST(ceil(count(*) / {PLAN.global_size}.0) AS BIGINT) AS n FROM samples),
batches AS (SELECT unnest(generate_series(0, n - 1)) AS batch FROM size),
draws AS (SELECT batch, 0 AS draw, {_FIRST} AS dataset FROM batches
          UNION ALL SELECT batch, 1, CASE WHEN {_FIRST} = 'triples' THEN 'triples' ELSE {_LATER.replace('draw', '1')} END FROM batches)"""


@query("p04_weighted_sample", f"""WITH {DRAWS},
turned AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY batch, draw) AS turn FROM draws),
slots AS (SELECT *, unnest(generate_series(0, {PLAN.per_dataset - 1})) AS slot FROM turned),
ordered AS (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:0:' || id), id) AS ord FROM samples),
counts AS (SELECT dataset, count(*) AS n FROM samples GROUP BY dataset)
SELECT batch, CAST(draw AS BIGINT) AS draw, slot, dataset, id
FROM slots JOIN counts USING (dataset) JOIN ordered USING (dataset) WHERE ord = ((turn - 1) * {PLAN.per_dataset} + slot) % n + 1""")
def p04(spark, sf_dir):
    """As many batches as one pass over the samples fills."""
    rows = samples(spark, sf_dir)
    n_batches = -(-rows.count() // PLAN.global_size)
    drawn = batches.weighted_sample(rows, "id", WEIGHTS, PLAN, n_batches)
    return drawn.select("batch", F.col("draw").cast("bigint").alias("draw"), F.col("slot").cast("bigint").alias("slot"), "dataset", "id")


@query("p05_unique_batches", f"""WITH {DRAWS},
turned AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY batch, draw) AS turn FROM draws),
slots AS (SELECT *, unnest(generate_series(0, {PLAN.per_dataset - 1})) AS slot FROM turned),
ordered AS (SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:0:' || id), id) AS ord FROM samples),
counts AS (SELECT dataset, count(*) AS n FROM samples GROUP BY dataset),
meant AS (SELECT (batch * {PLAN.datasets_per_batch} + draw) * {PLAN.per_dataset} + slot AS use, dataset, id
          FROM slots JOIN counts USING (dataset) JOIN ordered USING (dataset) WHERE ord = ((turn - 1) * {PLAN.per_dataset} + slot) % n + 1),
rest AS (SELECT dataset, id FROM samples WHERE dataset IN ({", ".join(f"'{n}'" for n, _, _ in WEIGHTS)}) EXCEPT SELECT dataset, id FROM meant),
uses AS (SELECT use, dataset, id FROM meant UNION ALL
         SELECT row_number() OVER (ORDER BY md5('42:rest:' || id), dataset, id) + n * {PLAN.global_size}, dataset, id FROM rest, size)
SELECT batch, CAST({PLAN.global_size} AS BIGINT) AS places, CAST(0 AS BIGINT) AS over, CAST(1 AS BIGINT) AS arities,
       CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS fitting, CAST(NULL AS BIGINT) AS use, CAST(NULL AS VARCHAR) AS dataset,
       CAST(NULL AS BIGINT) AS id FROM batches
UNION ALL SELECT NULL, NULL, NULL, NULL, 0, 0, use, dataset, id FROM uses""")
def p05(spark, sf_dir):
    """Batches over the weighted draws: of one arity, no text twice, short only where no waiting sample fits.

    A row for each batch with what is wrong with it, and a row for each use of a sample, in a batch or passed over.
    """
    rows = samples(spark, sf_dir)
    n_batches = -(-rows.count() // PLAN.global_size)
    found = write_and_read(batches.training_batches(rows, "id", WEIGHTS, PLAN, n_batches), "p05-batches")
    capacity = batches.batch_capacity(spark, WEIGHTS, PLAN, n_batches)
    checked = batches.batch_faults(found, rows, "id", capacity)
    uses = batches.use_faults(found, rows, "id", capacity)
    return checked.unionByName(uses, allowMissingColumns=True)


@query("p05_batches_in_order", f"""WITH {SAMPLES}
SELECT pos // 64 AS batch, CAST(64 AS BIGINT) AS places, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS repeats,
       CAST(0 AS BIGINT) AS fitting FROM (SELECT row_number() OVER () - 1 AS pos FROM samples) GROUP BY 1""")
def p05_in_order(spark, sf_dir):
    """Batches of 64 along one shuffled order, whatever the dataset."""
    rows = samples(spark, sf_dir).withColumn("_key", batches.epoch_order(F.lit(42), F.lit(0), F.col("id")))
    ordered = number_rows(rows.select("id", "texts", "_key"), [F.col("_key"), F.col("id")])
    found = write_and_read(batches.unique_batches(ordered.select("id", "texts", "row_no"), "id", 64), "p05-ordered")
    n_batches = -(-rows.count() // 64)
    capacity = spark.range(n_batches).select(F.col("id").alias("batch"), F.lit("").alias("dataset"), F.lit(64).alias("places"))
    uses = found.select(F.monotonically_increasing_id().alias("use"), F.lit("").alias("dataset"), "id", "batch")
    return batches.batch_faults(uses, rows.withColumn("dataset", F.lit("")), "id", capacity).drop("arities")


@query("p06_batch_sizes", f"""WITH {SAMPLES}
SELECT dataset, CAST(512 AS BIGINT) AS global_size, CAST(256 AS BIGINT) AS per_dataset, count(*) // 256 AS full_shares FROM samples GROUP BY dataset""")
def p06(spark, sf_dir):
    """How many whole shares of a global batch each dataset fills."""
    plan = batches.BatchPlan(batch_size=64, workers=8, datasets_per_batch=2)
    counts = samples(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("dataset", F.lit(plan.global_size).cast("bigint").alias("global_size"),
                         F.lit(plan.per_dataset).cast("bigint").alias("per_dataset"),
                         F.floor(F.col("n") / plan.per_dataset).alias("full_shares"))


@query("p07_epoch_shuffle", f"""WITH {SAMPLES}
SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY md5('7:3:' || id), id) AS ord FROM samples""")
def p07(spark, sf_dir):
    return batches.shuffled(samples(spark, sf_dir).select("dataset", "id"), "id", 7, 3).select("dataset", "id", "ord")


# ---------------------------------------------------------------------------- streams


def _landed(spark, sf_dir, name: str, **options) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return stream.landed_stream(spark, f"{sf_dir}/{name}*.parquet", schema, **options)


def register() -> None:
    from semdrift.plans.catalog.vector_queries import hash_vectors

    docs = hash_vectors("documents", "doc_id", "d")

    @query("z01_stream_clean_embed", f"""WITH {docs}
SELECT doc_id, md5(text) AS content_md5, pos, round(value, 6) AS value FROM d_words JOIN d_vectors USING (doc_id)""")
    def z01(spark, sf_dir):
        path = scratch_path(spark, "stream")
        done = stream.clean_and_embed(_landed(spark, sf_dir, "documents"), "doc_id", EmbedSettings().dim, CleanSettings(use_lemmas=False))
        stream.run_to_table(done, f"{path}/table", f"{path}/progress")
        long = reduce.long_form(spark.read.parquet(f"{path}/table").drop("text"), "doc_id", "embedding")
        md5s = spark.read.parquet(f"{path}/table").select("doc_id", "content_md5")
        return long.filter("value <> 0").join(md5s, "doc_id").select(
            "doc_id", "content_md5", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("z02_stream_first_copies", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def z02(spark, sf_dir):
    """First event per user and type on the event clock; the bound spans the table."""
    path = scratch_path(spark, "stream")
    events = _landed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first = stream.first_copies(events, ["user_id", "event_type"], "ts", "36500 days")
    stream.run_to_table(first.select("user_id", "event_type"), f"{path}/table", f"{path}/progress")
    return spark.read.parquet(f"{path}/table").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("z03_stream_drift", f"WITH {CENTROIDS} SELECT from_year, to_year, round(drift, 6) AS drift FROM drift")
def z03(spark, sf_dir):
    path = scratch_path(spark, "stream")
    arriving = _landed(spark, sf_dir, "embeddings").select(
        (F.lit(1994) + F.col("vec_id") % 32).cast("string").alias("year"), "embedding")
    stream.run_centroids(arriving, f"{path}/parts", f"{path}/progress")
    return rounded(stream.merged_drift(spark, f"{path}/parts"), "drift")


@query("z03_changing_documents", f"WITH {CENTROIDS} SELECT from_year, to_year, round(drift, 6) AS drift FROM drift")
def z03_changes(spark, sf_dir):
    """Earlier versions of a third of the vectors come last, other documents come and go: the drift is that of the table."""
    path, v = scratch_path(spark, "changes"), vectors(spark, sf_dir)
    year = (F.lit(1994) + F.col("vec_id") % 32).cast("string")
    true = v.select(F.col("vec_id").cast("string").alias("key"), F.lit(2).cast("bigint").alias("version"), year.alias("year"), "embedding", F.lit(False).alias("deleted"))
    before = v.filter("vec_id % 3 = 0").select(
        F.col("vec_id").cast("string").alias("key"), F.lit(1).cast("bigint").alias("version"),
        (F.lit(1994) + (F.col("vec_id") + 5) % 32).cast("string").alias("year"), F.reverse("embedding").alias("embedding"), F.lit(False).alias("deleted"))
    guests = true.filter("key % 4 = 1").withColumn("key", F.concat(F.lit("guest "), "key"))
    leaving = guests.withColumn("version", F.lit(3).cast("bigint")).withColumn("deleted", F.lit(True))
    early, late = before.filter("key % 2 = 0"), before.filter("key % 2 = 1")
    for part in (early.unionByName(guests), true, late.unionByName(leaving)):
        part.coalesce(1).write.mode("append").parquet(f"{path}/landing")
    arriving = stream.landed_stream(spark, f"{path}/landing", true.schema, 1)
    changes.run_changes(arriving, f"{path}/store", f"{path}/progress")
    return rounded(changes.current_drift(spark, f"{path}/store"), "drift")
