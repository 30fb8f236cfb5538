"""Standardised vectors and principal components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from semdrift.functions.arrow import from_matrix, to_matrix
from semdrift.functions.vectors import usable


@dataclass(frozen=True)
class Scaler:
    """Mean and inverse population deviation of each dimension; 0 for a constant one."""

    mean: np.ndarray
    factor: np.ndarray
    n: int

    def apply(self, vector: Column) -> Column:
        mean, factor = self.mean, self.factor

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scale(rows: pa.Array) -> pa.Array:
            return from_matrix((to_matrix(rows, len(mean)) - mean) * factor, pa.float64())

        return scale(vector)


@dataclass(frozen=True)
class Moments:
    """Number, mean and centred products of the usable vectors; d x d numbers whatever their number."""

    n: int
    mean: np.ndarray
    products: np.ndarray  # sum of (x - mean)(x - mean)'

    def scaler(self) -> Scaler:
        variance = np.diag(self.products) / max(1, self.n)
        constant = variance <= 1e-20 + 1e-24 * self.mean * self.mean
        return Scaler(self.mean, np.where(constant, 0.0, 1.0 / np.sqrt(np.where(constant, 1.0, variance))), self.n)

    def scaled(self, scaler: Scaler) -> Moments:
        """What the standardised vectors have."""
        return Moments(self.n, (self.mean - scaler.mean) * scaler.factor, self.products * np.outer(scaler.factor, scaler.factor))

    def axes(self, k: int) -> PcaFit:
        """The first k principal axes about the mean; the loading of the largest size (the first of equals) is positive."""
        values, vectors = np.linalg.eigh(self.products)
        order = np.argsort(-values, kind="stable")[: max(1, min(k, len(values), self.n - 1))]
        components = vectors[:, order].T
        top = np.abs(np.round(components, 12)).argmax(axis=1)
        components = components * np.where(components[np.arange(len(order)), top] < 0, -1.0, 1.0)[:, None]
        whole = max(float(np.trace(self.products)), 1e-300)
        return PcaFit(components, np.maximum(values[order], 0.0) / whole)


def moments(points: DataFrame, vec_col: str) -> Moments:
    """One pass over the usable vectors: every task adds up products about one of the vectors, Spark adds up the tasks, row by row."""
    x = points.select(F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    first = x.head()
    if first is None:
        raise ValueError("there are no usable vectors")
    origin = np.array(first["vec"])

    def partial(batches):
        n, total, products = 0, np.zeros(len(origin)), np.zeros((len(origin), len(origin)))
        for batch in batches:
            y = to_matrix(batch.column("vec"), len(origin)) - origin
            n, total, products = n + len(y), total + y.sum(axis=0), products + y.T @ y
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(np.arange(-1, len(origin)), pa.int32()), "n": pa.array([n] + [0] * len(origin), pa.int64()),
            "sums": from_matrix(np.vstack([total, products]), pa.float64()),
        })

    partials = x.mapInArrow(partial, "row int, n bigint, sums array<double>")
    summed = partials.groupBy("row").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("s"))
    rows = summed.select("row", "n", vector_to_array("s").alias("s")).toArrow()  # d + 1 rows
    order = np.argsort(rows.column("row").to_numpy())
    sums, n = to_matrix(rows.column("s"))[order], int(rows.column("n").to_numpy().sum())
    return Moments(n, origin + sums[0] / n, sums[1:] - np.outer(sums[0], sums[0]) / n)


def fit_scaler(points: DataFrame, vec_col: str) -> Scaler:
    """One aggregation over the points; the result has one number per dimension."""
    vec = array_to_vector(F.col(vec_col).cast("array<double>"))
    row = points.select(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s")).select("s.*").head()
    n, mean, sample = int(row["count"]), row["mean"].toArray(), row["variance"].toArray()
    variance = sample * (n - 1) / n if n > 1 else np.zeros_like(sample)
    constant = variance <= 1e-20 + 1e-24 * mean * mean
    factor = np.where(constant, 0.0, 1.0 / np.sqrt(np.where(constant, 1.0, variance)))
    return Scaler(mean, factor, n)


def standardise(points: DataFrame, vec_col: str, name: str = "scaled") -> tuple[DataFrame, Scaler]:
    """Every dimension at mean 0 and variance 1; points without a usable vector are left out."""
    points = points.filter(usable(F.col(vec_col)))
    scaler = fit_scaler(points, vec_col)
    return points.withColumn(name, scaler.apply(F.col(vec_col))), scaler


@dataclass(frozen=True)
class PcaFit:
    components: np.ndarray  # k x d, signs fixed
    ratio: np.ndarray

    @property
    def k(self) -> int:
        return len(self.ratio)

    def project(self, vector: Column, k: int | None = None, scaler: Scaler | None = None) -> Column:
        """Scores of centred vectors, or with ``scaler`` of raw ones."""
        axes = self.components[: k or self.k].T
        mean, factor = (np.zeros(len(axes)), np.ones(len(axes))) if scaler is None else (scaler.mean, scaler.factor)

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scores(rows: pa.Array) -> pa.Array:
            return from_matrix(((to_matrix(rows, len(axes)) - mean) * factor) @ axes, pa.float64())

        return scores(vector)


def signed(fit: PcaFit, points: DataFrame, id_col: str, vector: Column, scaler: Scaler | None = None) -> PcaFit:
    """Of each axis the score with the largest absolute value is positive (of equals, the one of the smallest id)."""
    signs = _signs(points.select(F.col(id_col).alias("id"), fit.project(vector, scaler=scaler).alias("s")), fit.k)
    return PcaFit(fit.components * signs[:, None], fit.ratio)


def fit_pca(points: DataFrame, id_col: str, vec_col: str, k: int) -> PcaFit:
    """Principal components about the mean of the vectors."""
    return signed(moments(points, vec_col).axes(k), points, id_col, F.col(vec_col).cast("array<double>"))


def _signs(scores: DataFrame, k: int) -> np.ndarray:
    """Sign of the largest score per component; one row per component and task is exchanged."""

    def largest(batches):
        best: list[tuple[float, int, float] | None] = [None] * k
        for batch in batches:
            s = to_matrix(batch.column("s"), k)
            if not len(s):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            size = np.abs(s)
            for c in range(k):
                rows = np.flatnonzero(size[:, c] == size[:, c].max())
                r = rows[np.argmin(ids[rows])]
                mine = (-size[r, c], int(ids[r]), s[r, c])
                if best[c] is None or mine[:2] < best[c][:2]:
                    best[c] = mine
        found = [(c, *b) for c, b in enumerate(best) if b is not None]
        if found:
            yield pa.RecordBatch.from_pydict({
                "component": pa.array([f[0] for f in found], pa.int32()),
                "size": pa.array([f[1] for f in found], pa.float64()),
                "id": pa.array([f[2] for f in found], pa.int64()),
                "score": pa.array([f[3] for f in found], pa.float64()),
            })

    keyed = scores.select(F.col("id").cast("bigint").alias("id"), "s")
    partial = keyed.mapInArrow(largest, "component int, size double, id bigint, score double")
    top = partial.groupBy("component").agg(F.min_by("score", F.struct("size", "id")).alias("score")).collect()
    signs = np.ones(k)
    for r in top:
        signs[r["component"]] = -1.0 if r["score"] < 0 else 1.0
    return signs


def model_table(spark: SparkSession, scaler: Scaler, fit: PcaFit) -> DataFrame:
    """(part, nth, value, ratio): mean, factor and axes as rows, to be stored beside the coordinates."""
    rows = [("mean", 0, scaler.mean.tolist(), float(scaler.n)), ("factor", 0, scaler.factor.tolist(), 0.0)]
    rows += [("axis", i, axis.tolist(), float(r)) for i, (axis, r) in enumerate(zip(fit.components, fit.ratio))]
    return spark.createDataFrame(rows, "part string, nth int, value array<double>, ratio double")


def read_model(table: DataFrame) -> tuple[Scaler, PcaFit]:
    """The model of :func:`model_table`; it has a row for each axis."""
    rows = sorted(table.collect(), key=lambda r: (r["part"], r["nth"]))
    axes = [r for r in rows if r["part"] == "axis"]
    mean, factor = (next(r for r in rows if r["part"] == p) for p in ("mean", "factor"))
    scaler = Scaler(np.array(mean["value"]), np.array(factor["value"]), int(mean["ratio"]))
    return scaler, PcaFit(np.array([r["value"] for r in axes]), np.array([r["ratio"] for r in axes]))


def variance_table(points: DataFrame, fit: PcaFit) -> DataFrame:
    """(component, explained_variance, cumulative_variance)."""
    rows = [(i + 1, float(v)) for i, v in enumerate(fit.ratio)]
    table = points.sparkSession.createDataFrame(rows, "component int, explained_variance double")
    return cumulative(table)


def cumulative(table: DataFrame) -> DataFrame:
    """Running sum over the components; a table of at most a few hundred rows."""
    so_far = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative_variance", F.sum("explained_variance").over(so_far))


def components_needed(variance: DataFrame, share: float = 0.95) -> DataFrame:
    """First component whose cumulative variance reaches the share; one past the last when none does."""
    reached = F.min(F.when(F.col("cumulative_variance") >= share, F.col("component")))
    return variance.agg(F.coalesce(reached, F.max("component") + 1).alias("n_components"))


def reduce_points(points: DataFrame, id_col: str, vec_col: str, k: int = 50) -> tuple[DataFrame, Scaler, PcaFit]:
    """(id, pos) of every point on the principal axes of the standardised vectors, and the model.

    The vectors are read for the moments, for the signs of the axes, and for the scores.
    """
    found = moments(points, vec_col)
    scaler = found.scaler()
    rows = points.select(id_col, F.col(vec_col).cast("array<double>").alias("_v")).filter(usable(F.col("_v")))
    fit = signed(found.scaled(scaler).axes(k), rows, id_col, F.col("_v"), scaler)
    return rows.select(id_col, fit.project(F.col("_v"), scaler=scaler).alias("pos")), scaler, fit


def pca_coordinates(points: DataFrame, id_col: str, vec_col: str, k: int = 50) -> tuple[DataFrame, PcaFit]:
    coords, _, fit = reduce_points(points, id_col, vec_col, k)
    return coords, fit


def long_form(points: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """One row per vector element, positions from 1."""
    return points.select(id_col, F.posexplode(vec_col).alias("_p", "value")).select(
        id_col, (F.col("_p") + 1).alias("pos"), "value"
    )


def xy(coords: DataFrame, id_col: str) -> DataFrame:
    return coords.select(id_col, F.get("pos", F.lit(0)).alias("x"), F.get("pos", F.lit(1)).alias("y"))
