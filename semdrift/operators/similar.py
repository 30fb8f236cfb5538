"""Cosine pairs, exact nearest neighbours and exact top-k search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.functions.arrow import distances, to_matrix
from semdrift.functions.vectors import cosine, usable
from semdrift.operators import descent, nearest
from semdrift.operators.skew import lookup_join
from semdrift.session import write_and_read

# Query vectors up to this size travel with the tasks.
MAX_SHIPPED_BYTES = 64 << 20


def cosine_of_pairs(pairs: DataFrame, a: str = "a", b: str = "b", name: str = "cosine") -> DataFrame:
    return pairs.withColumn(name, cosine(F.col(a), F.col(b)))


def _emit(ids_a: np.ndarray, ids_b: np.ndarray, d: np.ndarray, k: int) -> pa.Table:
    d = np.round(d, nearest.DECIMALS)
    r, c = nearest.smallest(d, ids_b, k)
    return pa.table({
        "id": pa.array(ids_a[r], pa.int64()),
        "neighbor": pa.array(ids_b[c], pa.int64()),
        "distance": pa.array(d[r, c], pa.float64()),
    })


NEIGHBORS = "id bigint, neighbor bigint, distance double"


def knn(points: DataFrame, id_col: str, vec_col: str, k: int = 15, group: int | None = None, exact: bool = True) -> DataFrame:
    """(id, neighbor, distance, rank): the k nearest other points.

    ``nearest.search`` finds them exactly: it meets the leaves around each group of points first and
    leaves out what the k-th distances so far rule out. Where vectors are of so many dimensions that little can be
    ruled out, ``exact=False`` takes ``descent.approximate``, whose work grows with the points and not with their
    square, and which misses a few. Of a crowd of
    equal points only the first k + 1 are searched; the others have the first
    k as their neighbours, at no distance. A point without a usable vector
    has no neighbours and is nobody's neighbour.
    """
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(usable(F.col("vec")))
    search = nearest.search if exact else descent.approximate
    firsts, others = split_crowds(rows, k)
    if others is None:
        return search(rows, k, group=group)
    beside = others.select("id", F.posexplode(F.slice("near", 1, k)).alias("at", "neighbor"))
    beside = beside.select("id", "neighbor", F.lit(0.0).alias("distance"), (F.col("at") + 1).alias("rank"))
    return search(firsts, k, group=group).unionByName(beside)


def split_crowds(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """(the first k + 1 rows (id, vec) of every vector, the others (id, near) with the ids of those); None without others."""
    copies = rows.groupBy(F.xxhash64("vec").alias("h")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1)
    if copies.isEmpty():
        return rows, None
    by_id = Window.partitionBy("vec").orderBy("id")  # ranks are limited before the shuffle
    firsts = write_and_read(rows.withColumn("nth", F.row_number().over(by_id)).filter(F.col("nth") <= k + 1), "knn-firsts")
    crowds = firsts.groupBy("vec").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("near")
    ).filter(F.col("n") == k + 1).select("vec", "near")
    rest = rows.join(firsts.select("id"), "id", "left_anti")
    return firsts.select("id", "vec"), lookup_join(rest, crowds, "vec", "id", "inner").select("id", "near")


def top_k_similar(corpus: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str,
                  vec_col: str = "embedding", max_shipped: int = MAX_SHIPPED_BYTES) -> DataFrame:
    """(query, id, cosine, rank): the k most similar corpus rows of every query, exactly.

    A query set whose checked size fits travels with the tasks and the corpus
    is read once without a shuffle; a larger one goes through the pivot tree of ``nearest.search``. Vectors are
    scaled to unit length, where a smaller distance is a larger cosine.
    """
    q = queries.select(F.col(query_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    c = corpus.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    head = q.select(F.size("vec").alias("d")).head()
    if head is None:
        return q.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("cosine"), F.lit(0).alias("rank"))
    limit = max(1, max_shipped // (8 * head["d"]))
    shipped = q.limit(limit + 1).toArrow()
    if shipped.num_rows <= limit:
        candidates = _search_shipped(c, shipped, k)
        best = nearest.ranked(candidates, k).withColumn("cosine", 1.0 - F.col("distance"))
    else:
        best = nearest.search(_on_sphere(c, 0), k, _on_sphere(q, 1)).withColumn("cosine", 1.0 - F.col("distance") * F.col("distance") / 2)
    return best.select(F.col("id").alias("query"), F.col("neighbor").alias("id"), "cosine", "rank")


def _on_sphere(rows: DataFrame, side: int) -> DataFrame:
    """Unit vectors; those of no length get a direction of their own, at a right angle to all of the other side."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.concat(F.transform("vec", lambda x: x / F.col("length")), F.array(F.lit(0.0), F.lit(0.0)))
    none = F.concat(F.transform("vec", lambda x: F.lit(0.0)), F.array(F.lit(1.0 - side), F.lit(float(side))))
    return rows.withColumn("length", length).select("id", F.when(F.col("length") > 0, unit).otherwise(none).alias("vec"))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def _search_shipped(corpus: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    names = queries.column("id").to_numpy()
    matrix = corpus.sparkSession.sparkContext.broadcast(_unit(to_matrix(queries.column("vec"))))

    def search(batches):
        """One pass over a partition; only the k best rows per query so far are held."""
        best = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = max(1, nearest.MAX_CELLS // len(names))
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                found = _emit(names, part.column("id").to_numpy(), 1.0 - matrix.value @ _unit(to_matrix(part.column("vec"))).T, k)
                best = found if best is None else _merge(best, found, k)
        if best is not None:
            yield from best.to_batches()

    return corpus.mapInArrow(search, NEIGHBORS)


def _merge(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    both = pa.concat_tables([a, b]).sort_by([("id", "ascending"), ("distance", "ascending"), ("neighbor", "ascending")])
    ids = both.column("id").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    position = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    return both.filter(pa.array(position < k))
