"""Exact inner-product top-k through a pivot-distance index.

Vectors are rounded down to whole numbers. One more component, sqrt(M^2 - |v|^2)
for a vector and 0 for a query (M is the greatest length), makes the largest inner product
the smallest distance:

    distance(query, vector)^2 = |query|^2 + M^2 - 2 * (inner product)

Index: every vector is keyed by its nearest pivot and its distance from it, and
the sorted keys are cut into blocks of at most ``BLOCK_ROWS`` rows (or
1 / ``MAX_BLOCKS`` of all rows, where that is more). A block is a stretch of
the annuli around one pivot; the list of blocks, at most ``MAX_BLOCKS`` and one for each pivot, is all that the driver holds.
A crowd of equal vectors fills several blocks of no width.

Search: by the triangle inequality no vector of a block is nearer to a query
than the query's distance from the annulus, and none of a pivot's cell is
nearer than half of what that pivot is farther away than the query's own. Each query orders the blocks by the
score they could hold and expands them best first, a few in the first round and
``GROWTH`` times as many in each next one, until no block left can reach its
k-th score. A round is one cogroup of blocks with the queries that want them;
blocks that many want are repeated for every ``QUERY_ROWS`` queries. Scores are
whole numbers and bounds are widened by more than their rounding error, so the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.llm.common import batch
from semdrift.operators.skew import number_rows
from semdrift.session import write_and_read

SCALE = 1024
BLOCK_ROWS, MAX_BLOCKS, MAX_PIVOTS = 1024, 65_536, 256
SAMPLE_ROWS = 8192  # pivots are chosen among these
QUERY_ROWS = 4096
FIRST, GROWTH = 2, 8
SLACK = 1e-6  # of the lengths at hand, taken off every least distance

_NO_ID = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min


# --------------------------------------------------------------------------- whole-number vectors

VECTORS = pa.schema([
    ("row", pa.int64()), ("vec_id", pa.int64()), ("query", pa.bool_()), ("v", pa.binary()), ("width", pa.int64()),
    ("largest", pa.float64()), ("squares", pa.float64()),
])
VECTOR_COLUMNS = "row long, vec_id long, query boolean, v binary, width long, largest double, squares double"


def _whole(scale: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            lengths = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            ends = np.cumsum(lengths)
            packed, largest, squares = [], [], []
            for at, end in zip(ends - lengths, ends):
                own = values[at:end]
                largest.append(float(np.abs(own).max(initial=0.0)))
                squares.append(float(own @ own))
                # A component that no long holds is reported by top_k, which sees the largest first.
                packed.append(np.clip(own, -2.0**62, 2.0**62).astype("<i8").tobytes())
            yield batch(
                VECTORS, row=b.column(0), vec_id=b.column(1), query=b.column(2), v=packed, width=lengths, largest=largest,
                squares=squares,
            )

    return rows


def whole_vectors(vectors: DataFrame, is_query: Column, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, query, v, width, largest, squares): every usable vector, each component x as floor(scale * x)."""
    x = F.col("embedding")
    usable = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    chosen = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector).cast("array<double>").alias("embedding"),
    )
    return write_and_read(chosen.filter(usable).mapInArrow(_whole(scale), VECTOR_COLUMNS), "pivot-vectors")


def _matrix(packed: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled with zeros."""
    rows = packed.to_pylist()
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r) // 8] = np.frombuffer(r, "<i8")
    return out


# --------------------------------------------------------------------------- index


@dataclass(frozen=True)
class Index:
    """What every task knows: the pivots and the stretch of distances of each block."""

    width: int
    longest: float  # M
    pivots: np.ndarray  # with the added component
    block: np.ndarray
    pivot: np.ndarray  # of each block
    low: np.ndarray
    high: np.ndarray


def _lifted(v: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that brings all of them to the length ``longest``."""
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(longest * longest - (v * v).sum(1), 0.0))])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest first: each next pivot is the sampled vector farthest from those before; no two are equal."""
    picked = [0]
    nearest = _apart(sample, sample[:1])[:, 0]
    while len(picked) < n and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _apart(sample, sample[picked[-1]:picked[-1] + 1])[:, 0])
        nearest[picked] = 0
    return sample[picked]


PLACED = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.binary()), ("pivot", pa.int64()), ("dist", pa.float64())])


def build_index(vectors: DataFrame, rows: int, width: int, longest: float) -> tuple[DataFrame, Index]:
    """(the vectors with the block of each, the list of blocks)."""
    spark = vectors.sparkSession
    block_rows = max(BLOCK_ROWS, -(-rows // MAX_BLOCKS))
    sample = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("v").toArrow()
    n_pivots = int(min(MAX_PIVOTS, max(1, round((rows / block_rows) ** 0.5))))
    pivots = choose_pivots(_lifted(_matrix(sample["v"], width), longest), n_pivots)
    shipped = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = _apart(_lifted(_matrix(b.column(2), width), longest), shipped.value)
            nearest = apart.argmin(axis=1)
            yield batch(PLACED, row=b.column(0), vec_id=b.column(1), v=b.column(2), pivot=nearest, dist=apart[np.arange(len(b)), nearest])

    placed = vectors.select("row", "vec_id", "v").mapInArrow(place, "row long, vec_id long, v binary, pivot long, dist double")
    keyed = number_rows(placed, [F.col("pivot"), F.col("dist"), F.col("row")], "place")
    # A run of places is cut where the pivot changes, so a block lies around one pivot.
    piece = F.floor((F.col("place") - 1) / F.lit(block_rows)).cast("long")
    keyed = keyed.withColumn("block", F.col("pivot") * F.lit(1 << 40) + piece).select("block", "pivot", "dist", "row", "vec_id", "v")
    blocks = write_and_read(keyed, "pivot-blocks")
    listed = blocks.groupBy("block", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("block").toArrow()
    columns = {c: listed[c].to_numpy() for c in ("block", "pivot", "low", "high")}
    return blocks.select("block", "row", "vec_id", "v"), Index(width, longest, pivots, **columns)


def reach(index: Index, queries: np.ndarray) -> np.ndarray:
    """For each query and block, a number that no score of that pair is above."""
    q = queries.astype(np.float64)
    lengths = np.sqrt((q * q).sum(1))
    apart = _apart(np.column_stack([q, np.zeros(len(q))]), index.pivots)
    own = apart.min(axis=1, keepdims=True)
    d = apart[:, index.pivot]
    least = np.maximum(np.maximum(d - index.high[None, :], index.low[None, :] - d), (d - own) / 2)
    least = np.maximum(least - SLACK * (lengths[:, None] + index.longest), 0.0)
    best = (lengths * lengths)[:, None] + index.longest * index.longest
    return (best - least * least) / 2 + SLACK * best + 1


# --------------------------------------------------------------------------- search

WANTED = pa.schema([("block", pa.int64()), ("q", pa.int64()), ("qv", pa.binary()), ("least", pa.int64())])
FOUND = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64()), ("row", pa.int64())])
FOUND_COLUMNS = "q long, score long, vec_id long, row long"
#: Queries whose bounds are worked out at a time.
BOUND_ROWS = 256


def _best_first(index, done: int, more: int):
    """Per query the blocks at places ``done`` to ``done + more`` of its own order that could still matter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Index = index.value
        for whole in batches:
            for at in range(0, len(whole), BOUND_ROWS):
                b = whole.slice(at, BOUND_ROWS)
                bound = reach(known, _matrix(b.column(1), known.width))
                order = np.argsort(-bound, axis=1, kind="stable")[:, done:done + more]
                least = pa.compute.fill_null(b.column(2), _NONE).to_numpy(zero_copy_only=False)
                r, c = np.nonzero(np.take_along_axis(bound, order, axis=1) >= least[:, None])
                at_rows = pa.array(r)
                yield batch(
                    WANTED, block=known.block[order[r, c]], q=b.column(0).take(at_rows), qv=b.column(1).take(at_rows),
                    least=b.column(2).take(at_rows),
                )

    return rows


def _scores(q: np.ndarray, v: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as whole numbers; through floating point where every sum has an exact double."""
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if small else q @ v.T


def _expand(width: int, k: int, small: bool):
    """The k best of one block for each query that wants it, as far as they reach the query's k-th score so far."""

    def group(members: pa.Table, wanted: pa.Table) -> pa.Table:
        if not members.num_rows or not wanted.num_rows:
            return FOUND.empty_table()
        rows, q = members["row"].to_numpy(), wanted["q"].to_numpy()
        ids = pa.compute.fill_null(members["vec_id"], _NO_ID).to_numpy()
        score = _scores(_matrix(wanted["qv"], width), _matrix(members["v"], width), small)
        by_row = np.argsort(rows)
        own = by_row[np.minimum(np.searchsorted(rows, q, sorter=by_row), len(rows) - 1)]
        mine = np.flatnonzero(rows[own] == q)
        others = np.ones(score.shape, bool)
        others[mine, own[mine]] = False
        least = pa.compute.fill_null(wanted["least"], _NONE).to_numpy()[:, None]
        if len(rows) > k + 1:
            # One more than k: the query's own row may be among them.
            least = np.maximum(least, np.partition(score, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1:len(rows) - k])
        r, c = np.nonzero((score >= least) & others)
        s = score[r, c]
        order = np.lexsort((rows[c], ids[c], -s, r))
        r, c, s = r[order], c[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, s = r[keep], c[keep], s[keep]
        return pa.table({
            "q": pa.array(q[r], pa.int64()), "score": pa.array(s, pa.int64()),
            "vec_id": pa.array(ids[c], pa.int64(), mask=ids[c] == _NO_ID), "row": pa.array(rows[c], pa.int64()),
        }, schema=FOUND)

    return group


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` marks the k other rows of highest inner product.

    Components count as floor(scale * x). Ties go to the smaller ``vec_id``,
    rows without id last. A row never finds itself; rows that repeat find each
    other, and each repeated query row has its own result. Vectors that are null or hold a
    null or non-finite component take no part. A vector shorter than others
    counts as filled with zeros. Scores that could pass the range of a
    long are an error. Other columns are not read.
    """
    spark = vectors.sparkSession
    data = whole_vectors(vectors, is_query, scale, vec_id, vector)
    seen = data.agg(
        F.count(F.lit(1)).alias("rows"), F.max("width").alias("width"), F.max("largest").alias("largest"), F.max("squares").alias("squares")
    ).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not seen["rows"]:
        return empty
    width, biggest = seen["width"], seen["width"] * seen["largest"] ** 2
    if biggest >= 2.0**63:
        raise ValueError(f"inner products up to {biggest:.3g} do not fit in a long")
    small = biggest < 2.0**53
    blocks, index = build_index(data, seen["rows"], width, seen["squares"] ** 0.5)
    shipped = spark.sparkContext.broadcast(index)
    queries = data.filter("query").select(F.col("row").alias("q"), F.col("v").alias("qv"), F.col("vec_id").alias("query_id"))
    best, done, more = None, 0, FIRST
    while done < len(index.block):
        if best is None:
            asked = queries.select("q", "qv", F.lit(None).cast("long").alias("least"))
        else:
            full = best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
            asked = queries.join(full, "q", "left").select("q", "qv", "least")
        wanted = asked.mapInArrow(_best_first(shipped, done, more), "block long, q long, qv binary, least long")
        wanted = write_and_read(wanted, "pivot-wanted")
        # One row for each block, of which there are at most MAX_BLOCKS + MAX_PIVOTS.
        parts = wanted.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("parts"))
        parts = F.broadcast(write_and_read(parts, "pivot-parts"))
        split = wanted.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).drop("parts")
        repeated = blocks.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        expand = _expand(width, k, small)
        found = repeated.groupBy("block", "part").cogroup(split.groupBy("block", "part")).applyInArrow(
            lambda members, asking: expand(members, asking), FOUND_COLUMNS
        )
        if best is not None:
            found = found.unionByName(best.select("q", "score", "vec_id", "row"))
        best = write_and_read(_ranked(found, k), "pivot-best")
        done, more = done + more, more * GROWTH
    return best.join(queries.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
