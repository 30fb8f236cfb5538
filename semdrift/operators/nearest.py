"""Exact nearest neighbours through a two-level pivot tree.

At most ``CELLS`` pivots cut the space into cells, and each cell is cut into leaves
around pivots of its own, as many as its rows ask for. The tree (pivots,
radii, counts; at most about ``CELLS * LEAVES`` leaves) is all that the driver holds and
tasks share. Rows lie in blocks: a leaf, or a part of one that is crowded.

Queries are dealt to groups by their leaves. Each group asks for the nearest blocks first, a
few in the first round and ``GROWTH`` times as many in each next one. Between rounds the
k-th distances so far tighten its reach, and by the triangle inequality a leaf
that lies beyond the reach of all its queries is never asked for. A block is
shipped once for each group that asks for it, and the k best of up to ``PART_BLOCKS`` blocks
leave a task as one list. Group and block sizes grow with the square root of the
rows, so that even where nothing can be skipped rows are shipped about n^1.5 times, not n^2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.functions.arrow import distances, to_matrix
from semdrift.functions.vectors import usable
from semdrift.session import write_and_read

CELLS, LEAVES = 128, 128
SAMPLE_ROWS = 4096
LEAST_GROUP, MOST_GROUP = 256, 1 << 16
PART_BLOCKS = 16
FIRST, GROWTH = 16, 4
MAX_CELLS, HEAD = 1 << 22, 1024  # distances held at a time, columns that a first limit is taken from
# Distances equal to this many decimals are ties; the smaller id comes first.
DECIMALS = 9
SLACK = 1e-6
#: By what part of the squared lengths a product in single precision may miss a squared distance (some 1e-6), and pairs worked out at a time.
ROUGH, DIRECT = 1e-5, 1 << 14


def group_rows(n: int) -> int:
    """Queries of a group: 16 times the square root of the rows, within bounds."""
    return int(min(MOST_GROUP, max(LEAST_GROUP, 16 * n ** 0.5)))


def _middles(sample: np.ndarray, n: int, steps: int = 8) -> np.ndarray:
    """n pivots in the middle of what lies around them: a few k-means steps over a sample."""
    pivots = np.unique(sample[:n], axis=0)
    for _ in range(steps):
        label = distances(sample, pivots).argmin(axis=1)
        counts = np.bincount(label, minlength=len(pivots))
        hits = np.zeros((len(sample), len(pivots)))
        hits[np.arange(len(sample)), label] = 1.0
        pivots = np.where(counts[:, None] > 0, hits.T @ sample / np.maximum(counts, 1)[:, None], pivots)
    return pivots


# ------------------------------------------------------------------------------ tree


@dataclass(frozen=True)
class Tree:
    cells: np.ndarray  # pivots of the first level
    first: np.ndarray  # first leaf of each cell, and the number of leaves at the end
    pivots: np.ndarray  # pivot of each leaf

    def locate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance from its pivot): the nearest leaf of the nearest cell."""
        leaf, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        if not len(x):
            return leaf, dist
        cell = distances(x, self.cells).argmin(axis=1)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            d = distances(x[at], self.pivots[self.first[c]:self.first[c + 1]])
            best = d.argmin(axis=1)
            leaf[at], dist[at] = self.first[c] + best, d[np.arange(len(at)), best]
        return leaf, dist


def grow(rows: DataFrame, n: int, leaf_rows: int, seed: int = 0) -> Tree:
    """The tree of ``rows`` (id, vec); pivots come from rows drawn by the hash of their id and the seed."""
    wanted = -(-n // leaf_rows)
    sample = to_matrix(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select("vec").toArrow().column("vec"))
    cells = _middles(sample, max(1, min(CELLS, round(wanted ** 0.5))))
    flat = Tree(cells, np.arange(len(cells) + 1), cells)
    located = rows.select("id", "vec", _located(rows, flat)("vec")["leaf"].alias("cell"))
    counts = np.zeros(len(cells), np.int64)
    for r in located.groupBy("cell").count().collect():  # one row per cell
        counts[r["cell"]] = r["count"]
    # A crowded cell has more leaves than others, up to as many as it may have of all.
    share = np.minimum(-(-counts // leaf_rows), CELLS * LEAVES // len(cells) + counts * (CELLS * LEAVES) // max(1, n))
    limit = F.create_map(*[F.lit(int(v)) for c, s in enumerate(share) for v in (c, s)])
    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id")  # cut before the shuffle
    drawn = located.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= int(share.max(initial=1)))
    drawn = drawn.filter(F.col("nth") <= limit[F.col("cell").cast("int")]).select("cell", "nth", "vec").toArrow()
    order = np.lexsort((drawn.column("nth").to_numpy(), drawn.column("cell").to_numpy()))
    vec, cell = to_matrix(drawn.column("vec"))[order], drawn.column("cell").to_numpy()[order]
    # Cells without rows keep their pivot as their only leaf, so that queries may fall there.
    pivots = [np.unique(vec[cell == c], axis=0) if (cell == c).any() else cells[c:c + 1] for c in range(len(cells))]
    return Tree(cells, np.concatenate([[0], np.cumsum([len(p) for p in pivots])]), np.concatenate(pivots))


def _located(rows: DataFrame, tree: Tree):
    shipped = rows.sparkSession.sparkContext.broadcast(tree)

    @F.arrow_udf("struct<leaf: bigint, dist: double>")
    def located(vectors: pa.Array) -> pa.Array:
        leaf, dist = shipped.value.locate(to_matrix(vectors, shipped.value.cells.shape[1]))
        return pa.StructArray.from_arrays([pa.array(leaf, pa.int64()), pa.array(dist, pa.float64())], names=["leaf", "dist"])

    return located


@dataclass(frozen=True)
class Dealt:
    """Rows (part, leaf, dist, id, vec) in numbered parts of bounded size, none of more than one cell."""

    rows: DataFrame
    counts: np.ndarray  # rows of each leaf
    radius: np.ndarray  # farthest row of each leaf
    first: np.ndarray  # first part of each leaf
    parts: np.ndarray  # parts of each leaf


@dataclass(frozen=True)
class Placed:
    """Rows (leaf, dist, id, vec), written, with the number and the farthest row of each leaf."""

    rows: DataFrame
    tree: Tree
    counts: np.ndarray
    radius: np.ndarray


def place(rows: DataFrame, tree: Tree) -> Placed:
    where = _located(rows, tree)("vec")
    placed = write_and_read(rows.withColumn("at", where).select("at.leaf", "at.dist", "id", "vec"), "nearest-leaves")
    counts, radius = np.zeros(len(tree.pivots), np.int64), np.zeros(len(tree.pivots))
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect():  # one row per leaf
        counts[r["leaf"]], radius[r["leaf"]] = r["n"], r["r"]
    return Placed(placed, tree, counts, radius)


def deal(found: Placed, size: int, share: bool) -> Dealt:
    """Rows by leaf; crowded leaves are split by the hash of the id, and with ``share`` small leaves of a cell lie together."""
    placed, tree, counts, radius = found.rows, found.tree, found.counts, found.radius
    n_leaves = len(tree.pivots)
    first, parts = np.zeros(n_leaves, np.int64), -(-counts // size)
    number, room = -1, 0
    opens = set(tree.first.tolist())
    for leaf in range(n_leaves):
        if not counts[leaf]:
            continue
        if not share or leaf in opens or parts[leaf] > 1 or room < counts[leaf]:
            first[leaf] = number + 1
            number += int(parts[leaf])
            room = size - int(counts[leaf]) if parts[leaf] == 1 else 0
        else:
            first[leaf] = number
            room -= int(counts[leaf])
    table = placed.sparkSession.createDataFrame(
        [(i, int(first[i]), int(parts[i])) for i in np.flatnonzero(counts).tolist()], "leaf bigint, first bigint, parts bigint"
    )  # one row per leaf, of which there are at most about CELLS * LEAVES
    numbered = placed.join(F.broadcast(table), "leaf").withColumn(
        "part", F.col("first") + F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts"))
    )
    return Dealt(numbered.select("part", "leaf", "dist", "id", "vec"), counts, radius, first, parts)


# ---------------------------------------------------------------------------- search


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k smallest entries of each row, ties by the smaller id."""
    order = np.argsort(ids, kind="stable")
    width = d.shape[1]
    if width > 4 * k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero(d <= kth)
        rank = np.empty(width, dtype=np.int64)
        rank[order] = np.arange(width)
        by = np.lexsort((rank[c], d[r, c], r))
        r, c = r[by], c[by]
        first = np.searchsorted(r, np.arange(d.shape[0]))
        keep = np.arange(len(r)) - first[r] < k
        return r[keep], c[keep]
    picked = order[np.argsort(d[:, order], axis=1, kind="stable")[:, :k]]
    rows = np.repeat(np.arange(d.shape[0]), picked.shape[1])
    return rows, picked.ravel()


def _moved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both about the mean of ``b``; factors whose product are the squared distances, roughly; what each row of ``a`` may miss by."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    long_a, long_b = (a * a).sum(1), (b * b).sum(1)
    most = max(long_a.max(initial=0.0), long_b.max(initial=0.0))
    kind = np.float32 if 1e-25 < most < 1e30 else np.float64
    left = np.column_stack([-2.0 * a, long_a, np.ones(len(a))]).astype(kind)
    right = np.column_stack([b, np.ones(len(b)), long_b]).astype(kind).T
    return a, b, left, right, ROUGH * (long_a + long_b.max(initial=0.0))


def _closest(a: np.ndarray, b: np.ndarray, rough: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray | None, ids: np.ndarray, k: int,
             limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and rounded distances of the k nearest of ``b`` (``ids``) to each row of ``a`` within its ``limit``, ties by the smaller id; not the id ``own``.

    A rough product tells which pairs can be within the limit; only their distances are worked out, rounded
    and sorted. A row without a limit takes the k-th of its first columns.
    """
    left, right, slack = rough
    bound, open_rows = limit + 10.0 ** -DECIMALS, np.flatnonzero(np.isinf(limit))
    first = max(HEAD, 32 * k)
    if len(open_rows) and len(b) > k:
        head = distances(a[open_rows], b[:first])
        if own is not None:
            head[own[open_rows, None] == ids[None, :first]] = np.inf
        bound[open_rows] = np.partition(head, k - 1, axis=1)[:, k - 1] + 10.0 ** -DECIMALS
    r, c = np.nonzero(left @ right <= (bound * bound + slack).astype(left.dtype)[:, None])
    found = np.empty(len(r))
    for at in range(0, len(r), DIRECT):
        i, j = r[at:at + DIRECT], c[at:at + DIRECT]
        apart = a[i] - b[j]
        found[at:at + DIRECT] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
    found = np.round(found, DECIMALS)
    keep = np.isfinite(found) & (found <= limit[r])
    if own is not None:
        keep &= own[r] != ids[c]
    r, c, found = r[keep], c[keep], found[keep]
    order = np.lexsort((ids[c], found, r))
    r, c, found = r[order], c[order], found[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], found[keep]


ASKED = "grp bigint, block bigint, nth bigint, pos bigint"
FOUND = "grp bigint, leaf bigint, id bigint, neighbor bigint, distance double"


def _plan(tree, corpus: tuple[np.ndarray, np.ndarray, np.ndarray], width: int):
    """For each group (its leaves with their reach) the next leaves that could hold a neighbour, nearest pivots first."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, first, parts = corpus
        pivots = tree.value.pivots
        there = np.flatnonzero(parts > 0)
        for batch in batches:
            for grp, done, asks in zip(*(batch.column(c).to_pylist() for c in ("grp", "done", "asks"))):
                leaf = np.array([a["leaf"] for a in asks])
                apart = distances(pivots[leaf], pivots[there])
                gap = apart - np.array([a["radius"] for a in asks])[:, None] - radius[there][None, :]
                near = (gap <= np.array([a["reach"] for a in asks])[:, None] + SLACK).any(axis=0)
                order = np.lexsort((there, apart.min(axis=0)))
                places = np.flatnonzero(near[order] & (np.arange(len(order)) >= done))
                blocks, pos, n = [], [], 0
                for place in places.tolist():
                    b = there[order[place]]
                    blocks.append(np.arange(first[b], first[b] + parts[b]))
                    pos.append(np.full(parts[b], place))
                    n += int(parts[b])
                    if n >= width:
                        break
                if n:
                    yield pa.RecordBatch.from_pydict({
                        "grp": pa.array(np.full(n, grp), pa.int64()), "block": pa.array(np.concatenate(blocks), pa.int64()),
                        "nth": pa.array(np.arange(n), pa.int64()), "pos": pa.array(np.concatenate(pos), pa.int64()),
                    })

    return plan


def _meet(k: int, itself: bool):
    """The k nearest of the shipped rows for each query, no farther than its k-th so far."""

    def meet(asking: pa.Table, shipped: pa.Table) -> pa.Table:
        schema = pa.schema([("grp", pa.int64()), ("leaf", pa.int64()), ("id", pa.int64()), ("neighbor", pa.int64()), ("distance", pa.float64())])
        if not asking.num_rows or not shipped.num_rows:
            return schema.empty_table()
        ids, others = asking.column("id").to_numpy(), shipped.column("id").to_numpy()
        x, y = to_matrix(asking.column("vec")), to_matrix(shipped.column("vec"))
        kth = pa.compute.fill_null(asking.column("kth"), np.inf).to_numpy()
        x, y, left, right, slack = _moved(x, y)
        rows = max(1, MAX_CELLS // len(others))
        out = []
        for low in range(0, len(ids), rows):
            at = slice(low, low + rows)
            r, c, found = _closest(x[at], y, (left[at], right, slack[at]), ids[at] if itself else None, others, k, kth[at])
            out.append((low + r, c, found))
        r, c, d = (np.concatenate(p) for p in zip(*out))
        return pa.table({
            "grp": asking.column("grp").take(pa.array(r)), "leaf": asking.column("leaf").take(pa.array(r)),
            "id": pa.array(ids[r], pa.int64()), "neighbor": pa.array(others[c], pa.int64()), "distance": pa.array(d, pa.float64()),
        }, schema=schema)

    return meet


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id; ranks are limited before the shuffle as well."""
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(corpus: DataFrame, k: int, queries: DataFrame | None = None, group: int | None = None) -> DataFrame:
    """(id, neighbor, distance, rank): the k rows of ``corpus`` nearest to every query, exactly.

    Both have (id, vec) with ids of their own. Without ``queries`` every row asks for its k nearest
    others. Rows without a usable vector take no part. Distances are rounded
    to ``DECIMALS``; ties go to the smaller id.
    """
    itself = queries is None
    corpus = corpus.select("id", "vec").filter(usable(F.col("vec")))
    n = corpus.count()
    size = group or group_rows(n)
    leaf_rows = max(1, size // 4)
    empty = corpus.select("id", F.col("id").alias("neighbor"), F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).limit(0)
    if not n:
        return empty
    tree = grow(corpus, n, leaf_rows)
    placed = place(corpus, tree)
    blocks = deal(placed, leaf_rows, False)
    held = write_and_read(blocks.rows.select(F.col("part").alias("block"), "id", "vec"), "nearest-blocks")
    asking = placed if itself else place(queries.select("id", "vec").filter(usable(F.col("vec"))), tree)
    groups = write_and_read(deal(asking, size, True).rows.withColumnRenamed("part", "grp"), "nearest-groups")
    spark = corpus.sparkSession
    shipped = spark.sparkContext.broadcast(tree)
    best, done, width = None, None, FIRST
    while True:
        if best is None:
            now = groups.withColumn("kth", F.lit(None).cast("double"))
        else:
            kth = best.groupBy("grp", "id").agg(F.max(F.when(F.col("rank") == k, F.col("distance"))).alias("kth"))
            now = groups.join(kth, ["grp", "id"], "left")
        reach = F.max(F.coalesce("kth", F.lit(float("inf"))))
        asks = now.groupBy("grp", "leaf").agg(F.max("dist").alias("radius"), reach.alias("reach"))
        asks = asks.groupBy("grp").agg(F.collect_list(F.struct("leaf", "radius", "reach")).alias("asks"))
        asks = asks.withColumn("done", F.lit(0).cast("bigint")) if done is None else asks.join(done, "grp")
        plan = _plan(shipped, (blocks.radius, blocks.first, blocks.parts), width)
        asked = write_and_read(asks.select("grp", "done", "asks").mapInArrow(plan, ASKED), "nearest-asked")
        done = asked.groupBy("grp").agg((F.max("pos") + 1).alias("done"))
        if asked.isEmpty():
            break
        asked = asked.withColumn("piece", F.floor(F.col("nth") / PART_BLOCKS).cast("bigint"))
        wanted = now.join(asked.groupBy("grp").agg(F.collect_set("piece").alias("pieces")), "grp")
        wanted = wanted.select("grp", "leaf", "id", "vec", "kth", F.explode("pieces").alias("piece"))
        copies = held.join(asked.select("grp", "piece", "block"), "block").select("grp", "piece", "id", "vec")
        met = _meet(k, itself)
        found = wanted.groupBy("grp", "piece").cogroup(copies.groupBy("grp", "piece")).applyInArrow(lambda a, b: met(a, b), FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = write_and_read(ranked(found, k), "nearest-best")
        width *= GROWTH
    return empty if best is None else best.select("id", "neighbor", "distance", "rank")
