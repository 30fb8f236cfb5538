"""Two-dimensional layouts from a weighted neighbour graph, as iterated DataFrame jobs.

Pull along the edges is computed edge by edge. Push between all points goes
through a quad tree of cell counts and centres, so an epoch costs the edges
and a few hundred cells for each point, never pairs of points. Points and edges are dealt to parts
once; an epoch shuffles only the places of points at both ends of an edge
between two parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from semdrift.config import AnalysisSettings
from semdrift.functions.arrow import from_matrix, to_matrix
from semdrift.functions.vectors import usable
from semdrift.operators import mesh, nearest, quadtree
from semdrift.operators import reduce as R
from semdrift.operators.similar import knn, split_crowds
from semdrift.operators.skew import lookup_join, number_rows
from semdrift.session import cut, settings, write_and_read


def _bisect(value, target: float, n: int, rounds: int = 64) -> np.ndarray:
    """Scale per row at which the increasing function ``value(scale)`` meets ``target``."""
    low, high, scale = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(rounds):
        above = value(scale) > target
        high = np.where(above, scale, high)
        low = np.where(above, low, scale)
        scale = np.where(np.isinf(high), scale * 2.0, (low + high) / 2.0)
    return scale


def fuzzy_membership(d: np.ndarray) -> np.ndarray:
    """exp(-max(0, d - nearest) / scale), with row sums equal to log2 of the neighbour count."""
    positive = np.where(d > 0, d, np.inf).min(axis=1)
    nearest = np.where(np.isinf(positive), 0.0, positive)[:, None]
    beyond = np.maximum(d - nearest, 0.0)
    scale = _bisect(lambda s: np.exp(-beyond / s[:, None]).sum(axis=1), np.log2(d.shape[1]), len(d))
    floor = 1e-3 * np.maximum(d.mean(axis=1), 1e-12)
    return np.exp(-beyond / np.maximum(scale, floor)[:, None])


def perplexity_affinity(d: np.ndarray, perplexity: float) -> np.ndarray:
    """Row-stochastic Gaussian affinities whose entropy is the logarithm of the perplexity."""
    squared = d * d
    squared = squared - squared.min(axis=1, keepdims=True)

    def affinity(width):
        p = np.exp(-squared / np.maximum(width, 1e-300)[:, None])
        return p / p.sum(axis=1, keepdims=True)

    def entropy(width):
        p = affinity(width)
        return -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)

    goal = np.log(min(perplexity, d.shape[1] * 0.999))
    return affinity(_bisect(entropy, goal, len(d)))


def neighbor_weights(neighbors: DataFrame, method: str, perplexity: float = 30.0) -> DataFrame:
    """Directed weights (id, neighbor, weight); each row of a point's k distances is solved on its own."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def weigh(rows: pa.Array) -> pa.Array:
        d = to_matrix(rows)
        if not len(d):
            return pa.array([], pa.list_(pa.float64()))
        w = fuzzy_membership(d) if method == "umap" else perplexity_affinity(d, perplexity)
        return from_matrix(w, pa.float64())

    lists = neighbors.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "distance"))).alias("n"))
    weighed = lists.select("id", F.col("n.neighbor").alias("neighbor"), weigh(F.col("n.distance")).alias("w"))
    return weighed.select("id", F.explode(F.arrays_zip("neighbor", "w")).alias("e")).select(
        "id", F.col("e.neighbor").alias("neighbor"), F.col("e.w").alias("weight")
    )


def symmetrise(weights: DataFrame, method: str) -> DataFrame:
    """(u, v, w) in both directions: a+b-ab for memberships, (p+q)/2n for affinities."""
    forth = weights.select(F.col("id").alias("u"), F.col("neighbor").alias("v"), F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    back = weights.select(F.col("neighbor").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("a"), F.col("weight").alias("b"))
    both = forth.unionByName(back).groupBy("u", "v").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    if method == "umap":
        return both.select("u", "v", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w"))
    n = weights.agg(F.count_distinct("id")).head()[0]
    return both.select("u", "v", ((F.col("a") + F.col("b")) / (2.0 * n)).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """Parameters of 1/(1+a·d^2b) closest to the membership that decays beyond ``min_dist``."""
    x = np.linspace(0, 3 * spread, 300)
    goal = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    best, width = (1.5, 0.9), (1.4, 0.6)
    for _ in range(12):
        grid = [
            (a, b)
            for a in np.linspace(max(0.05, best[0] - width[0]), best[0] + width[0], 15)
            for b in np.linspace(max(0.05, best[1] - width[1]), best[1] + width[1], 15)
        ]
        best = min(grid, key=lambda p: float(((1 / (1 + p[0] * x ** (2 * p[1])) - goal) ** 2).sum()))
        width = (width[0] / 2, width[1] / 2)
    return best


# -------------------------------------------------------------------------- parts

SIDES = 4096.0  # finest cells on the longer side of a layout
CUT_EPOCHS = 20
CELL_PARTS = 64  # beyond so many parts their cell counts are merged by tasks first

#: What one part sends in an epoch: its own state, the places of its points for others, its cell counts.
SENT = "part int, source int, kind int, payload binary"
STATE, PLACES, CELLS = 0, 1, 2


def _rows(part: list[int], source: list[int], kind: list[int], payload: list[bytes]) -> pa.Table:
    return pa.table({
        "part": pa.array(part, pa.int32()), "source": pa.array(source, pa.int32()),
        "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary()),
    })


@dataclass(frozen=True)
class Parts:
    """A graph dealt to parts once: what stays the same in all epochs, and the first places."""

    fixed: DataFrame  # part, payload: edges by number of the point, where each foreign point comes from, who asks for own points
    start: DataFrame  # SENT rows of the states
    names: DataFrame  # part, nth, id
    n_parts: int
    total: float


def _numbers(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n parts, such that hash partitioning by it deals one part to each of n partitions."""
    found: dict[int, int] = {}
    tried = 32 * n
    while len(found) < n:
        home = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("home")
        found = dict(spark.range(tried).groupBy(home).agg(F.min("id")).collect())  # a row per part
        tried *= 2
    return [found[home] for home in range(n)]


def _dealt(points: DataFrame, start: DataFrame, edges: DataFrame, weights: DataFrame | None) -> Parts:
    """Deal ``points`` (id, vec) to parts of neighbouring points, with ``start`` (id, x, y) and ``edges`` (u, v, w).

    A part's edges are those that leave its points. It lists the foreign
    points at their other ends by part, and learns which of its own points
    other parts list. All of this is exchanged once; in an epoch only
    places of listed points travel. A partition holds one part: an epoch
    lasts as long as its fullest partition.
    """
    spark = points.sparkSession
    points = points.select("id", "vec").filter(usable(F.col("vec")))
    n = points.count()
    size = nearest.group_rows(n)
    dealt = nearest.deal(nearest.place(points, nearest.grow(points, n, max(1, size // 4))), size, True)
    n_parts = int((dealt.first + dealt.parts).max())
    number = spark.createDataFrame(list(enumerate(_numbers(spark, n_parts))), "part bigint, number bigint")  # a row per part
    dealt = dealt.rows.join(F.broadcast(number), "part").select(F.col("number").alias("part"), "id")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    places = start if weights is None else start.join(weights, "id", "left")
    mass = F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))
    numbered = write_and_read(
        dealt.select(F.col("part").cast("int").alias("part"), "id").join(places.select("id", "x", "y", mass.alias("weight")), "id")
        .withColumn("nth", nth), "layout-points",
    )
    names = numbered.select("part", "nth", "id")
    ends = edges.join(names.select(F.col("id").alias("u"), F.col("part").alias("pu"), F.col("nth").alias("iu")), "u")
    ends = ends.join(names.select(F.col("id").alias("v"), F.col("part").alias("pv"), F.col("nth").alias("iv")), "v")

    def own_edges(group: pa.Table) -> pa.Table:
        pu, iu, pv, iv, w = (group.column(c).to_numpy() for c in ("pu", "iu", "pv", "iv", "w"))
        order = np.lexsort((iv, pv, iu))
        iu, pv, iv, w = iu[order], pv[order], iv[order], w[order]
        part = int(pu[0])
        asked = np.unique(np.column_stack([pv, iv])[pv != part], axis=0)
        parts, first = np.unique(asked[:, 0], return_index=True) if len(asked) else (np.zeros(0, int), np.zeros(0, int))
        key, own = pv.astype(np.int64) << 32 | iv, pv == part
        slot = np.searchsorted(asked[:, 0].astype(np.int64) << 32 | asked[:, 1], key)
        payload = pickle.dumps({
            "iu": iu.astype(np.int32), "iv": np.where(own, iv, -1 - slot).astype(np.int32), "w": w,
            "from": parts.astype(np.int64), "many": np.diff(np.append(first, len(asked))),
        })
        asks = [asked[asked[:, 0] == p, 1].astype(np.int32).tobytes() for p in parts]
        return _rows([part, *parts.tolist()], [part] * (1 + len(parts)), [STATE] + [PLACES] * len(parts), [payload, *asks])

    asked = write_and_read(ends.select("pu", "iu", "pv", "iv", "w").groupBy("pu").applyInArrow(own_edges, SENT), "layout-edges")

    def states(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("nth").to_numpy())
        held = np.array([group.column(c).to_numpy()[order] for c in ("x", "y", "weight")])
        part = int(group.column("part")[0].as_py())
        return _rows([part], [part], [CELLS], [np.vstack([held[:2], np.zeros((2, held.shape[1])), held[2:]]).tobytes()])

    first = write_and_read(numbered.groupBy("part").applyInArrow(states, SENT), "layout-start")

    def fixed(group: pa.Table) -> pa.Table:
        """One payload for each part; a part without edges has none to send or to ask for."""
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("kind", "source", "payload"))))
        none = {"iu": np.zeros(0, np.int32), "iv": np.zeros(0, np.int32), "w": np.zeros(0), "from": np.zeros(0, int), "many": np.zeros(0, int)}
        held = next((pickle.loads(p) for k, _, p in rows if k == STATE), none)
        held["asked"] = [(s, np.frombuffer(p, np.int32)) for k, s, p in rows if k == PLACES]
        part = int(group.column("part")[0].as_py())
        return pa.table({"part": pa.array([part], pa.int32()), "payload": pa.array([pickle.dumps(held)], pa.binary())})

    both = asked.unionByName(first)
    packed = both.groupBy("part").applyInArrow(fixed, "part int, payload binary")
    total = numbered.agg(F.sum("weight")).head()[0] or 0.0
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):  # so that the table keeps its partitioning
        fixed = cut(packed.repartition(n_parts, "part"))
    return Parts(fixed, first, names, n_parts, float(total))


# ------------------------------------------------------------------------- epochs


@dataclass(frozen=True)
class Turn:
    """What all tasks share in an epoch."""

    tree: quadtree.QuadTree
    side: float  # of the cells that the new places are counted by
    extent: float
    z: float  # summed closeness of all pairs, of the epoch before
    total: float
    number: int


#: (dx, dy, w, degree, push, velocity, turn) of a part to (new velocity, step).
Move = Callable[..., tuple[np.ndarray, np.ndarray]]


def _epoch(turn, kernel: quadtree.Kernel, pull: Callable, move: Callable):
    """The work of one part: pull along its edges, push of all cells, new places, and what others need of them."""

    def step(sent: pa.Table, fixed: pa.Table) -> pa.Table:
        if not sent.num_rows or not fixed.num_rows:
            return _rows([], [], [], [])
        now: Turn = turn.value
        held = pickle.loads(fixed.column("payload")[0].as_py())
        rows = sorted(zip(*(sent.column(c).to_pylist() for c in ("kind", "source", "payload"))))
        part = int(sent.column("part")[0].as_py())
        state = next(np.frombuffer(p).reshape(5, -1) for k, _, p in rows if k == STATE)
        xy, velocity, weight = state[:2], state[2:4], state[4]
        foreign = [np.frombuffer(p).reshape(2, -1) for k, _, p in rows if k == PLACES]
        n = xy.shape[1]
        everyone = np.concatenate([xy, *foreign], axis=1)
        other = np.where(held["iv"] >= 0, held["iv"], n - 1 - held["iv"])
        dx, dy = xy[:, held["iu"]] - everyone[:, other]
        pulled = np.array([np.bincount(held["iu"], v, n) for v in pull(dx, dy, held["w"])])
        pushed = quadtree.push(now.tree, xy[0], xy[1], weight, kernel)
        velocity, gone = move(pulled, pushed, np.bincount(held["iu"], held["w"], n), velocity, now)
        xy = xy + gone
        cells = quadtree.count_cells(xy[0], xy[1], weight, now.side)
        z = np.array([float((pushed[2] * weight).sum())])
        asked = held["asked"]
        return _rows(
            [part, *(p for p, _ in asked), part], [part] * (len(asked) + 2), [STATE, *[PLACES] * len(asked), CELLS],
            [np.vstack([xy, velocity, weight]).tobytes(), *(xy[:, at].tobytes() for _, at in asked), z.tobytes() + cells.tobytes()],
        )

    return step


def _merge_counts(payloads: list[bytes]) -> tuple[np.ndarray, float]:
    parts = [np.frombuffer(p) for p in payloads]
    return quadtree.merge_cells([p[1:].reshape(-1, 5) for p in parts]), float(sum(p[0] for p in parts))


def _counts(sent: DataFrame, n_parts: int) -> tuple[np.ndarray, float]:
    """Cell counts of all parts, in the order of the parts."""
    rows = sent.filter(F.col("kind") == CELLS)
    if n_parts > CELL_PARTS:
        def some(group: pa.Table) -> pa.Table:
            held = sorted(zip(group.column("source").to_pylist(), group.column("payload").to_pylist()))
            cells, z = _merge_counts([p for _, p in held])
            return _rows([0], [held[0][0]], [CELLS], [np.array([z]).tobytes() + cells.tobytes()])

        rows = rows.groupBy(F.pmod("source", F.lit(CELL_PARTS)).alias("share")).applyInArrow(some, SENT)
    return _merge_counts([r["payload"] for r in sorted(rows.collect(), key=lambda r: r["source"])])


def _side(extent: float) -> float:
    return 2.0 ** np.floor(np.log2(max(extent, 1e-9) / SIDES))


def _run(parts: Parts, epochs: int, kernel: quadtree.Kernel, pull: Callable, move: Callable) -> DataFrame:
    """(id, x, y) after ``epochs`` epochs.

    An epoch is one job: what parts sent each other is shuffled, and met with the
    fixed rows where they lie. Its cell counts, at most ``quadtree.MOST_CELLS``
    after merging, come back as the tree of the next epoch. Lineage is cut every ``CUT_EPOCHS`` epochs.
    """
    spark = parts.fixed.sparkSession

    def placed(group: pa.Table) -> pa.Table:
        """The start: nothing has moved yet, so parts send the places they were given."""
        rows = dict(zip(group.column("kind").to_pylist(), group.column("payload").to_pylist()))
        part = int(group.column("part")[0].as_py())
        state = np.frombuffer(rows[CELLS]).reshape(5, -1)
        asked = pickle.loads(rows[STATE])["asked"]
        box = np.array([state[0].min(), state[0].max(), state[1].min(), state[1].max()])
        return _rows(
            [part, *(p for p, _ in asked), part], [part] * (len(asked) + 2), [STATE, *[PLACES] * len(asked), CELLS],
            [state.tobytes(), *(state[:2, at].tobytes() for _, at in asked), box.tobytes()],
        )

    fixed = parts.fixed.persist()
    first = parts.start.unionByName(fixed.select("part", F.col("part").alias("source"), F.lit(STATE).alias("kind"), "payload"))
    sent = cut(first.groupBy("part").applyInArrow(placed, SENT))
    boxes = np.array([np.frombuffer(r["payload"]) for r in sent.filter(F.col("kind") == CELLS).collect()])  # one row per part
    extent = float(max(boxes[:, 1].max() - boxes[:, 0].min(), boxes[:, 3].max() - boxes[:, 2].min()))
    side = _side(extent)

    def counted(group: pa.Table) -> pa.Table:
        state, part = np.frombuffer(group.column("payload")[0].as_py()).reshape(5, -1), group.column("part")[0].as_py()
        cells = quadtree.count_cells(state[0], state[1], state[4], side)
        return _rows([part], [part], [CELLS], [np.zeros(1).tobytes() + cells.tobytes()])

    cells, _ = _counts(sent.filter(F.col("kind") == STATE).groupBy("part").applyInArrow(counted, SENT), parts.n_parts)
    z = None
    # Partitions are set by the parts. Without adaptive plans the plan of an epoch names the one before once, not twice.
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        number = 0
        while number < epochs:
            cells, own_side = quadtree.coarser(cells, side)
            tree = quadtree.build(cells, own_side)
            extent = float(np.ptp(cells[:, :2], axis=0).max() + 1) * own_side
            side = _side(extent)
            # The closeness of all pairs is that of the epoch before; the first epoch is run once without moving to get it.
            still = z is None
            turn = spark.sparkContext.broadcast(Turn(tree, side, extent, 1.0 if still else z, parts.total, number))
            step = _epoch(turn, kernel, pull, _stay if still else move)
            travels = sent.filter(F.col("kind") != CELLS).repartition(parts.n_parts, "part")
            after = travels.groupBy("part").cogroup(fixed.groupBy("part")).applyInArrow(step, SENT)
            number += not still
            keep = still or number % CUT_EPOCHS and number < epochs
            after = after.persist() if keep else cut(after)
            cells, z = _counts(after, parts.n_parts)
            sent.unpersist()
            sent = after

    def places(group: pa.Table) -> pa.Table:
        state = np.frombuffer(group.column("payload")[0].as_py()).reshape(5, -1)
        n = state.shape[1]
        return pa.table({
            "part": pa.array(np.full(n, group.column("part")[0].as_py()), pa.int32()), "nth": pa.array(np.arange(n), pa.int32()),
            "x": pa.array(state[0]), "y": pa.array(state[1]),
        })

    found = sent.filter(F.col("kind") == STATE).groupBy("part").applyInArrow(places, "part int, nth int, x double, y double")
    found = write_and_read(found.join(parts.names, ["part", "nth"]).select("id", "x", "y"), "layout")
    sent.unpersist()
    fixed.unpersist()
    return found


def _stay(pulled, pushed, degree, velocity, now):
    return velocity, np.zeros_like(velocity)


# ------------------------------------------------------------- epochs without a shuffle

PIECE = 1024  # points whose edges lie in one row, at most
DIRECT_POINTS = 4096  # up to so many points are met pair by pair
#: Bytes of all places, which the driver holds and every task is sent in an epoch, at most; larger layouts shuffle places.
MOST_SENT = 64 << 20


def _push_all(x: np.ndarray, y: np.ndarray, weight: np.ndarray, own: slice, kernel: quadtree.Kernel, direct: int) -> tuple[np.ndarray, float]:
    """The push on the points ``own`` and their share of the closeness of all pairs: pair by pair, through a mesh, or through a tree if no mesh fits."""
    ox, oy, ow = x[own], y[own], weight[own]
    if len(x) > direct and mesh.fits(x, y):
        pushed, z = mesh.push(x, y, weight, own)
        return pushed, z * len(ox) / len(x)
    if len(x) > direct:
        side = _side(float(max(np.ptp(x), np.ptp(y))))
        tree = quadtree.build(*quadtree.coarser(quadtree.count_cells(x, y, weight, side), side))
        pushed = quadtree.push(tree, ox, oy, ow, kernel)
    else:
        pushed, rows = np.zeros((3, len(ox))), max(1, (1 << 18) // len(x))
        for at in range(0, len(ox), rows):
            part = slice(at, at + rows)
            pushed[:, part] = [(v * weight).sum(axis=1) for v in kernel(ox[part, None] - x, oy[part, None] - y)]
        pushed[2] -= ow * kernel(np.zeros(1), np.zeros(1))[2]
    return pushed[:2], float((pushed[2] * ow).sum())


def _forces(places, weight, kernel: quadtree.Kernel, pull: Callable, direct: int):
    """(first point, pull and push of a task's points, their closeness) from the places of all points and the task's edges."""

    def forces(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, bytes, float]]:
        (x, y), pulled, first = places.value, [], None
        for low, n, _, payload in sorted(rows):
            first = low if first is None else first
            iu, iv, w = pickle.loads(payload) if payload else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            own = slice(low, low + n)
            found = pull(x[own][iu] - x[iv], y[own][iu] - y[iv], w)
            pulled.append([np.bincount(iu, f, n) for f in found])
        if first is not None:
            pulled = np.concatenate(pulled, axis=1)
            pushed, z = _push_all(x, y, weight.value, slice(first, first + pulled.shape[1]), kernel, direct)
            yield first, np.concatenate([pulled, pushed]).tobytes(), z

    return forces


def _run_gathered(points: DataFrame, edges: DataFrame, n: int, epochs: int, kernel: quadtree.Kernel, pull: Callable, move: Callable,
                  tasks: int | None = None, direct: int = DIRECT_POINTS) -> DataFrame:
    """(id, x, y) of ``points`` (id, x, y, weight) after ``epochs`` epochs, for forces that do not ask for a point's degree.

    Points are numbered, and the edges of consecutive ones lie in a row each. An epoch is one job without a shuffle: all
    places go to the tasks, which sum the forces on their own points. The driver holds five numbers for each point and moves them.
    """
    spark = points.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    size = max(1, min(PIECE, -(-n // (4 * tasks))))
    n_pieces = -(-n // size)
    tasks = min(tasks, n_pieces)
    numbered = number_rows(points, [F.col("id")], "nth").withColumn("nth", F.col("nth") - 1)
    numbered = write_and_read(numbered, "layout-points")
    names = numbered.select("id", "nth")
    ends = edges.join(names.select(F.col("id").alias("u"), F.col("nth").alias("iu")), "u")
    ends = ends.join(names.select(F.col("id").alias("v"), F.col("nth").alias("iv")), "v")
    ends = ends.select(F.floor(F.col("iu") / size).cast("int").alias("piece"), F.col("iu").cast("int").alias("iu"), F.col("iv").cast("int").alias("iv"), "w")

    def own_edges(group: pa.Table) -> pa.Table:
        iu, iv, w = (group.column(c).to_numpy() for c in ("iu", "iv", "w"))
        order, piece = np.lexsort((iv, iu)), int(group.column("piece")[0].as_py())
        payload = pickle.dumps((iu[order] - np.int32(piece * size), iv[order], w[order]))
        return pa.table({"piece": pa.array([piece], pa.int32()), "payload": pa.array([payload], pa.binary())})

    pieces = spark.range(n_pieces).select(F.col("id").cast("int").alias("piece"))
    packed = write_and_read(ends.groupBy("piece").applyInArrow(own_edges, "piece int, payload binary"), "layout-edges")
    packed = pieces.join(packed, "piece", "left").rdd.map(
        lambda r: (r["piece"] * tasks // n_pieces, (r["piece"] * size, min(size, n - r["piece"] * size), r["piece"], bytes(r["payload"] or b"")))
    )
    fixed = packed.partitionBy(tasks, int).values().persist(StorageLevel.MEMORY_AND_DISK)
    x, y, weight = np.zeros(n), np.zeros(n), np.zeros(n)
    for b in numbered.select("nth", "x", "y", "weight").toArrow().to_batches():  # at most ``MOST_SENT`` bytes of places
        at = b.column(0).to_numpy()
        x[at], y[at], weight[at] = (b.column(c).to_numpy() for c in (1, 2, 3))
    places, velocity, total, z, number = np.array([x, y]), np.zeros((2, n)), float(weight.sum()), None, 0
    masses = spark.sparkContext.broadcast(weight)
    while number < epochs:
        shipped = spark.sparkContext.broadcast(places)
        found = fixed.mapPartitions(_forces(shipped, masses, kernel, pull, direct)).collect()
        shipped.destroy()
        forces = np.zeros((4, n))
        for first, raw, _ in found:
            part = np.frombuffer(raw).reshape(4, -1)
            forces[:, first:first + part.shape[1]] = part
        # The closeness of all pairs is that of the epoch before; the first epoch is run once without moving to get it.
        if z is not None:
            turn = Turn(None, 0.0, float(np.ptp(places, axis=1).max()), z, total, number)
            velocity, gone = move(forces[:2], forces[2:], None, velocity, turn)
            places = places + gone
            number += 1
        z = sum(share for _, _, share in sorted(found, key=lambda r: r[0]))
    fixed.unpersist()
    masses.destroy()
    shipped = spark.sparkContext.broadcast(places)

    @F.arrow_udf("struct<x: double, y: double>")
    def placed(nth: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(v[nth.to_numpy()]) for v in shipped.value], names=["x", "y"])

    found = write_and_read(names.withColumn("at", placed("nth")).select("id", "at.x", "at.y"), "layout")
    shipped.destroy()
    return found


def _start(coords: DataFrame, id_col: str, spread: float, seed: int) -> DataFrame:
    """First two coordinates scaled to ``spread``, with a seeded nudge that parts equal points."""
    two = coords.select(F.col(id_col).cast("bigint").alias("id"), F.get("pos", F.lit(0)).alias("x"),
                        F.coalesce(F.get("pos", F.lit(1)), F.lit(0.0)).alias("y"))
    top = two.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).head()[0] or 1.0

    def nudge(salt: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(10_000)) / 10_000.0 - 0.5) * (spread * 1e-3)

    return two.select("id", (F.col("x") / top * spread + nudge(1)).alias("x"), (F.col("y") / top * spread + nudge(2)).alias("y"))


def _laid_out(coords: DataFrame, id_col: str, spread: float, seed: int, edges: DataFrame, weights: DataFrame | None, epochs: int, *forces) -> DataFrame:
    vectors = coords.select(F.col(id_col).cast("bigint").alias("id"), F.col("pos").cast("array<double>").alias("vec"))
    start = _start(coords, id_col, spread, seed)
    if vectors.isEmpty():
        return start
    return _run(_dealt(vectors, start, edges, weights), epochs, *forces)


def _laid_out_gathered(coords: DataFrame, id_col: str, spread: float, seed: int, edges: DataFrame, weights: DataFrame | None, epochs: int, *forces) -> DataFrame:
    """As :func:`_laid_out`, with the kernels of t-SNE; places travel without a shuffle while all of them are few enough."""
    start = _start(coords.filter(usable(F.col("pos").cast("array<double>"))), id_col, spread, seed)
    places = start if weights is None else start.join(weights, "id", "left")
    places = places.select("id", "x", "y", (F.lit(1.0) if weights is None else F.coalesce("weight", F.lit(1.0))).alias("weight"))
    n = places.count()
    if not n or 16 * n > MOST_SENT:
        return _laid_out(coords, id_col, spread, seed, edges, weights, epochs, *forces)
    return _run_gathered(places, edges, n, epochs, *forces)


def umap_layout(coords: DataFrame, id_col: str, edges: DataFrame, min_dist: float = 0.1, epochs: int = 30,
                seed: int = 42, weights: DataFrame | None = None) -> DataFrame:
    """(id, x, y): expected-force layout of a membership graph, started from ``coords``.

    ``weights`` (id, weight) says how many points one stands for.
    """
    a, b = (float(v) for v in curve(min_dist))

    def kernel(dx, dy):
        d2 = dx * dx + dy * dy
        c = 2 * b / ((0.001 + d2) * (1 + a * np.maximum(d2, 1e-12) ** b))
        return np.clip(c * dx, -4, 4), np.clip(c * dy, -4, 4), np.zeros(len(dx))

    def pull(dx, dy, w):
        d2 = np.maximum(dx * dx + dy * dy, 1e-12)
        c = -2.0 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b)
        return w * np.clip(c * dx, -4, 4), w * np.clip(c * dy, -4, 4)

    def move(pulled, pushed, degree, velocity, now):
        step = np.clip(2 * pulled + 5 * degree * pushed[:2] / now.total, -4, 4)
        return velocity, (1.0 - now.number / epochs) * step

    return _laid_out(coords, id_col, 10.0, seed, edges, weights, epochs, kernel, pull, move)


def tsne_layout(coords: DataFrame, id_col: str, edges: DataFrame, iterations: int = 1000, seed: int = 42,
                weights: DataFrame | None = None) -> DataFrame:
    """(id, x, y): gradient layout of symmetric affinities, started from ``coords``.

    A step is at most a tenth of the current extent. The sum of closeness over
    all pairs that scales the push is that of the iteration before, the same at rest.
    ``weights`` (id, weight) says how many points one stands for.
    """
    early = iterations // 4

    def kernel(dx, dy):
        q = 1.0 / (1.0 + dx * dx + dy * dy)
        return q * q * dx, q * q * dy, q

    def pull(dx, dy, w):
        q = w / (1 + dx * dx + dy * dy)
        return -q * dx, -q * dy

    def move(pulled, pushed, degree, velocity, now):
        boost, momentum = (12.0, 0.5) if now.number < early else (1.0, 0.8)
        rate = max(now.total / 12.0 / 4.0, 50.0)
        force = 4 * rate * (boost * pulled + pushed[:2] / max(now.z, 1e-12))
        velocity = momentum * velocity + np.clip(force, -0.1 * now.extent, 0.1 * now.extent)
        return velocity, velocity

    return _laid_out_gathered(coords, id_col, 1.0, seed, edges, weights, iterations, kernel, pull, move)


def reduce_all(points: DataFrame, id_col: str, vec_col: str, settings: AnalysisSettings = AnalysisSettings(),
               epochs: int = 30, methods: tuple[str, ...] = ("pca", "tsne", "umap"), exact: bool = True) -> dict[str, DataFrame]:
    """(id, pos) per method: t-SNE sees the principal scores of wide vectors, UMAP the standardised ones.

    Of a crowd of equal vectors as many are laid out as have all their
    neighbours among themselves, with the weight of all; the others lie with them. ``exact=False`` takes approximate neighbours.
    """
    scaled, scaler = R.standardise(points.select(F.col(id_col).alias("id"), vec_col), vec_col)
    scaled = write_and_read(scaled.select("id", "scaled"), "scaled")
    fit = R.fit_pca(scaled, "id", "scaled", settings.pca_components)
    coords = write_and_read(scaled.select("id", fit.project(F.col("scaled")).alias("pos")), "pca-coords")
    out = {"pca": coords}
    wide = len(scaler.mean) > 50
    if "tsne" in methods:
        source = coords.select("id", F.col("pos").alias("vec")) if wide else scaled.select("id", F.col("scaled").alias("vec"))
        k = min(3 * settings.perplexity, scaler.n - 1)
        firsts, weights, others = _thinned(source, k)
        edges = symmetrise(neighbor_weights(knn(firsts, "id", "vec", k, exact=exact), "tsne", settings.perplexity), "tsne")
        found = tsne_layout(coords.join(firsts.select("id"), "id", "left_semi"), "id", edges, settings.tsne_iterations, settings.seed, weights)
        out["tsne"] = _beside(found, others).select("id", F.array("x", "y").alias("pos"))
    if "umap" in methods:
        k = min(settings.umap_neighbors, scaler.n - 1)
        firsts, weights, others = _thinned(scaled.select("id", F.col("scaled").alias("vec")), k)
        edges = symmetrise(neighbor_weights(knn(firsts, "id", "vec", k, exact=exact), "umap"), "umap")
        found = umap_layout(coords.join(firsts.select("id"), "id", "left_semi"), "id", edges, settings.umap_min_dist, epochs, settings.seed, weights)
        out["umap"] = _beside(found, others).select("id", F.array("x", "y").alias("pos"))
    return out


def _thinned(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows with at most k + 1 copies of a vector, how many rows each stands for, the others (id, like) and the copy each goes with)."""
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).filter(usable(F.col("vec")))
    firsts, others = split_crowds(rows, k)
    if others is None:
        return firsts, None, None
    like = F.element_at("near", (F.pmod(F.xxhash64("id"), F.size("near")) + 1).cast("int"))
    others = write_and_read(others.select("id", like.alias("like")), "layout-others")
    weights = others.groupBy(F.col("like").alias("id")).agg((F.count(F.lit(1)) + 1).cast("double").alias("weight"))
    return firsts, weights, others


def _beside(found: DataFrame, others: DataFrame | None) -> DataFrame:
    """Places of all points: a copy that was left out lies where the one that stood for it lies."""
    if others is None:
        return found
    placed = lookup_join(others, found.withColumnRenamed("id", "like"), "like", "id", "inner")
    return found.select("id", "x", "y").unionByName(placed.select("id", "x", "y"))
