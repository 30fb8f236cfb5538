"""Approximate nearest neighbours by neighbour-graph descent.

A neighbour of a neighbour is likely a neighbour. Lists start from the exact
neighbours inside the leaves of several pivot trees, whose borders differ, so that lists reach across. In every round each row
introduces its listed neighbours, and a sample of the rows that list it, to
each other; pairs of which neither is new have met before and are left out. A row
keeps the k nearest it was introduced to. Rounds end when less than ``RATE`` of all places
changed. The work of a round is a fixed number of pairs for each row, whatever the number
of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.functions.arrow import distances, to_matrix
from semdrift.functions.vectors import usable
from semdrift.operators import nearest
from semdrift.session import write_and_read

RATE, ROUNDS, TREES = 0.002, 12, 3
#: Rows whose introductions one task makes at a time, and pairs of them held at a time.
HOSTS, PAIRS = 2048, 1 << 20

LISTS = "id bigint, neighbor bigint, distance double, fresh boolean"
_FOUND = pa.schema([("id", pa.int64()), ("neighbor", pa.int64()), ("distance", pa.float64())])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(rank, recall): of the exact neighbours up to each rank, the share that ``found`` has at any rank."""
    hit = exact.select("id", "neighbor", "rank").join(found.select("id", "neighbor", F.lit(1).alias("hit")), ["id", "neighbor"], "left")
    by_rank = hit.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    upto = Window.orderBy("rank")  # one row per rank
    return by_rank.select("rank", (F.sum("hits").over(upto) / F.sum("n").over(upto)).alias("recall"))


def _own_leaf(k: int):
    """Exact lists inside one group of rows."""

    def lists(group: pa.Table) -> pa.Table:
        ids, x = group.column("id").to_numpy(), to_matrix(group.column("vec"))
        out = []
        rows = max(1, nearest.MAX_CELLS // max(1, len(ids)))
        for at in range(0, len(ids), rows):
            d = np.round(distances(x[at:at + rows], x), nearest.DECIMALS)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            r, c = nearest.smallest(d, ids, k)
            keep = np.isfinite(d[r, c])
            out.append((ids[at + r[keep]], ids[c[keep]], d[r[keep], c[keep]]))
        own, other, d = (np.concatenate(p) for p in zip(*out))
        return pa.table([pa.array(own), pa.array(other), pa.array(d)], schema=_FOUND)

    return lists


def _introduce(group: pa.Table) -> pa.Table:
    """Distances of the guests (id, vec, fresh, kth) of each host, of which one at least is new, where they help either."""
    host, guest = group.column("host").to_numpy(), group.column("id").to_numpy()
    x, fresh = to_matrix(group.column("vec")), group.column("fresh").to_numpy(zero_copy_only=False)
    kth = pa.compute.fill_null(group.column("kth"), np.inf).to_numpy()
    order = np.lexsort((guest, host))
    host, guest, x, fresh, kth = host[order], guest[order], x[order], fresh[order], kth[order]
    starts = np.flatnonzero(np.concatenate([[True], host[1:] != host[:-1]]))
    sizes = np.diff(np.append(starts, len(host)))
    found = []
    for size in np.unique(sizes[sizes > 1]):  # hosts with as many guests are worked off together
        of_size = starts[sizes == size]
        low, high = np.triu_indices(size, 1)
        step = max(1, PAIRS // len(low))
        for at in range(0, len(of_size), step):
            a, b = (of_size[at:at + step, None] + low).ravel(), (of_size[at:at + step, None] + high).ravel()
            keep = (fresh[a] | fresh[b]) & (guest[a] != guest[b])
            a, b = a[keep], b[keep]
            d = np.round(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), nearest.DECIMALS)
            for one, two in ((a, b), (b, a)):
                helps = d <= kth[one]
                found.append((guest[one[helps]], guest[two[helps]], d[helps]))
    if not found:
        return _FOUND.empty_table()
    own, other, d = (np.concatenate(p) for p in zip(*found))
    order = np.lexsort((other, own))
    own, other, d = own[order], other[order], d[order]
    first = np.concatenate([[True], (own[1:] != own[:-1]) | (other[1:] != other[:-1])]) if len(own) else np.zeros(0, bool)
    return pa.table([pa.array(own[first]), pa.array(other[first]), pa.array(d[first])], schema=_FOUND)


def _some(rows: DataFrame, by: str, n: int, order: Column) -> DataFrame:
    """At most ``n`` rows for each ``by``; cut before the shuffle as well, so a hub weighs no more than others."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).drop("nth")


def approximate(rows: DataFrame, k: int, width: int | None = None, guests: int | None = None, trees: int = TREES,
                rate: float = RATE, rounds: int = ROUNDS, group: int | None = None) -> DataFrame:
    """(id, neighbor, distance, rank): k near others for each row (id, vec), most of them the nearest.

    Lists of ``width`` rows (twice k by default) are kept on the way. ``guests`` (two thirds of the width) new and as many old neighbours of a
    host take part in a round, and as many rows that list the host. Lists are repeatable. A row has fewer than k only where there are not k others. Rows without a
    usable vector take no part.
    """
    rows = rows.select("id", "vec").filter(usable(F.col("vec")))
    n = rows.count()
    if n <= (group or nearest.group_rows(n)):
        return nearest.search(rows, k)
    width = width or 2 * k
    guests = guests or max(8, 2 * width // 3)
    size = group or nearest.group_rows(n)
    best = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    own, lists = _own_leaf(width), None
    for tree in range(trees):
        dealt = nearest.deal(nearest.place(rows, nearest.grow(rows, n, max(1, size // 4), 2 * tree)), size, True).rows
        found = dealt.groupBy("part").applyInArrow(lambda t: own(t), "id bigint, neighbor bigint, distance double")
        lists = found if lists is None else lists.unionByName(found)
    lists = lists.groupBy("id", "neighbor").agg(F.min("distance").alias("distance")).withColumn("rank", best)
    lists = lists.filter(F.col("rank") <= width).select("id", "neighbor", "distance", F.lit(True).alias("fresh"))
    lists = write_and_read(lists, "descent-lists")
    vectors = write_and_read(rows, "descent-vectors")
    hosts = max(1, -(-n // HOSTS))
    for turn in range(rounds):
        draw = F.xxhash64("id", "neighbor", F.lit(turn))
        # Of the new places some are introduced, and are old from then on; the others wait as new.
        drawn = _some(lists.filter("fresh"), "id", guests, draw).select("id", "neighbor", F.lit(True).alias("drawn"))
        marked = write_and_read(lists.join(drawn, ["id", "neighbor"], "left"), "descent-marked")
        both = []
        for fresh in (True, False):
            side = marked.filter("drawn") if fresh else _some(marked.filter("NOT fresh"), "id", guests, draw)
            back = _some(side, "neighbor", guests, draw)
            both.append(side.select(F.col("id").alias("host"), F.col("neighbor").alias("id"), F.lit(fresh).alias("fresh")))
            both.append(back.select(F.col("neighbor").alias("host"), "id", F.lit(fresh).alias("fresh")))
        met = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
        met = met.groupBy("host", "id").agg(F.max("fresh").alias("fresh"))
        kth = marked.groupBy("id").agg(F.when(F.count(F.lit(1)) >= width, F.max("distance")).alias("kth"))
        carried = met.join(vectors.join(kth, "id", "left"), "id")
        carried = carried.withColumn("bucket", F.pmod(F.xxhash64("host"), F.lit(hosts)))
        found = carried.groupBy("bucket").applyInArrow(_introduce, "id bigint, neighbor bigint, distance double")
        # A pair that is listed already keeps its mark; others are new.
        held = marked.select("id", "neighbor", "distance", (F.col("fresh") & F.col("drawn").isNull()).alias("fresh"), F.lit(True).alias("held"))
        new = found.withColumn("fresh", F.lit(True)).withColumn("held", F.lit(False))
        merged = held.unionByName(new).groupBy("id", "neighbor").agg(
            F.min("distance").alias("distance"), F.min("fresh").alias("fresh"), F.max("held").alias("held")
        )
        merged = write_and_read(merged.withColumn("rank", best).filter(F.col("rank") <= width), "descent-lists")
        lists = merged.select("id", "neighbor", "distance", "fresh")
        if merged.filter("NOT held").count() <= rate * n * width:
            break
    return lists.withColumn("rank", best).filter(F.col("rank") <= k).select("id", "neighbor", "distance", "rank")
