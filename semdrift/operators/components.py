"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.operators.skew import lookup_join
from semdrift.session import cut

MAX_ROUNDS = 60


def _to_smallest(edges: DataFrame, part: list[str], keep_larger: bool, rows: int) -> DataFrame:
    """Link the neighbours of every node to its smallest neighbour.

    With ``keep_larger`` only neighbours above the node are re-linked;
    otherwise those below it and the node itself.
    """
    if keep_larger:
        sides = edges.unionByName(edges.select(*part, F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges  # u > v
    smallest = sides.groupBy(*part, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    sides = sides.withColumn("_row", F.struct("u", "v"))
    linked = lookup_join(sides, smallest, [*part, "u"], "_row", "inner", left_rows=2 * rows)
    if keep_larger:
        return linked.filter("v > u").select(*part, F.col("v").alias("u"), F.col("m").alias("v"))
    below = linked.select(*part, F.col("v").alias("u"), F.col("m").alias("v"))
    own = smallest.select(*part, "u", F.col("m").alias("v"))
    return below.unionByName(own).filter("u > v").distinct()


def _unsettled(edges: DataFrame, part: list[str]) -> tuple[int, int]:
    """(edges, nodes that are linked twice or both a child and a root)."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("root")),
        F.struct(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("root")),
    ))
    nodes = edges.select(*part, ends.alias("e")).groupBy(*part, "e.id").agg(
        F.sum("e.child").alias("child"), F.max("e.root").alias("root")
    )
    row = nodes.agg(
        F.sum("child"), F.count_if((F.col("child") > 1) | ((F.col("child") > 0) & (F.col("root") > 0)))
    ).head()
    return int(row[0] or 0), int(row[1])


def connected_components(edges: DataFrame, part: list[str] | None = None) -> DataFrame:
    """(part…, id, root) for every node with an edge; root is the smallest id of the component.

    ``edges`` has (part…, u, v). Every round links each node's larger
    neighbours, then its smaller ones, to the smallest id around it; the edge
    table shrinks to one star per component in logarithmically many rounds.
    Minima are combined on the map side and links of a hub are split.
    """
    part = part or []
    now = cut(
        edges.filter("u <> v").select(*part, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        rows, unsettled = _unsettled(now, part)
        if not unsettled:
            members = now.select(*part, F.col("u").alias("id"), F.col("v").alias("root"))
            roots = now.select(*part, F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            return members.unionByName(roots)
        now = cut(_to_smallest(_to_smallest(now, part, True, rows), part, False, rows))
    raise RuntimeError("components did not settle")
