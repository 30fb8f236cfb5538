"""Joins and numbering that stay even when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.session import cut, write_and_read

HOT_ROWS = 1_000_000
SALTS = 64
#: A table of so many keys at most, counted, travels to the tasks.
FEW_KEYS = 100_000


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    spread: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
    left_rows: int | None = None,
) -> DataFrame:
    """Join ``left`` to a table with one row per key, splitting hot keys of ``left``.

    A key is hot above ``hot_rows`` rows, so there are at most
    ``rows / hot_rows`` of them and their list may be broadcast. Rows of a hot
    key, and rows without a key, are spread over ``salts`` tasks by the hash
    of column ``spread`` (a row identity, so that a retried task repeats the
    same choice); only the matching right rows are repeated. The list is worked out and written first,
    from the keys of ``left`` alone; where it is empty the join is a plain one. A caller that
    has counted ``left`` passes ``left_rows``: too few rows for a hot key need
    none of this.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if left_rows is not None and left_rows <= hot_rows:
        return left.join(right, keys, how)
    hot = (
        left.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    hot = write_and_read(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    no_key = F.lit(False)
    for k in keys:
        no_key |= F.col(k).isNull()
    salted_left = left.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | no_key, F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)))
        .otherwise(F.lit(0)).cast("int"),
    ).drop("_hot")
    salted_right = right.join(hot, keys, "left").withColumn(
        "_salt",
        F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))),
    ).drop("_hot")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``. Copies are dropped before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """Exact 1-based global row number in ``order`` without a single-task sort.

    Range partitions are sorted and numbered on their own; the offsets come
    from one count per partition. ``order`` must end in a unique column so
    that no sort key is hot. The sorted rows are materialised first because a
    second evaluation could draw other range bounds.
    """
    ranged = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mono", 33))
        .withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono")
    )
    sizes = ranged.groupBy("_part").agg((F.max("_pos") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def number_within(df: DataFrame, group: str, order: Sequence[Column], name: str = "row_no") -> DataFrame:
    """1-based row number inside each group; groups may be large but few (datasets, clusters)."""
    numbered = number_rows(df, [F.col(group), *order], "_global")
    starts = cut(numbered.groupBy(group).agg((F.min("_global") - 1).alias("_start")))
    if starts.limit(FEW_KEYS + 1).count() <= FEW_KEYS:
        joined = numbered.join(F.broadcast(starts), group)
    else:
        joined = lookup_join(numbered, starts, group, "_global", "inner")
    return joined.withColumn(
        name, F.col("_global") - F.col("_start")
    ).drop("_global", "_start")
