"""Boilerplate lines by site-relative frequency.

A line is compared by its text without white space around it. For every host
the pages that contain a line are counted, each page once, and divided by the
pages of the host; a line is boilerplate on that host where the share reaches
``RATIO`` and at least ``MIN_PAGES`` pages have it. Blank lines are never
boilerplate. Built from column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.common import fresh
from semdrift.operators.skew import lookup_join
from semdrift.session import write_and_read

#: From measured shares (README): lines of over 50 words, which copied articles share, stay below it, repeated short lines reach it.
RATIO = 0.01
MIN_PAGES = 3
#: Lists of boilerplate for more hosts, or of more lines, are joined, not broadcast.
SHIPPED_LINES = 100_000

SPACE = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits that stand for a line in counts and lists."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def _host(host: Column) -> Column:
    """Hosts as text; a null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", text: str = "text"
) -> DataFrame:
    """(host, key, pages, host_pages) of every boilerplate line.

    A host has at most (mean lines of a page / ratio) of them. Counts are
    combined before the shuffle, so a host or line of very many pages weighs
    no more than others.
    """
    pages = docs.select(_host(F.col(host)).alias("host"), F.col(text).cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    full = F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    keys = F.array_distinct(F.transform(full, _key))
    counted = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    return (
        counted.filter(F.col("pages") >= min_pages).join(totals, "host")
        .filter(F.col("pages") >= F.col("host_pages") * F.lit(float(ratio)))
    )


def drop_boilerplate(
    docs: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    host: str = "source",
    text: str = "text",
    n_lines: str | None = None,
    n_dropped: str | None = None,
) -> DataFrame:
    """``docs`` with the boilerplate lines of each host taken out of ``text``.

    All rows, other columns and remaining lines stay as they are, in order.
    A null text stays null; a text of boilerplate alone becomes empty. Rows
    that repeat are pages of their own. ``n_lines`` and ``n_dropped`` name
    columns for the lines before and the lines dropped. The pages are read
    twice and their texts are not shuffled while the list of boilerplate is
    small enough to be broadcast; a longer list is joined by host, rows of
    crowded hosts being spread.
    """
    found = write_and_read(boilerplate(docs, ratio, min_pages, host, text), "boilerplate")
    lists = found.groupBy("host").agg(F.collect_list("key").alias("drop"))
    site, drop, keep = fresh(docs, "site"), fresh(docs, "drop"), fresh(docs, "keep")
    lists = lists.select(F.col("host").alias(site), F.col("drop").alias(drop))
    placed = docs.withColumn(site, _host(F.col(host)))
    if found.limit(SHIPPED_LINES + 1).count() <= SHIPPED_LINES:
        joined = placed.join(F.broadcast(lists), site, "left")
    else:
        identity = fresh(placed, "row")
        joined = lookup_join(placed.withColumn(identity, F.struct(*docs.columns)), lists, site, identity)
    split = _lines(F.col(text).cast("string"))
    kept = F.when(F.col(drop).isNull(), split).otherwise(
        F.filter(split, lambda x: ~F.array_contains(F.col(drop), _key(x)))
    )
    columns = [F.array_join(F.col(keep), "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    before, after = F.coalesce(F.size(split), F.lit(0)), F.coalesce(F.size(keep), F.lit(0))
    before = F.when(F.col(text).isNull(), 0).otherwise(before)
    after = F.when(F.col(text).isNull(), 0).otherwise(after)
    if n_lines:
        columns.append(before.cast("long").alias(n_lines))
    if n_dropped:
        columns.append((before - after).cast("long").alias(n_dropped))
    return joined.withColumn(keep, kept).select(*columns)
