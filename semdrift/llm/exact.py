"""Exact de-duplication through a minimal perfect hash over known digests.

The history of distinct text digests is split by digest into shards of
bounded size. One task builds a minimal perfect hash of a shard: every digest
gets a slot of its own in 0..n-1, and the slot holds the full digest, the
locator of the winner and the number of rows. A lookup computes one slot and
compares all 32 bytes, so a digest that is not in the history never passes for
one that is; such rows are grouped by themselves.

Texts are equal when they are identical after lower-casing A-Z; a null text
counts as empty. Texts are hashed where they are read; only digests move.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.common import batch
from semdrift.session import ship_package, write_and_read

SHARD_ROWS = 500_000
#: A shard with more rows than this many times the mean is met by several copies of its index.
HOT_FACTOR = 1.5
GAMMA = 1.5
MAX_LEVELS = 200

DIGESTS = "doc_id long, digest binary, shard long"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("shard", pa.int64())])
INDEX = "shard long, slots long, sizes binary, bits binary, ranks binary, digests binary, keep binary, rows binary"
_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()),
    ("known", pa.bool_()),
])
FOUND = "doc_id long, digest binary, keep_id long, group_size long, known boolean"


# ------------------------------------------------------------------ the hash of one shard


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each digest (four 64-bit words) in a level of ``size`` cells."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (words[:, level % 4] ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= words[:, (level + 1) % 4] + (h >> np.uint64(29))
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def build_index(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, packed bits, ones before every 64-bit word) of a minimal perfect hash.

    ``digests`` holds n different rows of four 64-bit words. On each level the
    digests that are alone in their cell get it; the others go on to the next
    level. The slot of a digest is the number of taken cells before its own.
    """
    sizes, rows, left = [], [], digests
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("digests repeat")
        size = 64 * math.ceil(max(1, GAMMA * len(left)) / 64)
        at = _place(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        rows.append(alone)
        left = left[~alone[at]]
    bits = np.concatenate(rows) if rows else np.zeros(0, bool)
    packed = np.packbits(bits, bitorder="little").view(np.uint64) if len(bits) else np.zeros(0, np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
    return np.array(sizes, np.int64), packed, ones


def slots(index: tuple[np.ndarray, np.ndarray, np.ndarray], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest; -1 for one that no level holds. A stranger may get any slot."""
    sizes, packed, ones = index
    out = np.full(len(digests), -1, np.int64)
    open_, base = np.arange(len(digests)), 0
    for level, size in enumerate(sizes.tolist()):
        if not len(open_):
            break
        at = _place(digests[open_], level, size) + base
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        taken = (packed[word] >> bit) & np.uint64(1) == 1
        hit = open_[taken]
        below = packed[word[taken]] & ((np.uint64(1) << bit[taken]) - np.uint64(1))
        out[hit] = ones[word[taken]] + np.bitwise_count(below)
        open_, base = open_[~taken], base + size
    return out


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Binary digests of 32 bytes as rows of four 64-bit words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


# ------------------------------------------------------------------ Spark stages


def digests(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, shard): the SHA-256 of every text after lower-casing A-Z."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hashlib.sha256((t or b"").lower()).digest() for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            shard = np.frombuffer(b"".join(d[:8] for d in found), dtype=">u8") % np.uint64(shards)
            yield batch(_DIGESTS, doc_id=b.column(0).cast(pa.int64()), digest=found, shard=shard.astype(np.int64))

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(hashed, DIGESTS)


def shard_count(rows: int, parallel: int) -> int:
    return max(1, parallel, math.ceil(rows / SHARD_ROWS))


def build(history: DataFrame) -> DataFrame:
    """The index of ``history`` (digest, shard, keep_id, group_size), a row per shard.

    ``history`` must hold each digest once.
    """

    def one(table: pa.Table) -> pa.Table:
        words = _words(table.column("digest"))
        index = build_index(words)
        order = np.argsort(slots(index, words))
        return pa.table({
            "shard": table.column("shard").slice(0, 1), "slots": [len(words)], "sizes": [index[0].tobytes()],
            "bits": [index[1].tobytes()], "ranks": [index[2].tobytes()], "digests": [words[order].tobytes()],
            "keep": [table.column("keep_id").to_numpy()[order].astype(np.int64).tobytes()],
            "rows": [table.column("group_size").to_numpy()[order].astype(np.int64).tobytes()],
        })

    return history.groupBy("shard").applyInArrow(one, INDEX)


def look_up(found: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, known) of every row of ``found`` (doc_id, digest, shard).

    Rows of a crowded shard are spread by their id over several tasks, each
    with a copy of that shard's index; how many follows from the shard's row
    count.
    """
    sizes = found.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    fair = F.greatest(F.lit(1.0), F.avg("rows") * HOT_FACTOR)
    # one row per shard
    copies = sizes.crossJoin(F.broadcast(sizes.agg(fair.alias("fair")))).select(
        "shard", F.ceil(F.col("rows") / F.col("fair")).cast("int").alias("copies"))
    copies = write_and_read(copies, "shard-copies")
    spread = found.join(F.broadcast(copies), "shard").withColumn(
        "copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")).drop("copies")
    copied = index.join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        if not n:
            return pa.Table.from_batches([], schema=_FOUND)
        known, keep, rows = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if right.num_rows:
            row = right.to_pylist()[0]
            parts = [np.frombuffer(row[k], dtype=d) for k, d in (("sizes", np.int64), ("bits", np.uint64), ("ranks", np.int64))]
            words = _words(left.column("digest"))
            slot = slots(tuple(parts), words)
            held = np.frombuffer(row["digests"], dtype="<u8").reshape(-1, 4)
            known = slot >= 0
            known[known] = (held[slot[known]] == words[known]).all(axis=1)
            keep[known] = np.frombuffer(row["keep"], np.int64)[slot[known]]
            rows[known] = np.frombuffer(row["rows"], np.int64)[slot[known]]
        return pa.table({
            "doc_id": left.column("doc_id"), "digest": left.column("digest"),
            "keep_id": pa.array(keep, mask=~known), "group_size": pa.array(rows, mask=~known), "known": known,
        }, schema=_FOUND)

    return spread.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(probe, FOUND)


def exact_dedup(
    docs: DataFrame, history: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per row of ``docs``.

    Of equal texts the row with the largest ``doc_id`` stays. ``history`` is a
    table of texts known before (``docs`` itself by default); a row whose
    text occurs there takes its winner and size from the index, every other
    row is grouped among the rows of ``docs`` alone. With a separate history,
    ``kept`` is false for every row with a known text: the winner is the
    historical row. A repeated row (same id, same text) counts each time it
    occurs, and all its copies are kept or dropped together; a null id loses
    to any other. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = history is None
    source = docs if own else history
    shards = shard_count(source.count(), parallel)
    old = write_and_read(digests(source, shards, doc_id, text), "digests")
    new = old if own else write_and_read(digests(docs, shards, doc_id, text), "digests")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(
            F.first("shard").alias("shard"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    index = build(grouped(old).withColumn("keep_id", F.coalesce("keep_id", F.lit(-1).cast("long"))))
    index = write_and_read(index, "digest-index")
    found = look_up(new, index)
    if not own:
        found = write_and_read(found, "digest-lookups")
    members = found.filter("known")
    kept = F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("keep_id") if own else F.lit(False)
    columns = ["doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    if own:
        return members.select(*columns)
    strangers = found.filter("not known").select("doc_id", "digest", F.lit(0).alias("shard"))
    groups = grouped(strangers).drop("shard")
    alone = strangers.join(groups, "digest").select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
    return members.select(*columns).unionByName(alone)
