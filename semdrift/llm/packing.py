"""Best-fit packing into bins of several permitted lengths.

Documents are measured in tokens (words and one end token), cut into pieces no
longer than the longest permitted length and packed, longest first. A piece
goes into the open bin with the least room that still takes it. If there is
none, a bin opens: of all permitted lengths that take the piece, the one with
the least cost for each token it can be expected to hold, given the pieces
that are left. At the end every bin shrinks to the least permitted length that
holds its contents.

Pieces are dealt by hash into shards of about ``SHARD_PIECES``; a shard is
packed by one task, and only ids and lengths are shuffled. Bins left open at
the end of a shard cost little, as they shrink too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.common import batch
from semdrift.session import ship_package, write_and_read

LENGTHS = (512, 1024, 2048, 4096)
SHARD_PIECES = 5_000
#: A sequence of this many tokens costs twice as much a token as a short one (attention).
DOUBLE_AT = 16_384
#: Fixed cost of a sequence, in tokens.
OVERHEAD = 32

_MEASURED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
    ("bin_id", pa.int64()), ("bin_offset", pa.int64()), ("bin_length", pa.int64()),
])
PACKED = "doc_id long, piece long, start long, length long, bin_id long, bin_offset long, bin_length long"


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens): words and one end token; a null text has the end token only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            yield batch(_MEASURED, doc_id=b.column(0).cast(pa.int64()), n_tokens=[len((t or b"").split()) + 1 for t in texts])

    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(count, "doc_id long, n_tokens long")


def bin_cost(length: int) -> float:
    return OVERHEAD + length * (1 + length / DOUBLE_AT)


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, length of each bin); ``sizes`` must fall."""
    lengths = sorted(lengths)
    top, n = lengths[-1], len(sizes)
    ascending = np.array(sizes[::-1], np.int64)
    # below[x]: how many pieces are no longer than x; total[i]: tokens of the i shortest.
    below = np.searchsorted(ascending, np.arange(top + 1), side="right").tolist()
    total = [0, *np.cumsum(ascending).tolist()]
    cost = [bin_cost(c) for c in lengths]
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin with r tokens of room is open
    size_of, used = [], []
    bins, offsets = [], []
    for i, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            same = open_by_room[room]
            b = same.pop()
            if not same:
                rooms ^= 1 << room
        else:
            left = n - i - 1  # the shorter pieces
            best = None
            for c, price in zip(lengths, cost):
                if c >= size:
                    rate = price / (size + min(c - size, total[min(left, below[c - size])]))
                    if best is None or rate < best[0]:
                        best = (rate, c)
            b, room = len(size_of), best[1]
            size_of.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        room -= size
        if room:
            open_by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins, offsets, [next(c for c in lengths if c >= u) for u in used]


def pack(counted: DataFrame, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, bin_length), a row per piece of ``counted`` (doc_id, n_tokens).

    ``start`` counts tokens inside the document, ``bin_offset`` inside the bin.
    Every token of every row is in exactly one bin. Rows that repeat, or that
    have no id, are packed like any other; ties are broken by id. A count
    below one is packed as an empty piece of no bin and left out. An empty
    table gives an empty result.
    """
    top = max(lengths)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / F.lit(top)).cast("long")))
    cut = counted.filter("n_tokens >= 1").withColumn("piece", piece).select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"),
        F.least(F.lit(top).cast("long"), F.col("n_tokens") - F.col("piece") * top).alias("length"))
    # Each piece is written with a number of its own, by which it is dealt: rows that repeat, or have no id, lie in all shards.
    cut = write_and_read(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))

    def packed(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, sizes = best_fit(table.column("length").to_pylist(), lengths)
        bins = np.array(bins, np.int64)
        return pa.table({
            **{c: table.column(c) for c in ("doc_id", "piece", "start", "length")},
            "bin_id": bins + (shard << 32), "bin_offset": np.array(offsets, np.int64),
            "bin_length": np.array(sizes, np.int64)[bins],
        }, schema=_PACKED)

    ship_package(counted.sparkSession)
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).drop("row")
    return dealt.groupBy("shard").applyInArrow(packed, PACKED)


def pack_documents(
    docs: DataFrame, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``pack`` of whole documents; other columns are not read."""
    return pack(measured(docs, doc_id, text), lengths, shard_pieces)
