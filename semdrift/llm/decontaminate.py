"""Benchmark windows inside documents by a prefix-filtered set join.

Words are runs of digits, letters and characters beyond ASCII after
lower-casing A-Z. A window is ten consecutive words of an item; an item of
fewer words, but not none, is one window. A window is a set of word shingles,
ordered by how rarely they occur in all documents. A document that contains
the whole window contains all of its shingles, so of m shingles the necessary
prefix is the m - m + 1 = 1 rarest: documents meet windows on that token only.
The token's position gives the only place the window can start at; the place
must leave room for the whole window inside the document. What passes is
compared word by word and then byte by byte.

Up to ``SHIPPED_WINDOWS`` windows (counted first) travel to the tasks in blocks of at most ``BLOCK_WINDOWS`` and are met
by one scan of the documents. More are joined (:func:`contamination_by_join`): windows and documents
meet in a shuffle by the rarest shingle, and nothing but a bit field of bounded size goes through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import ALNUM, LOWER, mixed, pieces, span_hashes, word_bounds
from semdrift.llm.common import batch
from semdrift.session import ship_package, write_and_read

WINDOW = 10
SHINGLE = 3
BLOCK_WINDOWS, SHIPPED_WINDOWS = 100_000, 1_000_000
FILTER_BITS = 20
#: Bits of the field that sorts out document shingles before the join, as a power of two; occurrences of a shingle in one task.
FIELD_BITS, HOT_ROWS = 27, 100_000

_WINDOWS = pa.schema([("window", pa.binary()), ("item_id", pa.string())])
_COUNTS = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])
_HITS = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
    ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
])
HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _words(text: bytes) -> list[bytes]:
    low = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_bounds(low, np.array([0, len(low)]), ALNUM)
    raw = low.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def windows(benchmark: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item_id) of every window of every item, each pair once; windows are space-joined words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                words = _words(raw or b"")
                found = {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} - {b""}
                yield batch(_WINDOWS, window=sorted(found), item_id=[item] * len(found))

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string"))
    return rows.mapInArrow(cut, "window binary, item_id string").distinct()


# ------------------------------------------------------------------ hashes of words and shingles

_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _STEPS[0]
    for k in range(1, width):
        h += words[k:k + n] * _STEPS[k]
    return mixed(h)


def _hashed(window: bytes) -> np.ndarray:
    data = np.frombuffer(window, np.uint8)
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return span_hashes(data, starts, ends)


def _width(words: int, shingle: int) -> int:
    return min(words, shingle)


class Sieve:
    """A bit field and the sorted hashes behind it."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - FILTER_BITS)
        self.field = np.zeros(1 << FILTER_BITS, bool)
        self.field[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions in ``h``, first and end in the keys) of the hashes that occur among the keys."""
        at = np.flatnonzero(self.field[(h >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.keys, h[at], side="left")
        high = np.searchsorted(self.keys, h[at], side="right")
        hit = high > low
        return at[hit], low[hit], high[hit]


@dataclass
class Block:
    """Windows of one block, ready to be met."""

    texts: list[bytes]
    items: list[list[str]]
    words: np.ndarray  # all word hashes, window after window
    begin: np.ndarray
    size: np.ndarray
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # width: (hash, window, position of the token)


def _block(texts: list[bytes], items: list[list[str]], seen: dict[int, int], shingle: int) -> Block:
    """The prefix index of the windows; ``seen`` counts each shingle over all documents."""
    hashes = [_hashed(t) for t in texts]
    size = np.array([len(h) for h in hashes], np.int64)
    prefix: dict[int, list[tuple[int, int, int]]] = {}
    for w, h in enumerate(hashes):
        width = _width(len(h), shingle)
        tokens = _shingles(h, width).tolist()
        _, token, position = min((seen.get(t, 0), t, i) for i, t in enumerate(tokens))
        prefix.setdefault(width, []).append((token, w, position))
    table = {}
    for width, rows in prefix.items():
        rows.sort()
        table[width] = tuple(np.array([r[k] for r in rows], (np.uint64, np.int64, np.int64)[k]) for k in range(3))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Block(texts, items, words, np.cumsum(size) - size, size, table)


def _candidates(block: Block, sieves: dict[int, Sieve], words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all occurrences by hash; ``bounds`` are the words before each document."""
    starts, found = [], []
    for width, (_, window, position) in block.prefix.items():
        at, low, high = sieves[width].find(_shingles(words, width))
        count = high - low
        slot = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        w, place = window[slot], np.repeat(at, count)
        start = place - position[slot]
        doc = np.searchsorted(bounds, place, side="right") - 1
        room = (start >= bounds[doc]) & (start + block.size[w] <= bounds[doc + 1])
        start, w = start[room], w[room]
        for k in range(int(block.size[w].max()) if len(w) else 0):
            long = block.size[w] > k
            same = np.ones(len(w), bool)
            same[long] = words[start[long] + k] == block.words[block.begin[w[long]] + k]
            start, w = start[same], w[same]
        starts.append(start)
        found.append(w)
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def _occurrences(
    block: Block, sieves: dict[int, Sieve], raw: bytes, s: np.ndarray, e: np.ndarray, words: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The candidates whose bytes are those of the window."""
    start, w = _candidates(block, sieves, words, bounds)
    equal = np.fromiter(
        (
            b" ".join([raw[s[i]:e[i]] for i in range(p, p + int(block.size[x]))]) == block.texts[x]
            for p, x in zip(start.tolist(), w.tolist())
        ),
        bool, len(w),
    )
    return start[equal], w[equal]


# ------------------------------------------------------------------ Spark stages


def _shingle_counts(docs: DataFrame, blocks: list, doc_text: str) -> DataFrame:
    """(shingle, n): how often each shingle of the shipped blocks occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shipped in blocks:
                for width, keys in shipped.value.items():
                    sieve, sums = Sieve(keys), np.zeros(len(keys), np.int64)
                    for _, data, offsets in pieces(b.column(0)):
                        low = LOWER[data]
                        s, e, bounds = word_bounds(low, offsets, ALNUM)
                        h = _shingles(span_hashes(low, s, e), width)
                        at, first, _ = sieve.find(h)
                        doc = np.searchsorted(bounds, at, side="right") - 1
                        inside = at + width <= bounds[doc + 1]
                        sums += np.bincount(first[inside], minlength=len(keys))
                    some = sums > 0
                    yield batch(_COUNTS, shingle=keys[some].view(np.int64), n=sums[some])

    return docs.select(F.col(doc_text).cast("string")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(
        F.sum("n").alias("n"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_windows: int = BLOCK_WINDOWS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shipped_windows: int = SHIPPED_WINDOWS,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row per row of ``docs``.

    ``n_hit`` counts the words inside any occurrence of a window, each once;
    ``n_items`` the items with an occurring window; ``items_sha256`` is over
    their ids, sorted as strings and comma-joined (no item: of the empty
    string). A null or empty text has no words. Items that repeat count once
    for each id, a null id being the empty string. An empty benchmark hits
    nothing; empty documents give an empty result. Other columns are not
    read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    sc = spark.sparkContext
    found = write_and_read(windows(benchmark, size, item_id, item_text), "windows")
    total = found.select("window").distinct().count()
    if total > shipped_windows:
        return contamination_by_join(docs, found, shingle, doc_id, text)
    n_blocks = -(-total // block_windows)
    texts, owners = [], []
    for i in range(n_blocks):
        # A block holds about block_windows windows; one is on the driver at a time.
        part = found.filter(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == i)
        rows = part.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).orderBy("window").collect()
        texts.append([bytes(r["window"]) for r in rows])
        owners.append([list(r["items"]) for r in rows])
    keyed = []
    for block in texts:
        keys: dict[int, list[np.ndarray]] = {}
        for t in block:
            h = _hashed(t)
            width = _width(len(h), shingle)
            keys.setdefault(width, []).append(_shingles(h, width))
        keyed.append(sc.broadcast({w: np.unique(np.concatenate(k)) for w, k in keys.items()}))
    # At most one row for each shingle of the windows.
    seen = {r["shingle"] % (1 << 64): r["n"] for r in _shingle_counts(docs, keyed, text).collect()} if keyed else {}
    shipped = [sc.broadcast(_block(t, o, seen, shingle)) for t, o in zip(texts, owners)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            items: list[set[str]] = [set() for _ in range(n)]
            blocks = [(x.value, {w: Sieve(k[0]) for w, k in x.value.prefix.items()}) for x in shipped]
            for first, data, offsets in pieces(b.column(1)):
                low = LOWER[data]
                s, e, bounds = word_bounds(low, offsets, ALNUM)
                words = span_hashes(low, s, e)
                raw = low.tobytes()
                edges = np.zeros(len(words) + 1, np.int64)
                for block, sieves in blocks:
                    start, w = _occurrences(block, sieves, raw, s, e, words, bounds)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + block.size[w], -1)
                    doc = np.searchsorted(bounds, start, side="right") - 1
                    for d, x in {*zip((first + doc).tolist(), w.tolist())}:
                        items[d].update(block.items[x])
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
                n_words[first:first + len(bounds) - 1] = np.diff(bounds)
                n_hit[first:first + len(bounds) - 1] = np.diff(hit[bounds])
            yield batch(
                _HITS, doc_id=b.column(0).cast(pa.int64()), n_words=n_words, n_hit=n_hit,
                n_items=[len(x) for x in items], contaminated=n_hit > 0,
                items_sha256=[hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
            )

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(meet, HITS)


# ------------------------------------------------------------------ more windows than tasks can hold

_TOKENS = pa.schema([("wid", pa.int64()), ("size", pa.int32()), ("width", pa.int32()), ("token", pa.int64()), ("position", pa.int32())])
_MET = pa.schema([
    ("row", pa.int64()), ("width", pa.int32()), ("token", pa.int64()), ("place", pa.int64()), ("before", pa.int32()), ("words", pa.binary()),
])


def _tokens(rows: DataFrame, shingle: int) -> DataFrame:
    """(wid, size, width, token, position): every shingle of every window (wid, window)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for wid, window in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _hashed(window)
                width = _width(len(h), shingle)
                out += [(wid, len(h), width, t, i) for i, t in enumerate(_shingles(h, width).view(np.int64).tolist())]
            if out:
                yield batch(_TOKENS, **dict(zip(_TOKENS.names, zip(*out))))

    return rows.select("wid", "window").mapInArrow(cut, "wid long, size int, width int, token long, position int")


def _field(tokens: DataFrame) -> np.ndarray:
    """A bit for the upper ``FIELD_BITS`` bits of every token; at most 2^FIELD_BITS / 64 rows reach the driver."""
    place = F.shiftrightunsigned("token", 64 - FIELD_BITS)
    rows = tokens.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, int(shiftrightunsigned(token, {}) & 63))".format(64 - FIELD_BITS)).alias("bit"))
    found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return field


def _passes(field: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions of the hashes whose bit is set."""
    place = (h >> np.uint64(64 - FIELD_BITS)).astype(np.int64)
    return np.flatnonzero((field[place >> 6] >> (place & 63)) & 1)


def _doc_shingles(column: pa.Array, widths: list[int], field: np.ndarray) -> Iterator[tuple]:
    """(first row, width, bytes, word starts and ends, words before each row, token, place) of shingles that pass the field."""
    for first, data, offsets in pieces(column):
        low = LOWER[data]
        s, e, bounds = word_bounds(low, offsets, ALNUM)
        words = span_hashes(low, s, e)
        for width in widths:
            h = _shingles(words, width)
            at = _passes(field, h)
            doc = np.searchsorted(bounds, at, side="right") - 1
            inside = at + width <= bounds[doc + 1]
            yield first, width, low, s, e, bounds, h[at[inside]].view(np.int64), at[inside], doc[inside]


def contamination_by_join(docs: DataFrame, found: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What :func:`contamination` gives, for any number of windows ``found`` (window, item_id).

    Windows are ranked by a count join of their shingles with those of all documents. A document sends, for each place
    where a prefix shingle could stand, the words around it; windows and places meet by shingle, places of a frequent one being
    spread over as many tasks as its count asks for, and the bytes are compared there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = write_and_read(rows, "checked-docs")
    listed = write_and_read(found.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "numbered-windows")
    tokens = write_and_read(_tokens(listed, shingle), "window-shingles")
    widths = sorted(r["width"] for r in tokens.select("width").distinct().collect())  # shingle at most
    longest = tokens.agg(F.max("size")).head()[0]
    field = spark.sparkContext.broadcast(_field(tokens))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, width, *_, token, _, _ in _doc_shingles(b.column(0), widths, field.value):
                some, n = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_pydict({"width": pa.array(np.full(len(some), width), pa.int32()), "token": pa.array(some), "n": pa.array(n, pa.int64())})

    counts = rows.select("text").mapInArrow(counted, "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n"))
    ranked = tokens.join(counts, ["width", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.groupBy("wid", "size", "width").agg(F.min(F.struct("n", "token", "position")).alias("p")).filter("p.n > 0")
    prefix = prefix.select("wid", "size", "width", "p.*").withColumn("parts", F.ceil(F.col("n") / HOT_ROWS).cast("int"))
    prefix = write_and_read(prefix, "window-prefixes")
    wanted = spark.sparkContext.broadcast(_field(prefix))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for first, width, low, s, e, bounds, token, at, doc in _doc_shingles(b.column(1), widths, wanted.value):
                raw = low.tobytes()
                begin = np.maximum(bounds[doc], at - (longest - width))
                end = np.minimum(bounds[doc + 1], at + longest)
                around = [b" ".join([raw[s[i]:e[i]] for i in range(p, q)]) for p, q in zip(begin.tolist(), end.tolist())]
                yield batch(_MET, row=ids[first + doc], width=np.full(len(at), width), token=token, place=at - bounds[doc], before=at - begin, words=around)

    hot = F.broadcast(prefix.filter("parts > 1").groupBy("width", "token").agg(F.max("parts").alias("parts")))  # occurrences / HOT_ROWS at most
    met = rows.select("row", "text").mapInArrow(places, "row long, width int, token long, place long, before int, words binary")
    met = met.join(hot, ["width", "token"], "left").withColumn("part", F.pmod(F.xxhash64("row", "place"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    repeated = prefix.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(listed, "wid")
    begin = F.col("before") - F.col("position")
    there = F.slice(F.split(F.col("words").cast("string"), " "), F.greatest(begin, F.lit(0)) + 1, F.col("size"))
    both = met.join(repeated, ["width", "token", "part"]).filter((begin >= 0) & (F.array_join(there, " ") == F.col("window").cast("string")))
    hits = both.select("row", (F.col("place") - F.col("position")).alias("start"), "size", "window").distinct()
    hits = write_and_read(hits, "window-hits")
    words_hit = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at")).distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("row", "window").distinct().join(found, "window").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for first, data, offsets in pieces(b.column(2)):
                n[first:first + len(offsets) - 1] = np.diff(word_bounds(LOWER[data], offsets, ALNUM)[2])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], names=["row", "doc_id", "n_words"])

    whole = rows.select("row", "doc_id", "text").mapInArrow(sizes, "row long, doc_id long, n_words long").join(words_hit, "row", "left").join(items, "row", "left")
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
