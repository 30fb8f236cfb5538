"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values
of all word shingles. Two fingerprints link when they differ in at most
``RADIUS`` bits. Bit i carries a vector phi(i) of RADIUS + 1 bits; table v (any
vector but zero) keeps the bits whose phi(i) has an odd product with v. Any
RADIUS vectors leave a v that is orthogonal to all of them, so a pair within
the radius agrees on all kept bits of some table: it meets there for certain.

Links inside a bucket are looked for between different components only. First
every fingerprint is compared with the smallest and the largest of its bucket,
which joins crowds of near copies with a link for each; buckets that then hold
one component are done. What remains is compared block against block, so a
crowded bucket is spread over many tasks and only links that join two
components leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import LOWER, pieces
from semdrift.llm.common import batch
from semdrift.operators.components import connected_components
from semdrift.session import ship_package, write_and_read

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK_ROWS = 2048
#: Shingles hashed at once for one document.
STEP = 1 << 16

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


# ------------------------------------------------------------------ fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text whose A-Z are lower-cased already."""
    words = text.split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    width = min(shingle, n)
    stops = (ends[width - 1:] - 1).tolist()
    starts = [0, *ends[: n - width].tolist()]
    ones, total = np.zeros(64, np.int64), len(stops)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, STEP):
        to = min(at + STEP, total)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to], stops[at:to])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fingerprints as signed 64-bit numbers, computed where the texts are read."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for _, data, offsets in pieces(b.column(1)):
                low = LOWER[data].tobytes()
                bounds = offsets.tolist()
                found += [fingerprint(low[s:e], shingle) for s, e in zip(bounds, bounds[1:])]
            yield batch(_PRINTS, doc_id=b.column(0).cast(pa.int64()), fp=np.array(found, np.uint64).view(np.int64))

    ship_package(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(hashed, "doc_id long, fp long")


# ------------------------------------------------------------------ covering tables


def masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of the 2^(radius+1) - 1 tables; phi runs evenly through all vectors but zero."""
    vectors = (1 << (radius + 1)) - 1
    phi = [i % vectors + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (phi[i] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(prints: DataFrame, radius: int) -> DataFrame:
    """(t, key, fp) of every fingerprint in every table."""
    kept = F.array(*[F.lit(_signed(m)) for m in masks(radius)])
    return prints.select("fp", F.posexplode(kept).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


# ------------------------------------------------------------------ links inside buckets


def _spanning(fps: np.ndarray, other: np.ndarray, comp: np.ndarray, comp_other: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join different components, one for each pair of components."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for at in range(0, len(fps), 512):
        part = fps[at:at + 512]
        near = np.bitwise_count(part[:, None] ^ other[None, :]) <= radius
        near &= comp[at:at + 512][:, None] != comp_other[None, :]
        i, j = np.nonzero(near)
        for a, b, c, d in zip(part[i].tolist(), other[j].tolist(), comp[at + i].tolist(), comp_other[j].tolist()):
            out.setdefault((min(c, d), max(c, d)), (a, b))
    return list(out.values())


def _met(radius: int):
    """Kernel over rows (group, side, fp, comp) sorted by group: side 0 meets itself and side 1; carries open groups on."""

    def close(rows: list[np.ndarray]) -> tuple[list[int], list[int]]:
        side, fp, comp = (np.concatenate([r[k] for r in rows]) for k in (1, 2, 3))
        own, guest = side != 1, side == 1
        if guest.any():
            links = _spanning(fp[own].view(np.uint64), fp[guest].view(np.uint64), comp[own], comp[guest], radius)
        else:
            links = _spanning(fp.view(np.uint64), fp.view(np.uint64), comp, comp, radius)
        u, v = (np.array([x[k] for x in links], np.uint64).view(np.int64).tolist() for k in (0, 1))
        return u, v

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None
        for b in batches:
            group, side, fp, comp = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges = [0, *(np.flatnonzero(np.any([group[1:] != group[:-1]], axis=0)) + 1).tolist(), len(group)]
            us, vs = [], []
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                if now is not None and group[s] != now:
                    u, v = close(held)
                    us += u
                    vs += v
                    held = []
                now = group[s]
                held.append((group[s:e], side[s:e], fp[s:e], comp[s:e]))
            yield batch(_LINKS, u=us, v=vs)
        if held:
            u, v = close(held)
            yield batch(_LINKS, u=u, v=v)

    return kernel


def _rest_links(rest: DataFrame, radius: int, block: int) -> DataFrame:
    """(u, v) of the links between components inside the buckets of ``rest`` (t, key, fp, comp, rows)."""
    blocks = F.ceil(F.col("rows") / F.lit(block)).cast("int")
    placed = rest.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int"))
    # Block i meets the blocks after it and, as a pair of its own, itself.
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.withColumn("with", partner).select(
        F.xxhash64("t", "key", F.least("own", "with"), F.greatest("own", "with")).alias("group"),
        F.when(F.col("own") > F.col("with"), 1).otherwise(0).alias("side"), "fp", "comp")
    spread = paired.repartition("group").sortWithinPartitions("group", "side", "fp")
    return spread.mapInArrow(_met(radius), "u long, v long")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK_ROWS) -> DataFrame:
    """(id, root) for every fingerprint (column ``fp``, each once) that links with another.

    Tables with a row per bucket meet the fingerprints in merge joins: Spark sizes exploded
    rows by those before, 31 times too low, and would broadcast the buckets through the driver.
    """
    keyed = _keyed(prints, radius)
    crowds = keyed.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high")
    members = write_and_read(keyed.join(crowds.hint("merge"), ["t", "key"]), "buckets")
    ends = [
        members.filter((_distance("fp", end) <= radius) & (F.col("fp") != F.col(end))).select(
            F.col("fp").alias("u"), F.col(end).alias("v"))
        for end in ("low", "high")
    ]
    links = write_and_read(ends[0].unionByName(ends[1]).distinct(), "links")
    comps = write_and_read(connected_components(links), "comps")
    named = members.join(comps.withColumnRenamed("id", "fp"), "fp", "left").select(
        "t", "key", "fp", F.coalesce("root", "fp").alias("comp"))
    named = write_and_read(named, "named")
    open_ = named.groupBy("t", "key").agg(
        F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("rows")).filter("a < b").drop("a", "b")
    rest = named.join(open_.hint("merge"), ["t", "key"])
    more = write_and_read(_rest_links(rest, radius, block).distinct(), "links")
    return connected_components(links.unionByName(more))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK_ROWS,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row per row of ``docs``.

    ``fingerprint`` has 16 lower-case hex digits; a text without words, or a
    null text, has the fingerprint zero and links like any other.
    ``component_id`` is the smallest id that links reach, the own one
    included; a null id is never the smallest. Equal fingerprints are one
    node, so exact copies, ties and repeated rows cost nothing beyond their
    own row. An empty table gives an empty result.
    """
    prints = write_and_read(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = fingerprint_links(nodes.select("fp"), radius, block)
    named = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = write_and_read(named, "rooted")
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(firsts, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
