"""Importance resampling towards a target distribution of hashed word runs, by bit-sliced sums.

Features of a text are its runs of one to three words; each falls into one of
``BUCKETS`` buckets by crc32. A bucket's gain says, in thousandths of a natural
logarithm, how much likelier the target is to hold it than the source. The
weight of a document is the sum of the gains of its features.

That sum is taken over bit planes. The counts of a document become planes of
``BUCKETS`` bits (plane i holds bit i of every count), the gains become planes
in two's complement, and

    weight = sum over i, j of 2^i * w_j * popcount(count plane i AND gain plane j)

with w_j = 2^j, negative for the sign plane: whole numbers throughout, so the
weight is exact.

Texts are read twice, once to count the buckets and once to weigh, and are
never shuffled. Only bucket sums (``BUCKETS`` rows) reach the driver. A sample
is drawn by score: the rank comes from range partitions, not from one sorted
task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import ALNUM, LOWER
from semdrift.llm.common import batch
from semdrift.operators.skew import number_rows
from semdrift.session import write_and_read

BUCKETS = 10_000
LONGEST_RUN = 3
MIN_WORDS = 20
SHARE = 5
SEED = 42
#: Documents whose counts are held as a table of counts at a time, and bytes of one text split into words at a time.
ROWS, PIECE = 64, 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWERED = LOWER.tobytes()


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each piece of about ``PIECE`` bytes; no word is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and ALNUM[text[end]]:
            nearest = min(len(text), end + 64)
            stop = np.flatnonzero(~ALNUM[np.frombuffer(text[end:nearest], np.uint8)])
            end = end + int(stop[0]) if len(stop) else nearest
        yield _WORD.findall(text[at:end])
        at = end


def bucket_runs(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end there) for each piece of a text.

    The crc of a run goes on from the crc of the run without its last word.
    """
    held: list[list[int]] = [[] for _ in range(LONGEST_RUN - 1)]  # crcs of the runs that end at the last word, by length
    for words in _words(text.translate(_LOWERED)):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        found = [list(map(crc32, words))]
        for n in range(1, LONGEST_RUN):
            # A run of n + 1 words at a word is the run of n words at the word before, carried on.
            before = held[n - 1] + found[n - 1]
            found.append(list(map(crc32, spaced[len(words) + 1 - len(before):], before)))
        held = [(held[n] + found[n])[-1:] for n in range(LONGEST_RUN - 1)]
        yield len(words), np.concatenate([np.array(x, dtype=np.int64) for x in found]) % BUCKETS


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all rows. A task sends one row for each bucket it has met."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for raw in _texts(b.column(0)):
                for _, buckets in bucket_runs(raw):
                    total += np.bincount(buckets, minlength=BUCKETS)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    rows = (
        docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    found = rows.toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return np.array(
        [math.floor(1000 * math.log((float(t + 1) * all_source) / (float(s + 1) * all_target))) for s, t in zip(source.tolist(), target.tolist())],
        dtype=np.int64,
    )


def _planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes of the lowest ``bits`` bits of each row of ``values``, as (rows, bits, 64-bit words); the rest of the last word is 0."""
    rows, size = values.shape
    out = np.zeros((rows, bits, -(-size // 64) * 8), np.uint8)
    for i in range(bits):
        out[:, i, :-(-size // 8)] = np.packbits(((values >> i) & 1).astype(np.uint8), axis=1)
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, weights of the planes) of signed gains in two's complement; the last plane is the sign."""
    bits = int(np.abs(gain).max(initial=0)).bit_length() + 1
    weight = np.int64(1) << np.arange(bits, dtype=np.int64)
    weight[-1] = -weight[-1]
    return _planes(gain[None, :], bits)[0], weight


def weigh(counts: np.ndarray, planes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sum of gain times count for each row of ``counts``, from bit planes."""
    total = np.zeros(len(counts), np.int64)
    bits = int(counts.max(initial=0)).bit_length()
    sliced = _planes(counts, bits)
    for i in range(bits):
        common = np.bitwise_count(sliced[:, i, None, :] & planes[None, :, :]).sum(axis=2, dtype=np.int64)
        total += (common @ weight) << i
    return total


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandths of a standard Gumbel draw that depends on the id alone; a null id counts as empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row. A null text has no words."""
    planes, weight = gain_planes(gain)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.slice(at, ROWS)
                counts, n_words = np.zeros((len(b), BUCKETS), np.int64), np.zeros(len(b), np.int64)
                for row, raw in enumerate(_texts(b.column(1))):
                    for words, buckets in bucket_runs(raw):
                        n_words[row] += words
                        counts[row] += np.bincount(buckets, minlength=BUCKETS)
                weights, ids = weigh(counts, planes, weight), b.column(0).to_pylist()
                yield batch(
                    SCORED, doc_id=ids, n_words=n_words, n_features=counts.sum(axis=1), weight=weights,
                    score=weights + np.array([noise(x, seed) for x in ids], np.int64),
                )

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``.

    ``share`` per cent, rounded down, of the rows with at least ``min_words``
    words are drawn: those of the highest scores, ties to the smaller id. They
    have their place as rank, the others null. Rows without text weigh 0 and
    are never drawn; rows without id are, after those with one at equal scores; repeated
    rows are rows of their own and take ranks side by side. An empty target
    table still gives gains (those of the smoothing). Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    rows = scored(docs, gain, seed, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    rows = write_and_read(rows, "resample-scores")
    long_enough = rows.filter(F.col("n_words") >= min_words)
    drawn = long_enough.count() * share // 100
    # ``row`` was written, so equal scores and ids still have one order, which no retry changes.
    ranked = number_rows(long_enough, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
