"""How document filters interact, for every order of them, by a stream with retractions.

Five filters: A fewer than 50 words; B fewer than 65 distinct words in 100; C
more than 5 A-Z in 100 code points; D any of ``#$%&*|``; E the text equals that
of a smaller id, anywhere in the table. A document's failures are a mask of
five bits, and every figure of the report follows from the number of documents
of each part and mask. A to D depend on the text alone. E depends on what has
landed: the holder of the smallest id passes, and becomes a failure when a
smaller id arrives later.

So all files are processed as micro-batches of a stream that ends when what
was there at the start is done. Texts become digests and masks beside the scan and are not
shuffled. Each task first settles its own copies: of equal texts only those with the task's least
id go on, the others fail E whatever comes, and are merely counted; so a text of very many copies
leaves one row for each task. The state, a table keyed by digest, holds the least id of every text so far
with the masks of its rows. A micro-batch meets it in one shuffle by digest. Where a
smaller id arrives, the counts of the former holders are retracted (-n without E, +n with E).

A micro-batch leaves two folders of its number, the state after it and its
counter changes, written over when the batch is retried. The sum of all
changes is the truth at any time. State in tables, not in a state store: a
store holds its keys in the memory of executors, or (RocksDB) native memory of
every partition, which was measured beyond 3 GB for 211 partitions.

Two texts are equal when their SHA-256 digests are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.llm.common import batch
from semdrift.session import scratch_path, write_and_read

FILTERS = "ABCDE"
A, B, C, D, E = (1 << i for i in range(5))
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
ODD = b"#$%&*|"
CAPITALS, CONTINUED = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
PIECE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")

#: Micro-batches that the files present at the start are dealt to, at most.
BATCHES = 4
#: Tasks that the rows of one id, or of none, are spread over when they meet the labels.
SALTS = 16


# --------------------------------------------------------------------------- masks


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about ``PIECE`` bytes that cut no word."""
    at = 0
    while at < len(text):
        gap = _WHITE.search(text, min(len(text), at + PIECE))
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def failures(text: bytes) -> int:
    """The mask of what the text itself fails (A to D)."""
    words, distinct, odd, capitals = 0, set(), False, 0
    for piece in _pieces(text):
        found = piece.split()  # at ASCII white space, as these are bytes
        words += len(found)
        distinct.update(found)
        capitals += len(piece) - len(piece.translate(None, CAPITALS))
        odd = odd or len(piece) != len(piece.translate(None, ODD))
    points = len(text) if text.isascii() else len(text.translate(None, CONTINUED))
    return (
        A * (words < MIN_WORDS) + B * (100 * len(distinct) < DISTINCT_SHARE * words)
        + C * (100 * capitals > CAPITAL_SHARE * points) + D * odd
    )


MARKED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("mask", pa.int32()), ("n", pa.int64())])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is needed of each row; rows of a batch that repeat are one with their number."""
    for b in batches:
        rows: Counter = Counter()
        for doc_id, part, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.large_binary())):
            raw = value.as_py() or b""
            rows[doc_id, part, hashlib.sha256(raw).digest(), failures(raw)] += 1
        if rows:
            yield batch(MARKED, **dict(zip(MARKED.names, (*zip(*rows), list(rows.values())))))


# --------------------------------------------------------------------------- counter changes

CHANGE_COLUMNS = "part string, mask int, good boolean, toxic boolean, delta long"
#: Rows of one text and id; without a digest, counts that are settled already (the mask has E where it was failed).
ENTERED = pa.schema([
    ("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.bool_()),
    ("toxic", pa.bool_()), ("n", pa.int64()),
])
ENTERED_COLUMNS = "digest binary, doc_id long, part string, mask int, good boolean, toxic boolean, n long"
KIND = ["part", "mask", "good", "toxic"]

#: What one text holds: the least id, and its rows by (part, mask, good, toxic).
Holder = tuple[int, Counter]


def meet(held: dict[bytes, Holder], digest: bytes, doc_id: int, kind: tuple, n: int, failed: Counter) -> None:
    """Enter rows of one text and id; ``failed`` counts those that a smaller id of the same text is known for."""
    least, holders = held.get(digest, (None, None))
    if least is None or doc_id < least:
        if holders:
            failed.update(holders)
        held[digest] = (doc_id, Counter({kind: n}))
    elif doc_id == least:
        holders[kind] += n
    else:
        failed[kind] += n


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: the rows of the least id of each text, and counts of those that are settled whatever else there is."""
    held: dict[bytes, Holder] = {}
    failed: Counter = Counter()
    without_id: Counter = Counter()
    for b in batches:
        for doc_id, digest, n, *kind in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "n", *KIND))):
            if doc_id is None:  # smaller than no id, and none is smaller
                without_id[tuple(kind)] += n
            else:
                meet(held, digest, doc_id, tuple(kind), n, failed)
    rows = [(digest, doc_id, *kind, n) for digest, (doc_id, holders) in held.items() for kind, n in holders.items()]
    rows += [(None, None, part, mask | E, *rest, n) for (part, mask, *rest), n in failed.items()]
    rows += [(None, None, *kind, n) for kind, n in without_id.items()]
    for at in range(0, len(rows), 1 << 16):
        yield batch(ENTERED, **dict(zip(ENTERED.names, zip(*rows[at:at + (1 << 16)]))))


def move_state(state: DataFrame, entered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the state after ``entered``, the counter changes): both with the columns of their tables."""
    both = state.withColumn("old", F.lit(True)).unionByName(entered.filter("digest IS NOT NULL").withColumn("old", F.lit(False)))
    least = F.min("doc_id").over(Window.partitionBy("digest"))
    met = write_and_read(both.withColumn("holds", F.col("doc_id") == least), "audit-met")
    after = met.filter("holds").groupBy("digest", "doc_id", *KIND).agg(F.sum("n").alias("n"))
    failing = F.col("mask").bitwiseOR(F.lit(E))
    settled = entered.filter("digest IS NULL").select(*KIND, F.col("n").alias("delta"))
    arrived = met.filter("NOT old").select("part", F.when(F.col("holds"), F.col("mask")).otherwise(failing).alias("mask"), "good", "toxic", F.col("n").alias("delta"))
    former = met.filter("old AND NOT holds")
    retracted = former.select(*KIND, (-F.col("n")).alias("delta"))
    failed = former.select("part", failing.alias("mask"), "good", "toxic", F.col("n").alias("delta"))
    changes = settled.unionByName(arrived).unionByName(retracted).unionByName(failed)
    return after, changes.groupBy(*KIND).agg(F.sum("delta").alias("delta"))


def judge(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """``marked`` with what the labels say of each row.

    A merge join: Spark sizes the labels, repeated for each salt, by the rows
    before, and would broadcast them through the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality") == 1, F.col("toxic") == 1).toDF("doc_id", "good", "toxic")
    known = known.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    known = write_and_read(known, "audit-labels").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("long"))
    return marked.join(known.hint("merge"), ["doc_id", "salt"], "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )


def stream_changes(
    spark: SparkSession, path: str, labels: DataFrame, target: str, checkpoint: str, files_per_batch: int,
    doc_id: str = "doc_id", part: str = "source", text: str = "text",
) -> None:
    """Process what has landed at ``path`` since the last call; state and counter changes are kept below ``target``.

    ``checkpoint`` holds the progress; a call with the same three places goes
    on where the last one ended, also after a failure.
    """
    # A stream takes a single file only by a pattern; this one matches the path alone.
    path = path.rstrip("/")
    landed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    landed = landed.parquet(f"{path[:-1]}[{path[-1]}]")
    marked = landed.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").alias("text"),
    ).mapInArrow(_marked, "doc_id long, part string, digest binary, mask int, n long")
    judged = judge(marked, labels)

    def sink(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{target}/entered/batch={batch_id}")
        entered = session.read.schema(ENTERED_COLUMNS).parquet(f"{target}/entered/batch={batch_id}")
        empty = session.createDataFrame([], ENTERED_COLUMNS)
        before = session.read.schema(ENTERED_COLUMNS).parquet(f"{target}/state/batch={batch_id - 1}") if batch_id else empty
        after, changes = move_state(before, entered)
        after.write.mode("overwrite").parquet(f"{target}/state/batch={batch_id}")
        changes.write.mode("overwrite").parquet(f"{target}/changes/batch={batch_id}")

    judged.mapInArrow(_settled, ENTERED_COLUMNS).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def counters(spark: SparkSession, target: str) -> DataFrame:
    """(part, mask, good, toxic, n): the documents of each kind after all micro-batches so far."""
    parts = spark.read.schema(f"{CHANGE_COLUMNS}, batch long").parquet(f"{target}/changes")
    return parts.groupBy(*KIND).agg(F.sum("delta").alias("n")).filter(F.col("n") != 0)


# --------------------------------------------------------------------------- report

ORDERS = ["".join(p) for p in permutations(FILTERS)]
REPORT = pa.schema([
    ("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
    *((c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
])


def _picks() -> dict[str, np.ndarray]:
    """For each row of the report (order, step), which of the 32 masks count."""
    masks = np.arange(32)
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails")}
    for order in ORDERS:
        earlier = 0
        for letter in order:
            own = 1 << FILTERS.index(letter)
            fails, gone = masks & own > 0, masks & earlier > 0
            out["kept"].append(~fails & ~gone)
            out["removed"].append(fails & ~gone)
            out["redundant"].append(fails & gone)
            out["unique_fails"].append(masks == own)
            earlier |= own
    return {c: np.array(rows, dtype=np.int64) for c, rows in out.items()}


def report(counts: DataFrame) -> DataFrame:
    """The rows of :func:`filter_audit` from (part, mask, good, toxic, n); a part has at most 128 of these."""
    kinds = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("kinds"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = _picks()
        orders = [o for o in ORDERS for _ in FILTERS]
        filters = np.array([FILTERS.index(letter) for o in ORDERS for letter in o])
        steps = np.tile(np.arange(1, 6), len(ORDERS))
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, good, toxic = (np.zeros(32, np.int64) for _ in range(3))
                for kind in found:
                    n[kind["mask"]] += kind["n"]
                    good[kind["mask"]] += kind["n"] * kind["good"]
                    toxic[kind["mask"]] += kind["n"] * kind["toxic"]
                removed = picks["removed"] @ n
                shapley = np.zeros(len(FILTERS), np.int64)
                np.add.at(shapley, filters, removed)
                yield batch(
                    REPORT, part=[part] * len(orders), filter_order=orders, step=steps, **{c: p @ n for c, p in picks.items()},
                    good_lost=picks["removed"] @ good, toxic_lost=picks["removed"] @ toxic, shapley=shapley[filters],
                )

    return kinds.mapInArrow(
        rows, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
        "good_lost long, toxic_lost long, shapley long"
    )


def filter_audit(
    spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, doc_id: str = "doc_id", part: str = "source", text: str = "text"
) -> DataFrame:
    """A row for each part, order of the five filters and step, from the Parquet files at ``path`` (one file or a folder).

    Long counts of the part's documents: kept after the step, removed by its
    filter, redundant (failing it, removed earlier), unique_fails (failing it
    alone), good_lost and toxic_lost (removed, ``labels`` quality or toxic 1;
    of a repeated label row the larger value holds), shapley (removed by this
    filter, summed over all orders). A null text is empty, a null part the
    empty string. Rows that repeat, id and text, count each and pass or fail E
    together; rows without id neither fail E nor make others fail. An empty
    table has no parts, hence no rows. Other columns are not read. ``batches``
    bounds the number of micro-batches.
    """
    stored = spark.read.parquet(path)
    files = len(stored.inputFiles())
    if not files:
        return report(spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean, n long"))
    target, checkpoint = scratch_path(spark, "audit-tables"), scratch_path(spark, "audit-stream")
    stream_changes(spark, path, labels, target, checkpoint, max(1, -(-files // batches)), doc_id, part, text)
    return report(counters(spark, target))
