"""What the operators of this subpackage share: tables, column names, kernels on Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until it clashes with no column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], type=f.type) for f in schema],
        schema=schema,
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled documents of either class.

    The ids with the smallest hashes are taken among those that ``keep`` (a
    condition on ``doc_id``) allows, so the sample is the same at every
    layout. Rows without label or id are left out; a repeated label row
    counts once, the larger label holding. Only ids are sorted; their
    list (2 * per_class rows at most) is broadcast, and whole texts follow.
    """
    marked = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .filter(keep)
    )
    drawn = None
    for value in (0, 1):
        some = marked.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id")


MODEL = pa.schema([("model", pa.binary())])


def fitted(sample: DataFrame, train: Callable[[list[tuple[bytes, int]]], bytes]) -> bytes:
    """The model that ``train`` makes of the bounded ``sample`` (doc_id, text, label), fitted in one task.

    Rows are handed over in the order of their ids, so a retry gives the same model.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (d, t or b"", y)
            for b in batches
            for d, t, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist())
        ]
        rows.sort()
        yield batch(MODEL, model=[train([(t, y) for _, t, y in rows])])

    found = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(once, "model binary").collect()
    return bytes(found[0]["model"]) if found else train([])


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack_arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as held:
        return {k: held[k] for k in held.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam over named arrays; a gradient given with rows moves those rows only."""

    def __init__(self, arrays: dict[str, np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.step = arrays, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in arrays.items()}
        self.v = {k: np.zeros_like(v) for k, v in arrays.items()}

    def move(self, grads: dict[str, np.ndarray], rows: dict[str, np.ndarray] | None = None) -> None:
        self.step += 1
        rate = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            at = (rows or {}).get(k, slice(None))
            m = 0.9 * self.m[k][at] + 0.1 * g
            v = 0.999 * self.v[k][at] + 0.001 * g * g
            self.m[k][at], self.v[k][at] = m, v
            self.arrays[k][at] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
