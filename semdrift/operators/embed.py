"""Texts to vectors, content hashes and the incremental vector store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semdrift.functions import text as X
from semdrift.functions.arrow import from_matrix
from semdrift.functions.vectors import unit
from semdrift.operators.reduce import Scaler, moments
from semdrift.operators.skew import latest_per_key
from semdrift.session import write_and_read


def long_enough(text: Column, min_chars: int = 50) -> Column:
    return F.length(text) > min_chars


def word_code(word: str) -> int:
    """The first nine hex digits of the md5: eight for the bucket, one for the sign."""
    return int(hashlib.md5(word.encode()).hexdigest()[:9], 16)


def _buckets(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and sign of every word of a batch; each distinct word is hashed once."""
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
    words = lists.flatten().dictionary_encode()
    codes = np.array([word_code(w) if w else -1 for w in words.dictionary.to_pylist()], dtype=np.int64)
    code = codes[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    real = code >= 0
    row, code = row[real], code[real]
    return row, (code >> 4) % dim, 1.0 - 2.0 * (code & 1)


def hash_embedding(text: Column, dim: int = 384, weights: np.ndarray | None = None,
                   min_chars: int | None = None) -> Column:
    """Signed feature hashing of the words of a cleaned text to a unit vector.

    Runs batch by batch next to the scan: nothing is shuffled. Texts of up to
    ``min_chars`` characters give NULL; gating here rather than by a filter on
    the text keeps Catalyst from cleaning every text twice, once for the
    filter pushed below the projection and once for the vector.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def pooled(texts: pa.Array) -> pa.Array:
        row, bucket, sign = _buckets(texts, dim)
        sums = np.bincount(row * dim + bucket, weights=sign, minlength=len(texts) * dim).reshape(len(texts), dim)
        if weights is not None:
            sums = sums * weights
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        out = from_matrix(sums / np.where(size > 0, size, 1.0), pa.float32())
        if min_chars is None:
            return out
        long = pc.fill_null(pc.greater(pc.utf8_length(texts), min_chars), False)
        return pc.if_else(long, out, pa.scalar(None, out.type))

    return pooled.asNondeterministic()(text)  # a filter on the result must not run it again


def bucket_weights(documents: DataFrame, dim: int, text: str = "text") -> np.ndarray:
    """Inverse document frequency per bucket: ``dim`` numbers from one row per task."""

    def count(batches):
        seen, total = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            row, bucket, _ = _buckets(batch.column(0), dim)
            seen += np.bincount(np.unique(row * dim + bucket) % dim, minlength=dim)
            total += batch.num_rows
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(range(dim + 1), pa.int32()), "n": pa.array([*seen.tolist(), total], pa.int64())
        })

    counts = documents.select(text).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    by_bucket = {r["bucket"]: r["n"] for r in counts.collect()}  # dim + 1 rows
    total = by_bucket.get(dim, 0)
    return np.log((total + 1.0) / (np.array([by_bucket.get(b, 0) for b in range(dim)]) + 1.0)) + 1.0


def embed_documents(documents: DataFrame, key: str, dim: int = 384, text: str = "text", min_chars: int = 50,
                    max_chars: int | None = None, weights: np.ndarray | None = None) -> DataFrame:
    """(key, content_md5, embedding) of every text longer than ``min_chars``."""
    if max_chars is not None and max_chars <= min_chars:
        raise ValueError("the cut must leave more than the gate")
    vectors = documents.select(
        key,
        F.md5(F.col(text)).alias("content_md5"),
        hash_embedding(X.truncate(F.col(text), max_chars), dim, weights, min_chars).alias("embedding"),
    )
    return vectors.filter("embedding IS NOT NULL")


def encode_with_model(documents: DataFrame, key: str, make_model: Callable[[], Callable], batch_size: int = 32,
                      text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Plug-in encoder: ``make_model`` runs once per worker and returns texts -> float32 matrix."""
    encode = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return documents.select(key, encode(X.truncate(F.col(text), max_chars)).alias("embedding"))


def ngram_model(dim: int = 64, size: int = 3) -> Callable[[], Callable]:
    """A weightless encoder for the plug-in point: hashed character n-grams, unit length."""

    def make_model():
        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for i, text in enumerate(texts):
                codes = np.frombuffer(str(text).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
                if len(codes) < size:
                    continue
                mixed = np.zeros(len(codes) - size + 1, dtype=np.uint64)
                for j in range(size):
                    mixed = mixed * np.uint64(1_000_003) + codes[j : len(codes) - size + 1 + j]
                mixed ^= mixed >> np.uint64(17)
                out[i] = np.bincount((mixed % np.uint64(dim)).astype(np.int64), minlength=dim)
                out[i] /= np.linalg.norm(out[i])
            return out

        return encode

    return make_model


def word_model(dim: int = 384) -> Callable[[], Callable]:
    """The hashed word vectors of :func:`hash_embedding` as a plug-in encoder; a word is hashed once per batch."""

    def make_model():
        def encode(texts: np.ndarray) -> np.ndarray:
            split = [str(t).split(" ") for t in texts]
            code = {w: word_code(w) for words in split for w in words if w}
            out = np.zeros((len(texts), dim))
            for row, words in zip(out, split):
                found = np.array([code[w] for w in words if w], dtype=np.int64)
                np.add.at(row, (found >> 4) % dim, 1 - 2 * (found & 1))
            size = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(size > 0, size, 1.0)).astype(np.float32)

        return encode

    return make_model


def learned_embedding(documents: DataFrame, key: str, words: Column, dim: int, features: int = 1024) -> DataFrame:
    """Corpus-trained vectors: hashed term counts, inverse document frequency, principal axes about the mean.

    Every model part is bounded by ``features``, whatever the vocabulary.
    """
    counted = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features).transform(
        documents.select(key, words.alias("_words"))
    )
    counted = write_and_read(counted.select(key, "_tf"), "term-counts")  # read by three passes, as sparse vectors
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counted).transform(counted)
    level = Normalizer(p=2.0, inputCol="_idf", outputCol="_unit").transform(weighted)
    rows = level.select(key, vector_to_array("_unit").alias("_unit"))
    found = moments(rows, "_unit")
    centre = Scaler(found.mean, np.ones(features), found.n)
    scored = rows.select(key, found.axes(dim).project(F.col("_unit"), scaler=centre).alias("_pc"))
    return scored.select(key, unit(F.col("_pc")).cast("array<float>").alias("embedding"))


def mean_pool(token_vectors: DataFrame, group: str, vector: str = "embedding", mask: str = "mask") -> DataFrame:
    """Mask-weighted mean of the vectors of each group, scaled to unit length.

    The sums are combined on the map side, so a large group costs one vector
    per task. A group without any kept vector pools to zeros.
    """
    kept = token_vectors.select(
        group, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"), F.col(mask).cast("double").alias("_w")
    )
    pooled = kept.groupBy(group).agg(
        Summarizer.sum(F.col("_v"), F.col("_w")).alias("_s"), F.sum("_w").alias("_n")
    )
    mean = F.transform(vector_to_array("_s"), lambda x: x / F.greatest(F.col("_n"), F.lit(1e-9)))
    return pooled.select(group, unit(mean).alias("embedding"))


def content_hash(text: Column) -> Column:
    return F.md5(text)


def store_diff(current: DataFrame, stored: DataFrame, key: str = "filename") -> DataFrame:
    """(key, state) with state new, changed, removed or same; both sides hold one row per key."""
    cur = current.select(key, F.col("content_md5").alias("_now"))
    old = stored.select(key, F.col("content_md5").alias("_was"))
    state = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_now").isNull(), "removed")
        .when(F.col("_now") != F.col("_was"), "changed")
        .otherwise("same")
    )
    return cur.join(old, key, "full_outer").select(key, state.alias("state"))


def store_is_valid(current: DataFrame, stored: DataFrame, key: str = "filename") -> DataFrame:
    """One row: whether the stored (key, hash) set equals the current one, and the counts behind it."""
    states = store_diff(current, stored, key)
    counted = [F.count_if(F.col("state") == s).alias(s) for s in ("same", "new", "changed", "removed")]
    return states.agg(*counted).withColumn("valid", F.col("new") + F.col("changed") + F.col("removed") == 0)


def pending(current: DataFrame, stored: DataFrame, key: str = "filename", force: bool = False) -> DataFrame:
    """Documents that must be encoded: those whose (key, hash) is not stored."""
    return current if force else current.join(stored.select(key, "content_md5"), [key, "content_md5"], "left_anti")


def survivors(current: DataFrame, stored: DataFrame, key: str = "filename") -> DataFrame:
    """Stored vectors that are still right."""
    return stored.join(current.select(key, "content_md5"), [key, "content_md5"], "left_semi")


def refresh_store(current: DataFrame, stored: DataFrame | None, encode: Callable[[DataFrame], DataFrame],
                  key: str = "filename", force: bool = False) -> DataFrame:
    """New store: encoded pending documents next to the surviving vectors."""
    if stored is None or force:
        return encode(current)
    return survivors(current, stored, key).unionByName(encode(pending(current, stored, key)))


def unique_documents(documents: DataFrame, key: str, order: list[str]) -> DataFrame:
    return latest_per_key(documents, key, order)
