"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` bytes, the last one shorter.
Each passage is measured (how often one class of characters follows another,
word lengths, words that repeat near by) and encoded by a learned layer. Gated
attention, tanh(V h) * sigmoid(U h), weighs the passages; the weighted sum of
their codes is scored. Encoder, gates and scorer are learned together from
document labels, in numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import LOWER, PIECE_BYTES, SPACED, pieces, span_hashes, word_bounds
from semdrift.llm.common import Adam, fitted, fresh, labelled_sample, pack_arrays, sigmoid, unpack_arrays
from semdrift.session import ship_package

PASSAGE = 512
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 3_000
#: Passages of a training document that are used, at most, evenly spaced.
TRAIN_PASSAGES = 64
CODE, GATE = 24, 12
EPOCHS, BAGS, RATE, DECAY = 25, 64, 3e-3, 1e-4
#: Training steps, at least, however few documents there are.
LEAST_STEPS = 300
LAGS = 8


def _classes() -> np.ndarray:
    """One of 16 classes for each byte."""
    c = np.full(256, 15, np.uint8)  # other signs
    for k, members in enumerate((b" \t", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                                 b".", b",;:", b"!", b"?", b"'\"`", b"()[]{}", b"<>=/\\", b"-_")):
        c[list(members)] = k
    c[128:192] = 13
    c[192:] = 14
    return c


CLASS = _classes()
EXTRA = 6
WIDTH = 256 + EXTRA


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, passages before each document); an empty text is one empty passage."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // PASSAGE))
    before = np.concatenate([[0], np.cumsum(count)])
    n = int(before[-1])
    doc = np.repeat(np.arange(len(sizes)), count)
    begin = offsets[doc] + (np.arange(n) - before[doc]) * PASSAGE
    end = np.minimum(begin + PASSAGE, offsets[doc + 1])
    length = end - begin
    out = np.zeros((n, WIDTH), np.float32)
    if len(data):
        of = np.repeat(np.arange(n), length)
        kind = CLASS[data].astype(np.int64)
        pair = kind.copy()
        pair[1:] += 16 * kind[:-1]
        pair[begin[length > 0]] = kind[begin[length > 0]]  # nothing before a passage counts as a space
        seen = np.bincount(of * 256 + pair, minlength=n * 256).reshape(n, 256)
        out[:, :256] = np.sqrt(seen / np.maximum(1, length)[:, None])
        low = LOWER[data]
        s, e, words_before = word_bounds(low, offsets, SPACED)
        if len(s):
            h, size = span_hashes(low, s, e), (e - s).astype(np.float64)
            in_doc = np.arange(len(s)) - words_before[np.searchsorted(words_before, np.arange(len(s)), side="right") - 1]
            again = np.zeros(len(s), bool)
            for k in range(1, min(LAGS, len(s) - 1) + 1):
                again[k:] |= (h[k:] == h[:-k]) & (in_doc[k:] >= k)
            part = of[s]
            words = np.bincount(part, minlength=n)
            each = np.maximum(1, words)
            mean = np.bincount(part, weights=size, minlength=n) / each
            out[:, 256] = mean / 10
            out[:, 257] = np.sqrt(np.maximum(0, np.bincount(part, weights=size * size, minlength=n) / each - mean * mean)) / 10
            out[:, 258] = np.bincount(part, weights=again, minlength=n) / each
            out[:, 259] = words / 100
    out[:, 260] = length / PASSAGE
    out[:, 261] = length == 0
    return out, before


# ------------------------------------------------------------------ the model


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def some(a: int, b: int) -> np.ndarray:
        return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

    return {
        "W": some(WIDTH, CODE), "b": np.zeros(CODE, np.float32), "V": some(CODE, GATE), "U": some(CODE, GATE),
        "w": some(GATE, 1)[:, 0], "c": some(CODE, 1)[:, 0], "d": np.zeros(1, np.float32),
    }


def forward(m: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(score of each bag before the sigmoid, what the gradient needs)."""
    code = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(code @ m["V"]), sigmoid(code @ m["U"])
    a = (t * g) @ m["w"]
    bag = np.repeat(np.arange(len(before) - 1), np.diff(before))
    a = np.exp(a - np.maximum.reduceat(a, before[:-1])[bag])
    a /= np.add.reduceat(a, before[:-1])[bag]
    z = np.add.reduceat(a[:, None] * code, before[:-1], axis=0)
    return z @ m["c"] + m["d"][0], (code, t, g, a, z, bag)


def gradients(m: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over the bags."""
    logit, (code, t, g, a, z, bag) = forward(m, x, before)
    e = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    dz = e[:, None] * m["c"]
    da = (dz[bag] * code).sum(1)
    ds = a * (da - np.add.reduceat(a * da, before[:-1])[bag])
    dcode = a[:, None] * dz[bag]
    dt, dg = ds[:, None] * m["w"] * g * (1 - t * t), ds[:, None] * m["w"] * t * g * (1 - g)
    dcode += dt @ m["V"].T + dg @ m["U"].T
    dpre = dcode * (1 - code * code)
    return {
        "W": x.T @ dpre + DECAY * m["W"], "b": dpre.sum(0), "V": code.T @ dt, "U": code.T @ dg,
        "w": (t * g).T @ ds, "c": z.T @ e + DECAY * m["c"], "d": e.sum(keepdims=True),
    }


def train(rows: list[tuple[bytes, int]], seed: int = 7) -> bytes:
    """The model as bytes. With one class or none it scores (ones + 1) / (rows + 2) throughout."""
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return pack_arrays({"constant": np.array([(labels.sum() + 1) / (len(rows) + 2)])})
    bags = []
    for t, _ in rows:
        x, _ = passages(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        bags.append(x[np.unique(np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int))] if len(x) > TRAIN_PASSAGES else x)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-2
    bags = [((x - mean) / scale).astype(np.float32) for x in bags]
    rng = np.random.default_rng(seed)
    m = _start(rng)
    weight = {1.0: 0.5 / max(1, labels.sum()), 0.0: 0.5 / max(1, (1 - labels).sum())}
    draw = np.array([weight[v] for v in labels.tolist()])
    adam = Adam(m, RATE)
    steps = max(LEAST_STEPS, EPOCHS * (len(bags) // BAGS))
    for step in range(steps):
        adam.rate = RATE * (1 - step / steps)
        at = rng.choice(len(bags), BAGS, p=draw)  # both classes alike
        before = np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])])
        adam.move(gradients(m, np.concatenate([bags[i] for i in at]), before, labels[at]))
    return pack_arrays(m | {"mean": mean, "scale": scale})


def scores(m: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """The score of every text of an Arrow column; a text longer than a piece is measured in stretches."""
    if "constant" in m:
        return np.full(len(column), float(m["constant"][0]))
    out = np.zeros(len(column))
    for first, data, offsets in pieces(column):
        if len(offsets) == 2 and len(data) > PIECE_BYTES:
            step = PIECE_BYTES // PASSAGE * PASSAGE
            x = np.concatenate([
                passages(data[a:a + step], np.array([0, min(step, len(data) - a)]))[0] for a in range(0, len(data), step)])
            before = np.array([0, len(x)])
        else:
            x, before = passages(data, offsets)
        x -= m["mean"].astype(np.float32)
        x /= m["scale"].astype(np.float32)
        logit, _ = forward(m, x, before)
        out[first:first + len(before) - 1] = sigmoid(logit.astype(np.float64))
    return out


# ------------------------------------------------------------------ Spark stages


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS, label: str = "quality") -> bytes:
    """A model learned from at most ``per_class`` labelled documents of either class among those ``keep`` allows."""
    ship_package(docs.sparkSession)
    return fitted(labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, per_class), train)


def score(docs: DataFrame, model: bytes, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a double column ``name`` in 0 to 1, higher for better documents.

    All rows and columns stay. Whole texts are scored; an empty or null text
    is one empty passage, so it has a score too. Equal texts get equal
    scores, wherever and however often they stand.
    """
    ship_package(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack_arrays(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores(m, b.column(at)))], names=[*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(add, f"{fields}, `{name}` double" if fields else f"`{name}` double")


def good_documents(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, unchanged."""
    name = fresh(docs, "score")
    return score(docs, model, name).filter(F.col(name) >= threshold).drop(name)
