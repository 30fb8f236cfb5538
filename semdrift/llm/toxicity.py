"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as words; windows of ``WINDOW`` words, each half over the next,
are all scored, and the text scores as its most toxic window. A word enters as
a learned vector of the word itself (hashed) beside the mean of learned vectors
of its character sequences (hashed, with marks at either end), so that unseen
words are read by their letters. Two gated recurrent units run over the window
in either direction; additive attention pools their states. Learned in numpy
with back-propagation through time on a bounded sample of labelled documents:
each step trains the currently most toxic window of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import LOWER, SPACED, mixed, pieces, span_hashes, word_bounds
from semdrift.llm.common import Adam, fitted, labelled_sample, pack_arrays, sigmoid, unpack_arrays
from semdrift.session import ship_package

WINDOW, STRIDE = 32, 16
WORD_ROWS, WORD_DIM = 1 << 15, 8
CHAR_ROWS, CHAR_DIM = 1 << 15, 12
GRAMS = (3, 5)
#: Characters of a word that are read, in bytes; what follows is read as a word of its own.
WORD_BYTES = 48
STATE, HEED = 8, 8
#: Labelled documents of each class that the model is fitted on, at most.
PER_CLASS = 2_500
#: Windows of a training document that are looked at in an epoch, at most, evenly spaced.
TRAIN_WINDOWS = 48
EPOCHS, DOCS, RATE = 6, 32, 2e-2
#: Share of the words of a step whose own vectors are hidden, so that letters are learned too.
HIDDEN = 0.3
#: Training steps, at least, however few documents there are.
LEAST_STEPS = 400
#: Windows scored at once.
CHUNK = 2048


class Words:
    """The different words of a piece: rows in the word table and in the character table."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        low = LOWER[data]
        starts, ends, self.before = word_bounds(low, offsets, SPACED)
        if len(starts) and int((ends - starts).max()) > WORD_BYTES:
            starts, ends, self.before = _cut_long(starts, ends, self.before)
        h = span_hashes(low, starts, ends)
        unique, first, self.ids = np.unique(h, return_index=True, return_inverse=True)
        self.word_rows = (unique % np.uint64(WORD_ROWS)).astype(np.int64)
        self.gram_rows, self.gram_of = _grams(low, starts[first], ends[first])


def _cut_long(starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = -(-(ends - starts) // WORD_BYTES)
    total = np.concatenate([[0], np.cumsum(count)])
    word = np.repeat(np.arange(len(starts)), count)
    s = starts[word] + (np.arange(len(word)) - total[word]) * WORD_BYTES
    return s, np.minimum(s + WORD_BYTES, ends[word]), total[before]


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row in the character table, word) of every character sequence of every word, marks included."""
    n = len(starts)
    size = ends - starts + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(n), size)
    place = np.arange(int(offset[-1])) - offset[word]
    source = np.clip(starts[word] + place - 1, 0, max(0, len(data) - 1))
    text = data[source].astype(np.uint64) if len(data) else np.zeros(0, np.uint64)
    text[offset[:-1]] = 256
    text[offset[1:] - 1] = 257
    rows, of = [], []
    for k in GRAMS:
        fits = np.flatnonzero(place + k <= size[word])
        h = np.zeros(len(fits), np.uint64)
        for j in range(k):
            h = h * np.uint64(521) + text[fits + j] + np.uint64(1)
        rows.append((mixed(h + np.uint64(k << 58)) % np.uint64(CHAR_ROWS)).astype(np.int64))
        of.append(word[fits])
    return np.concatenate(rows), np.concatenate(of)


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, document) of every window; a document without words has none."""
    n = np.diff(before)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    return before[doc] + nth * STRIDE, np.minimum(WINDOW, n[doc] - nth * STRIDE), doc


# ------------------------------------------------------------------ the network


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def some(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    m = {"word": some(WORD_ROWS, WORD_DIM, scale=0.1), "char": some(CHAR_ROWS, CHAR_DIM, scale=0.3)}
    for way in "fb":
        m["x" + way] = some(WORD_DIM + CHAR_DIM, 3 * STATE, scale=0.4)
        m["h" + way] = some(STATE, 3 * STATE, scale=0.3)
        m["i" + way] = np.zeros(3 * STATE, np.float32)
        m["n" + way] = np.zeros(STATE, np.float32)
    m["A"], m["a"], m["v"] = some(2 * STATE, HEED, scale=0.4), np.zeros(HEED, np.float32), some(HEED, scale=0.4)
    m["o"], m["c"] = some(2 * STATE, scale=0.3), np.full(1, -1, np.float32)
    return m


def _fast_sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, through tanh."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def embed(m: dict[str, np.ndarray], w: Words) -> np.ndarray:
    """The input vector of each different word."""
    n = len(w.word_rows)
    chars = np.zeros((n, CHAR_DIM), np.float32)
    if n:
        order = np.argsort(w.gram_of, kind="stable")
        of = w.gram_of[order]
        has, at = np.unique(of, return_index=True)
        chars[has] = np.add.reduceat(m["char"][w.gram_rows[order]], at, axis=0)
        chars[has] /= np.diff(np.append(at, len(of)))[:, None]
    return np.concatenate([m["word"][w.word_rows], chars], axis=1)


def _run(x: np.ndarray, seq: np.ndarray, inside: np.ndarray, m: dict, way: str, keep: bool) -> tuple[np.ndarray, list]:
    """States (step, window, STATE) of one direction; ``x`` holds gate inputs of each word, ``seq`` (step, window) words."""
    steps, n = seq.shape
    h = np.zeros((n, STATE), np.float32)
    states = np.empty((steps, n, STATE), np.float32)
    held = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        xt = x[seq[t]]
        ht = h @ m["h" + way]
        rz = xt[:, :2 * STATE]
        rz += ht[:, :2 * STATE]
        _fast_sigmoid(rz)
        r, z = rz[:, :STATE], rz[:, STATE:]
        hn = ht[:, 2 * STATE:]
        hn += m["n" + way]
        new = r * hn
        new += xt[:, 2 * STATE:]
        np.tanh(new, out=new)
        z = z * inside[t][:, None]
        if keep:
            held.append((t, h, r.copy(), z, new, hn.copy()))
        h = h + z * (new - h)
        states[t] = h
    return states, held


def _pool(states: np.ndarray, inside: np.ndarray, m: dict) -> tuple[np.ndarray, tuple]:
    u = np.tanh(states @ m["A"] + m["a"])
    e = u @ m["v"]
    e[inside == 0] = -1e9
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tn,tnk->nk", e, states)
    return pooled @ m["o"] + m["c"][0], (u, e, pooled)


def _gates(m: dict, vectors: np.ndarray) -> dict[str, np.ndarray]:
    return {way: vectors @ m["x" + way] + m["i" + way] for way in "fb"}


def _sequences(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(int(size.max()))[:, None]
    return ids[np.minimum(first + step, first + size - 1)], (step < size).astype(np.float32)


def window_scores(m: dict, gates: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The score of each window before the sigmoid."""
    out = np.empty(len(first), np.float32)
    for at in range(0, len(first), CHUNK):
        seq, inside = _sequences(ids, first[at:at + CHUNK], size[at:at + CHUNK])
        states = np.concatenate([_run(gates[w], seq, inside, m, w, False)[0] for w in "fb"], axis=2)
        out[at:at + CHUNK] = _pool(states, inside, m)[0]
    return out


def _back(m: dict, way: str, held: list, d_states: np.ndarray, n_words: int, seq: np.ndarray, grads: dict) -> np.ndarray:
    """Gradient for the gate inputs of each word; adds those of the recurrent weights to ``grads``."""
    U = m["h" + way]
    dU, dn, dh = np.zeros_like(U), np.zeros(STATE, np.float32), 0
    dx = np.zeros((n_words, 3 * STATE), np.float32)
    for t, h, r, z, new, hn in reversed(held):
        dh = dh + d_states[t]
        dpre = dh * z * (1 - new * new)
        # z holds the mask: where a step is outside the window it is 0 and nothing passes
        dz = dh * (new - h) * z * (1 - z) * (z > 0)
        dr = dpre * hn * r * (1 - r)
        dhn = dpre * r
        dgate = np.concatenate([dr, dz, dhn], axis=1)
        dU += h.T @ dgate
        dn += dhn.sum(0)
        np.add.at(dx, seq[t], np.concatenate([dr, dz, dpre], axis=1))
        dh = dh * (1 - z) + dgate @ U.T
    grads["h" + way], grads["n" + way] = dU, dn
    return dx


def _step(m: dict, adam: Adam, w: Words, first: np.ndarray, size: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> None:
    """One step on the given windows of one piece; with ``rng`` some words are read by their letters alone."""
    seq, inside = _sequences(w.ids, first, size)
    used, seq = np.unique(seq, return_inverse=True)
    seq = seq.reshape(inside.shape)
    slot = np.full(len(w.word_rows), -1)
    slot[used] = np.arange(len(used))
    part = slot[w.gram_of] >= 0
    small = Words.__new__(Words)
    small.word_rows, small.gram_rows, small.gram_of = w.word_rows[used], w.gram_rows[part], slot[w.gram_of[part]]
    vectors = embed(m, small)
    seen = np.ones((len(used), 1), np.float32) if rng is None else (rng.random((len(used), 1)) >= HIDDEN).astype(np.float32)
    vectors[:, :WORD_DIM] *= seen
    gates = _gates(m, vectors)
    runs = {k: _run(gates[k], seq, inside, m, k, True) for k in "fb"}
    states = np.concatenate([runs[k][0] for k in "fb"], axis=2)
    logit, (u, e, pooled) = _pool(states, inside, m)
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    grads: dict[str, np.ndarray] = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
    dpool = d[:, None] * m["o"]
    ds = e[:, :, None] * dpool
    de = np.einsum("nk,tnk->tn", dpool, states)
    de = e * (de - (e * de).sum(0))
    grads["v"] = np.einsum("tn,tnk->k", de, u)
    du = de[:, :, None] * m["v"] * (1 - u * u)
    grads["A"], grads["a"] = np.einsum("tnk,tnj->kj", states, du), du.sum((0, 1))
    ds += du @ m["A"].T
    dv = 0
    for i, way in enumerate("fb"):
        dx = _back(m, way, runs[way][1], ds[:, :, i * STATE:(i + 1) * STATE], len(used), seq, grads)
        grads["x" + way], grads["i" + way] = vectors.T @ dx, dx.sum(0)
        dv = dv + dx @ m["x" + way].T
    rows = {}
    rows["word"], back = np.unique(small.word_rows, return_inverse=True)
    grads["word"] = np.zeros((len(rows["word"]), WORD_DIM), np.float32)
    np.add.at(grads["word"], back, dv[:, :WORD_DIM] * seen)
    count = np.maximum(1, np.bincount(small.gram_of, minlength=len(used)))
    rows["char"], back = np.unique(small.gram_rows, return_inverse=True)
    grads["char"] = np.zeros((len(rows["char"]), CHAR_DIM), np.float32)
    np.add.at(grads["char"], back, (dv[:, WORD_DIM:] / count[:, None])[small.gram_of])
    adam.move(grads, rows)


def train(rows: list[tuple[bytes, int]], seed: int = 11, epochs: int = EPOCHS, least: int = LEAST_STEPS) -> bytes:
    """The model as bytes. With one class or none it scores (ones + 1) / (rows + 2) throughout."""
    labels = np.array([y for _, y in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return pack_arrays({"constant": np.array([(labels.sum() + 1) / (len(rows) + 2)])})
    rng = np.random.default_rng(seed)
    m = _start(rng)
    adam = Adam(m, RATE)
    by = [np.flatnonzero(labels == k) for k in (0, 1)]
    half = DOCS // 2
    steps = max(least, epochs * (len(rows) // DOCS))
    for step in range(steps):
        adam.rate = RATE * (1 - step / steps)
        at = np.concatenate([rng.choice(by[k], half) for k in (0, 1)])  # both classes alike
        texts = [rows[i][0] for i in at]
        data = np.frombuffer(b"".join(texts), np.uint8)
        w = Words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        first, size, doc = windows(w.before)
        seen = np.concatenate([
            k if len(k) <= TRAIN_WINDOWS else k[np.unique(np.linspace(0, len(k) - 1, TRAIN_WINDOWS).astype(int))]
            for k in np.split(np.arange(len(doc)), np.searchsorted(doc, np.arange(1, len(at))))
        ])
        if not len(seen):
            continue
        first, size, doc = first[seen], size[seen], doc[seen]
        found = window_scores(m, _gates(m, embed(m, w)), w.ids, first, size)
        order = np.lexsort((found, doc))
        top = order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]
        clean = np.flatnonzero(labels[at][doc] == 0)
        more = rng.choice(clean, min(half, len(clean)), replace=False) if len(clean) else clean
        pick = np.concatenate([top, more])
        _step(m, adam, w, first[pick], size[pick], labels[at][doc[pick]], rng)
    return pack_arrays(m)


def scores(m: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """The score of every text; without words it is that of the network's bias."""
    if "constant" in m:
        return np.full(len(column), float(m["constant"][0]))
    out = np.full(len(column), float(m["c"][0]))
    for first_row, data, offsets in pieces(column):
        w = Words(data, offsets)
        first, size, doc = windows(w.before)
        if len(doc):
            found = window_scores(m, _gates(m, embed(m, w)), w.ids, first, size)
            at = np.flatnonzero(np.diff(doc, prepend=-1))
            out[first_row + doc[at]] = np.maximum.reduceat(found, at)
    return sigmoid(out)


# ------------------------------------------------------------------ Spark stages

_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = PER_CLASS, label: str = "toxic") -> bytes:
    """A model learned from at most ``per_class`` labelled documents of either class among those ``keep`` allows."""
    ship_package(docs.sparkSession)
    return fitted(labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, per_class), train)


def score(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score), a row per row of ``docs``; scores are 0 to 1, higher for more toxic texts.

    Whole texts are scored. A text without words, or null, scores by the
    network's bias alone. Equal texts get equal scores. Other columns are
    not read.
    """
    ship_package(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack_arrays(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores(m, b.column(1)))], schema=_SCORES)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(rate, "doc_id long, score double")
