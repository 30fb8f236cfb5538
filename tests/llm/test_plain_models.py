"""Scores and bins computed again by plain loops."""

import math

import numpy as np
import pyarrow as pa
import pytest
from semdrift.llm import packing, quality, toxicity
from semdrift.llm.buffers import mixed, span_hashes

TEXTS = [b"", b"   \n\t ", b"Short text.", b"one two One TWO three two one " * 40, "Ünï cödé — naïve? Yes! (42) 'x' ".encode() * 30, b"a" * 1300,
         b"line one\nline two\n\n<b>x</b> {1: 2} _y_ " * 25, b"word " * 31 + b"last", b"w " * 47, b"q" * 100 + b" tail of words " * 3]
SPACES = b" \t\n\x0b\x0c\r"


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in text)


# ------------------------------------------------------------------ quality


def plain_passages(text):
    """Features of every passage, one sign and one word at a time."""
    words, at = [], 0
    low = lower(text)
    while at < len(low):
        if low[at] in SPACES:
            at += 1
            continue
        end = at
        while end < len(low) and low[end] not in SPACES:
            end += 1
        words.append((at, low[at:end]))
        at = end
    out = []
    for begin in range(0, max(1, len(text)), quality.PASSAGE):
        part = text[begin:begin + quality.PASSAGE]
        x, before = np.zeros(quality.WIDTH), 0
        for c in part:
            kind = int(quality.CLASS[c])
            x[16 * before + kind] += 1
            before = kind
        x[:256] = np.sqrt(x[:256] / max(1, len(part)))
        own = [n for n, (s, _) in enumerate(words) if begin <= s < begin + len(part)]
        sizes = [len(words[n][1]) for n in own]
        if own:
            mean = sum(sizes) / len(sizes)
            x[256], x[257] = mean / 10, math.sqrt(max(0, sum(s * s for s in sizes) / len(sizes) - mean * mean)) / 10
            x[258] = sum(any(n >= k and words[n - k][1] == words[n][1] for k in range(1, quality.LAGS + 1)) for n in own) / len(own)
            x[259] = len(own) / 100
        x[260], x[261] = len(part) / quality.PASSAGE, float(not part)
        out.append(x)
    return np.array(out)


def test_quality_scores_equal_plain_attention():
    rng = np.random.default_rng(0)
    m = {k: v * 2 for k, v in quality._start(rng).items()}
    m |= {"mean": rng.normal(size=quality.WIDTH).astype(np.float32) * 0.1, "scale": np.abs(rng.normal(size=quality.WIDTH)).astype(np.float32) + 0.5}
    got = quality.scores(m, pa.array([t.decode() for t in TEXTS]).cast(pa.binary()))
    for text, score in zip(TEXTS, got):
        codes, heed = [], []
        for x in plain_passages(text):
            x = (x - m["mean"]) / m["scale"]
            code = [math.tanh(sum(x[i] * m["W"][i, j] for i in range(quality.WIDTH)) + m["b"][j]) for j in range(quality.CODE)]
            t = [math.tanh(sum(code[i] * m["V"][i, j] for i in range(quality.CODE))) for j in range(quality.GATE)]
            g = [sigmoid(sum(code[i] * m["U"][i, j] for i in range(quality.CODE))) for j in range(quality.GATE)]
            codes.append(code)
            heed.append(math.exp(sum(t[j] * g[j] * m["w"][j] for j in range(quality.GATE))))
        pooled = [sum(a * c[j] for a, c in zip(heed, codes)) / sum(heed) for j in range(quality.CODE)]
        assert score == pytest.approx(sigmoid(sum(p * c for p, c in zip(pooled, m["c"])) + float(m["d"][0])), abs=2e-4), text[:30]


# ------------------------------------------------------------------ toxicity


def plain_words(text):
    words = [w for w in lower(text).translate(bytes.maketrans(SPACES, b" " * len(SPACES))).split(b" ") if w]
    return [w[i:i + toxicity.WORD_BYTES] for w in words for i in range(0, len(w), toxicity.WORD_BYTES)]


def plain_vector(m, word):
    """Own vector of a word beside the mean over its character sequences, marks at both ends."""
    row = int(span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0] % np.uint64(toxicity.WORD_ROWS))
    signs, rows = [256, *word, 257], []
    for k in toxicity.GRAMS:
        for i in range(len(signs) - k + 1):
            h = 0
            for c in signs[i:i + k]:
                h = (h * 521 + c + 1) % 2**64
            rows.append(int(mixed(np.array([(h + (k << 58)) % 2**64], np.uint64))[0] % np.uint64(toxicity.CHAR_ROWS)))
    return np.concatenate([m["word"][row], np.mean([m["char"][r] for r in rows], axis=0)])


def plain_states(m, vectors, way):
    S, h, out = toxicity.STATE, np.zeros(toxicity.STATE), []
    for v in vectors if way == "f" else vectors[::-1]:
        x, g = v @ m["x" + way] + m["i" + way], h @ m["h" + way]
        r = np.array([sigmoid(a) for a in x[:S] + g[:S]])
        z = np.array([sigmoid(a) for a in x[S:2 * S] + g[S:2 * S]])
        new = np.tanh(x[2 * S:] + r * (g[2 * S:] + m["n" + way]))
        h = h + z * (new - h)
        out.append(h)
    return out if way == "f" else out[::-1]


def test_toxicity_scores_equal_a_plain_network():
    rng = np.random.default_rng(1)
    m = {k: v * 1.5 for k, v in toxicity._start(rng).items()}
    got = toxicity.scores(m, pa.array([t.decode() for t in TEXTS]).cast(pa.binary()))
    for text, score in zip(TEXTS, got):
        words = plain_words(text)
        vectors = {w: plain_vector(m, w) for w in set(words)}
        best = None
        for start in range(0, max(1, len(words)), toxicity.STRIDE):
            part = [vectors[w] for w in words[start:start + toxicity.WINDOW]]
            if not part or start and start + toxicity.STRIDE >= len(words) and len(words) <= start - toxicity.STRIDE + toxicity.WINDOW:
                continue  # the window before holds all of it
            states = [np.concatenate(s) for s in zip(plain_states(m, part, "f"), plain_states(m, part, "b"))]
            heed = [math.exp(float(np.tanh(s @ m["A"] + m["a"]) @ m["v"])) for s in states]
            pooled = sum(a * s for a, s in zip(heed, states)) / sum(heed)
            found = float(pooled @ m["o"] + m["c"][0])
            best = found if best is None else max(best, found)
        assert score == pytest.approx(sigmoid(float(m["c"][0]) if best is None else best), abs=2e-4), text[:30]


# ------------------------------------------------------------------ packing


def plain_best_fit(sizes, lengths):
    """(tokens, length) of every bin: the tightest bin that fits, or the size that costs least for each token it could get."""
    rooms, used = [], []
    for i, size in enumerate(sizes):
        fitting = [b for b, r in enumerate(rooms) if r >= size]
        if fitting:
            b = min(fitting, key=lambda b: rooms[b])
        else:
            def rate(c):
                fill, rest = 0, c - size
                for s in sorted(x for x in sizes[i + 1:] if x <= rest):
                    fill += s
                return packing.bin_cost(c) / (size + min(rest, fill))

            b = len(rooms)
            rooms.append(min((c for c in sorted(lengths) if c >= size), key=rate))
            used.append(0)
        rooms[b] -= size
        used[b] += size
    return sorted((u, min(c for c in lengths if c >= u)) for u in used)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    lengths = [(16, 64, 256), (512, 1024, 2048, 4096), (100,)][seed % 3]
    sizes = sorted(rng.integers(1, lengths[-1] + 1, 150).tolist() + [int(lengths[0])] * 20, reverse=True)
    bins, offsets, sized = packing.best_fit(sizes, lengths)
    used = np.bincount(bins, weights=sizes).astype(int).tolist()
    assert sorted(zip(used, sized)) == plain_best_fit(sizes, lengths)
