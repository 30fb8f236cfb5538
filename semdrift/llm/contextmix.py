"""Language-model scores by online logistic mixing of hashed-context bit predictors.

The model's text is the lower-cased words (A-Z alone), a space between them and
one end sign. Every byte is spelled in binary decisions along a Huffman tree
chosen by the byte before it. For each decision several predictors look up how
often a 0 and a 1 followed in training, in the hashed context of the last three
or five bytes and of the word so far; one more follows the last place of the
text itself where the same six bytes stood. Their log-odds are added with
weights from a set gated by how much the word context has seen and how well the
repeated place has predicted, and the weights are refined on the text itself as
it is scored: a block of decisions is scored, then the weights follow its
errors, then the next block comes. The score is the log10 probability of the
whole text; bits per byte follow from it.

Counts cover all training documents and are kept by context and node, each under
a key of its own, so their number follows the corpus. The documents are cut into
pieces; a piece sends its contexts and the signs after them, with what it counted
itself, to the buckets the contexts fall into, a bucket adds up the counts of all pieces and answers each piece
for its own decisions alone, and the piece's texts meet the answers. There are as many
buckets as the texts need, so no task and no broadcast holds more of the counts as
the corpus grows. The weights that each text starts with are fitted on all
training documents: each piece passes over its own, with the counts of the text
at hand taken out, and the mean over all decisions of all pieces is the start.

The base score needs the training count of every token. Frequent tokens, at
most ``HEAD_TOKENS``, travel to the tasks; the others leave the tasks by
document and are joined with their counts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import LOWER, SPACED, _powers, mixed, pieces, span_hashes, strings, word_bounds
from semdrift.llm.common import batch
from semdrift.session import scratch_path, settings, ship_package, write_and_read

END, SPACE = 10, 32
#: Bytes before a text that contexts may read.
PAD = 6
#: Predictors that look up counts: contexts of 3 and 5 bytes and the word so far.
TABLES = 3
#: Bytes of text whose keys are sent and answered together, and that a bucket stands for.
GROUP_BYTES = 1 << 22
MAX_TASKS = 10_000
#: Bytes of text whose decisions are spelled out at once.
STRETCH = 1 << 16
HEAD_TOKENS = 1 << 18
#: Decisions that a piece passes over at least for the starting weights, in at most ``FIT_ROUNDS`` rounds over all of its own.
FIT_DECISIONS, FIT_ROUNDS = 1 << 21, 40
#: Documents, and bytes of them, that :func:`weight_sample` takes at most; a longer document gives a part of ``WEIGHT_PART`` characters. No score uses it.
WEIGHT_DOCS, WEIGHT_BYTES, WEIGHT_PART = 400, 1 << 20, 1 << 16
FIRST_BLOCK, LAST_BLOCK = 256, 4096
ONLINE_RATE = 0.002
SCALE = 512.0
LIMIT = 10.0

#: Length of a plain array that may stand for the counts, by key modulo its length.
SLOTS = 1 << 20
#: The tables, the repeated place and a constant.
INPUTS = TABLES + 2
SETS = 16

_COUNTED = pa.schema([("kind", pa.int32()), ("token", pa.binary()), ("n", pa.int64())])
_SENT = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Parts, at most, in which buckets and pieces are dealt out one after the other; each has a bucket for every core at least.
ROUNDS = 16
#: What a job has shuffled goes when it ends: the next one shuffles anew.
ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
SENT = "piece long, bucket int, keys binary, counts binary"
_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("head_known", pa.int64()), ("head_logs", pa.float64()),
    ("score", pa.float64()), ("n_bytes", pa.int64()), ("tail", pa.list_(pa.binary())), ("times", pa.list_(pa.int64())),
])
SCORED = (
    "doc_id long, n_tokens long, head_known long, head_logs double, score double, n_bytes long, "
    "tail array<binary>, times array<long>"
)


# ------------------------------------------------------------------ the spelling of bytes


@dataclass
class Spelling:
    """Decisions of every byte after every other: ``at`` and ``size`` by pair, then nodes and bits in a row."""

    at: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def _tree(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The decisions (node, bit) of each of 256 signs in a Huffman tree over ``counts``."""
    heap = [(n + 1, s, None) for s, n in enumerate(counts)]
    heapq.heapify(heap)
    serial = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], serial, (a, b)))
        serial += 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack: list[tuple[tuple, list[tuple[int, int]]]] = [(heap[0], [])]
    while stack:
        (_, name, kids), path = stack.pop()
        if kids is None:
            out[name] = path
        else:
            for bit, kid in enumerate(kids):
                stack.append((kid, [*path, (510 - name, bit)]))  # the root is node 0
    return out


def spelling(pairs: np.ndarray) -> Spelling:
    """From how often each byte follows each other, 256 by 256."""
    paths = [p for row in pairs.tolist() for p in _tree(row)]
    size = np.array([len(p) for p in paths], np.int64)
    flat = [d for p in paths for d in p]
    return Spelling(
        np.cumsum(size) - size, size, np.array([d[0] for d in flat], np.uint8), np.array([d[1] for d in flat], np.uint8))


@dataclass
class Stream:
    """Normalised texts in a row, each after ``PAD`` end signs; ``coded`` marks what is spelled."""

    data: np.ndarray
    coded: np.ndarray
    bounds: np.ndarray


def stream(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> Stream:
    size = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(size)])
    text = np.maximum(1, total[before[1:]] - total[before[:-1]])
    bounds = np.concatenate([[0], np.cumsum(text + PAD)])
    doc = np.repeat(np.arange(len(text)), np.diff(before))
    begin = bounds[doc] + PAD + total[:-1] - total[before[doc]]
    data = np.full(int(bounds[-1]), END, np.uint8)
    source = np.flatnonzero(SPACED[low]) if len(low) else np.zeros(0, np.int64)
    data[source + np.repeat(begin - starts, ends - starts)] = low[source]
    last = np.zeros(len(starts), bool)
    last[before[1:][np.diff(before) > 0] - 1] = True
    data[(begin + size - 1)[~last]] = SPACE
    coded = np.ones(len(data), bool)
    coded[(bounds[:-1, None] + np.arange(PAD)).ravel()] = False
    return Stream(data, coded, bounds)


@dataclass
class Decisions:
    """What is known of every decision: keys of its counts, the bit itself, what the repeated place says, and how well it did."""

    keys: np.ndarray  # (table, decision)
    bit: np.ndarray
    repeat: np.ndarray  # 1, -1 or, where the place says nothing, 0
    trust: np.ndarray  # 0 to 3
    before: np.ndarray  # decisions before each position


@dataclass
class Carry:
    """What earlier stretches of one text leave: the byte that last followed each six, in sorted runs, and the run of right places."""

    owner: int
    runs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    right: int = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the key was there, the byte after its last place)."""
        has, told = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint8)
        for known, signs in self.runs:  # older to newer
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            same = known[at] == keys
            has |= same
            told[same] = signs[at[same]]
        return has, told

    def add(self, keys: np.ndarray, signs: np.ndarray) -> None:
        """Later places win; runs double in size, so a key is moved a logarithmic number of times."""
        while True:
            order = np.argsort(keys, kind="stable")
            last = np.append(np.flatnonzero(np.diff(keys[order])), len(order) - 1)
            keys, signs = keys[order[last]], signs[order[last]]
            if not self.runs or len(self.runs[-1][0]) > 2 * len(keys):
                break
            known, old = self.runs.pop()
            keys, signs = np.concatenate([known, keys]), np.concatenate([old, signs])
        self.runs.append((keys, signs))


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(contexts of the positions by table, the six bytes before each).

    A context is the number of its table (2 bits) and 53 bits: the bytes
    themselves, or a hash of the word so far and the byte before. Its lowest
    byte is the byte before; another 8 bits are left for a node or a sign.
    """
    wide = data.astype(np.uint64)
    past = [wide[at - k] for k in range(1, 7)]
    last3 = past[0] | (past[1] << np.uint64(8)) | (past[2] << np.uint64(16))
    last5 = last3 | (past[3] << np.uint64(24)) | (past[4] << np.uint64(32))
    word = (mixed(_word_so_far(data)[at] + past[0]) >> np.uint64(19) << np.uint64(8)) | past[0]
    bases = np.stack([(c | np.uint64((k + 1) << 53)) << np.uint64(8) for k, c in enumerate((last3, last5, word))])
    return bases.view(np.int64), past


def signs(s: Stream) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each position, context with the sign that follows) of every stretch."""
    for low, high in stretches(s):
        base = max(0, low - PAD)
        at = np.flatnonzero(s.coded[low:high]) + low
        bases, _ = contexts(s.data[base:high], at - base)
        yield np.searchsorted(s.bounds, at, side="right") - 1, bases + s.data[at].astype(np.int64)


def decided(pairs: np.ndarray, n: np.ndarray, spell: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts of 0 and 1) of all decisions that spell the signs of ``pairs``, each ``n`` times."""
    code = pairs & 0xFFFF
    size = spell.size[code]
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(spell.at[code] - begin, size)
    keys = np.repeat(pairs & ~np.int64(255), size) + spell.node[place]
    if not len(keys):
        return keys, np.zeros((0, 2), np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times, bit = np.repeat(n, size)[order], spell.bit[place][order]
    return keys[first], np.stack([np.add.reduceat(np.where(bit == k, times, 0), first) for k in (0, 1)], axis=1)


def decisions(
    data: np.ndarray, at: np.ndarray, owner: np.ndarray, spell: Spelling, follow: bool = True, carry: Carry | None = None
) -> Decisions:
    """The decisions at the positions ``at`` of ``data``; ``owner`` is the text of each.

    A key is a context and the node.
    """
    bases, past = contexts(data, at)
    sign = data[at]
    first = past[0].astype(np.int64) << 8
    pair = first | sign
    size = spell.size[pair]
    before = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(at), dtype=np.int32), size)
    step = np.arange(int(before[-1])) - np.repeat(before[:-1], size)
    place = step + np.repeat(spell.at[pair], size)
    node, bit = spell.node[place], spell.bit[place]
    keys = np.empty((TABLES, len(of)), np.int64)
    wide_node = node.astype(np.int64)
    for k, base in enumerate(bases):
        np.add(np.take(base, of), wide_node, out=keys[k])
    if not follow:
        none = np.zeros(0, np.int8)
        return Decisions(keys, bit, none, none, before)
    last6 = past[0].copy()
    for k in range(1, 6):
        last6 |= past[k] << np.uint64(8 * k)
    six = mixed(last6 ^ (owner.astype(np.uint64) << np.uint64(48)))
    there = _earlier(six)
    has = there >= 0
    told = sign[np.maximum(there, 0)]
    if carry is not None:
        new = np.flatnonzero(~has)
        found, before_it = carry.find(six[new])
        has[new] = found
        told[new[found]] = before_it[found]
        carry.add(six, sign)
    right = has & (told == sign)
    told_pair = first | told
    room = np.where(has, spell.size[told_pair], 0)[of]
    place = np.minimum(step + spell.at[told_pair][of], len(spell.node) - 1)
    says = (step < room) & (spell.node[place] == node)
    repeat = np.where(says, spell.bit[place].astype(np.int8) * 2 - 1, 0).astype(np.int8)
    # how many bytes in a row the place was right before this one
    n = np.arange(len(at))
    wrong = np.maximum.accumulate(np.where(right, -1, n)) if len(at) else n
    run = np.zeros(len(at), np.int64)
    run[1:] = n[:-1] - wrong[:-1]
    if carry is not None:
        run[:1] = carry.right
        run[1:][wrong[:-1] < 0] += carry.right
        carry.right = int(n[-1] - wrong[-1]) + (carry.right if wrong[-1] < 0 else 0)
    trust = np.where(has, 1 + (run > 3) + (run > 15), 0).astype(np.int8)[of]
    return Decisions(keys, bit, repeat, trust, before)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """The last earlier index with the same key (its upper 43 bits), or -1."""
    place = np.uint64((1 << 21) - 1)
    tagged = np.sort((keys & ~place) | np.arange(len(keys), dtype=np.uint64))
    out = np.full(len(keys), -1, np.int64)
    same = np.flatnonzero((tagged[1:] ^ tagged[:-1]) <= place)
    out[(tagged[same + 1] & place).astype(np.int64)] = (tagged[same] & place).astype(np.int64)
    return out


def _word_so_far(data: np.ndarray) -> np.ndarray:
    """A hash of the bytes from the start of the word to the position, the position left out."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    starts = np.zeros(len(data), np.int64)
    starts[1:] = np.where((data[:-1] == SPACE) | (data[:-1] == END), np.arange(1, len(data)), 0)
    start = np.maximum.accumulate(starts)
    return (sums[:-1] - sums[start]) * down[start]


def stretches(s: Stream) -> Iterator[tuple[int, int]]:
    """Ranges of the stream with whole texts, or parts of one long text that end after a space where there is one."""
    at, n = 0, len(s.bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(s.bounds, s.bounds[at] + STRETCH, side="right")) - 1)
        low, high = int(s.bounds[at]), int(s.bounds[end])
        while high - low > 2 * STRETCH:
            gap = np.flatnonzero(s.data[low + STRETCH:low + 2 * STRETCH] == SPACE)
            cut = low + STRETCH + (int(gap[0]) + 1 if len(gap) else STRETCH)
            yield low, cut
            low = cut
        yield low, high
        at = end


def spelled(s: Stream, spell: Spelling, follow: bool = True) -> Iterator[tuple[np.ndarray, Decisions]]:
    """(text of each position, decisions) of every stretch; the repeated place of a long text may lie in an earlier one."""
    carry = None
    for low, high in stretches(s):
        base = max(0, low - PAD)
        at = np.flatnonzero(s.coded[low:high]) + low
        owner = np.searchsorted(s.bounds, at, side="right") - 1
        first = int(owner[0])
        if not follow or (low <= s.bounds[first] and s.bounds[first + 1] <= high):
            carry = None
        elif carry is None or carry.owner != first:
            carry = Carry(first)
        yield owner, decisions(s.data[base:high], at - base, owner, spell, follow, carry)


# ------------------------------------------------------------------ mixing


class Known:
    """Packed counts by key: open places, each compared by its whole key."""

    TURN = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(8, (2 * len(keys)).bit_length())
        self.down, self.last = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, values.dtype)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] == 0
            self.keys[place[free]] = keys[free]  # of several, one stays
            here = self.keys[place] == keys
            self.values[place[here]] = values[here]
            keys, values, place = keys[~here], values[~here], (place[~here] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * self.TURN
        h >>= self.down
        return h.view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, 0 for one that is not there."""
        place = self._place(keys)
        out = np.take(self.values, place, mode="clip")
        held = np.take(self.keys, place, mode="clip")
        other = np.flatnonzero(held != keys)
        wanted, at = keys[other], place[other]
        held = held[other]
        while len(other):
            out[other[held == 0]] = 0
            more = held != 0
            other, wanted, at = other[more], wanted[more], (at[more] + 1) & self.last
            held = self.keys[at]
            right = held == wanted
            out[other[right]] = self.values[at[right]]
            other, wanted, at, held = other[~right], wanted[~right], at[~right], held[~right]
        return out


def inputs(table: Known | np.ndarray, d: Decisions) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds of every predictor and a constant, weight set) of every decision."""
    if isinstance(table, Known):
        raw = np.stack([table.find(k) for k in d.keys])
    else:
        raw = table[d.keys % len(table)]
    return _features(raw, d)


def _features(raw: np.ndarray, d: Decisions) -> tuple[np.ndarray, np.ndarray]:
    x = np.empty((INPUTS, raw.shape[1]), np.float32)
    np.multiply(raw >> 2, np.float32(1 / SCALE), out=x[:-2], casting="unsafe")
    x[-2] = d.repeat
    x[-1] = 0.3
    gate = (raw[-1] & 3).astype(np.int64) * 4 + d.trust
    return x, gate


def packed(counts: np.ndarray) -> np.ndarray:
    """Log-odds and, in the two lowest bits, how much was seen, for counts (slots, 2)."""
    n0, n1 = counts[:, 0].astype(np.float32), counts[:, 1].astype(np.float32)
    odds = np.clip(np.log((n1 + 0.3) / (n0 + 0.3)), -LIMIT, LIMIT)
    n = n0 + n1
    seen = (n > 0).astype(np.int16) + (n > 3) + (n > 30)
    return (np.rint(odds * SCALE).astype(np.int16) << 2) | seen.astype(np.int16)


def mix(w: np.ndarray, x: np.ndarray, gate: np.ndarray, sign: np.ndarray) -> tuple[float, np.ndarray]:
    """(bits, gradient for the weights) of a block; ``sign`` is 1 for a bit 1, else -1."""
    odds = np.zeros(len(sign), np.float32)
    for wi, xi in zip(w, x):
        part = np.take(wi, gate, mode="clip")  # without a check of each index
        part *= xi
        odds += part
    odds *= sign
    np.maximum(odds, -LIMIT, out=odds)
    np.minimum(odds, LIMIT, out=odds)
    np.negative(odds, out=odds)
    miss = np.exp(odds, out=odds)
    cost = float(np.log1p(miss).sum(dtype=np.float64)) / math.log(2)
    err = miss / (1 + miss)
    err *= sign
    grad = np.array([np.bincount(gate, err * xi, SETS) for xi in x])
    return cost, grad


def text_bits(w: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, block: int = FIRST_BLOCK) -> tuple[float, np.ndarray, int]:
    """(bits, refined weights, next block) of a text or a stretch of one; blocks double in size up to a limit."""
    sign = bit.astype(np.float32) * 2 - 1
    total, at = 0.0, 0
    while at < len(sign):
        to = at + block
        cost, grad = mix(w, x[:, at:to], gate[at:to], sign[at:to])
        w = w + (ONLINE_RATE * grad).astype(np.float32)
        total, at, block = total + cost, to, min(2 * block, LAST_BLOCK)
    return total, w, block


# ------------------------------------------------------------------ starting weights


def first_weights() -> np.ndarray:
    w = np.full((INPUTS, SETS), 0.3, np.float32)
    w[-2] = np.array([0, 0.5, 1.5, 2.5], np.float32)[np.arange(SETS) % 4]  # by the trust in the repeated place
    return w


def with_times(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Packed counts and how many there are, in one number."""
    return (n.astype(np.int64) << 16) | values.view(np.uint16)


def left_out(found: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Packed counts less ``own`` (slots, 2), for those that :func:`with_times` put together.

    Up to some 2,000 the counts are recovered exactly from their log-odds and their sum, beyond that to about a thousandth.
    """
    n = (found >> 16).astype(np.float64)
    odds = ((found & 0xFFFF).astype(np.uint16).view(np.int16) >> 2) / SCALE
    ones = np.rint((n + 0.6) / (1 + np.exp(-odds)) - 0.3)
    return packed(np.maximum(0, np.stack([n - ones, ones], axis=1) - own))


def training_inputs(texts: pa.Array, table: Known, spell: Spelling) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(log-odds, weight set, sign) of all decisions of ``texts``, stretch by stretch, each text's own counts taken out.

    ``table`` has values of :func:`with_times`.
    """
    long = pc.greater(pc.binary_length(texts), STRETCH)
    for _, data, offsets in pieces(texts.filter(pc.invert(long))):
        low = LOWER[data]
        for owner, d in spelled(stream(low, *word_bounds(low, offsets, SPACED)), spell):
            text = np.repeat(owner, np.diff(d.before)).astype(np.uint64) * Known.TURN
            raw = np.empty(d.keys.shape, np.int16)
            for k, keys in enumerate(d.keys):
                _, first, of = np.unique(mixed(keys.view(np.uint64) + text), return_index=True, return_inverse=True)
                n, ones = np.bincount(of), np.bincount(of, d.bit)
                raw[k] = left_out(table.find(keys[first]), np.stack([n - ones, ones], axis=1))[of]
            yield *_features(raw, d), d.bit.astype(np.float32) * 2 - 1
    for one in texts.filter(long):  # a text of several stretches, with its own counts of all of them
        low = LOWER[np.frombuffer(one.as_buffer(), np.uint8)]
        s, tally = stream(low, *word_bounds(low, np.array([0, len(low)]), SPACED)), Tally()
        for _, pairs in signs(s):
            tally.add(pairs.ravel(), np.ones(pairs.size, bool))
        keys, own = decided(*tally.done(), spell)
        rest = Known(keys, left_out(table.find(keys), own))
        for _, d in spelled(s, spell):
            yield *inputs(rest, d), d.bit.astype(np.float32) * 2 - 1


def fit_piece(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """(mean of the weights on the last round over all decisions, number of decisions).

    A piece of few decisions is passed over several times.
    """
    w, held = first_weights(), []

    def once(w, parts):
        total, n = np.zeros(w.shape), 0
        for x, gate, sign in parts:
            if held is not None and parts is not held:
                held.append((x, gate, sign))
            if held is not None and sum(len(h[2]) for h in held) > FIT_DECISIONS:
                held.clear()
            for at in range(0, len(sign), LAST_BLOCK):
                to = at + LAST_BLOCK
                w = w + (ONLINE_RATE * mix(w, x[:, at:to], gate[at:to], sign[at:to])[1]).astype(np.float32)
                size = len(sign[at:to])
                total, n = total + w * size, n + size
        return w, total / max(1, n), n

    w, mean, n = once(w, found)
    if n and n < FIT_DECISIONS:
        for _ in range(min(FIT_ROUNDS, -(-FIT_DECISIONS // n)) - 1):
            w, mean, _ = once(w, held)
    return mean, n


# ------------------------------------------------------------------ counting over all training documents


class Tally:
    """How often each sign followed each context; pairs that are only asked for count nothing."""

    FULL = 1 << 21

    def __init__(self) -> None:
        self.pairs: list[np.ndarray] = []  # each array without repeats
        self.times: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, counted: np.ndarray) -> None:
        if counted.any():
            some, n = np.unique(pairs[counted], return_counts=True)
            self.pairs.append(some)
            self.times.append(n)
        if not counted.all():
            some = np.unique(pairs[~counted])
            self.pairs.append(some)
            self.times.append(np.zeros(len(some), np.int64))
        if sum(map(len, self.pairs[1:])) > max(self.FULL, len(self.pairs[0])):
            self._merge()

    def _merge(self) -> None:
        pairs, n = summed(np.concatenate(self.pairs), np.concatenate(self.times))
        self.pairs, self.times = [pairs], [n]

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted pairs, how often each was met)."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge()
        return self.pairs[0], self.times[0]


def summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(n[order], first)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as byte planes under zstandard; the upper planes are nearly empty."""
    planes = np.ascontiguousarray(numbers.ravel().view(np.uint8).reshape(-1, numbers.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _keys_out(keys: np.ndarray) -> bytes:
    return _squeezed(np.diff(keys, prepend=np.int64(0)))


def _keys_in(raw: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(raw, "<i8"))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the context of each key or pair."""
    return (mixed(keys.view(np.uint64) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)


def token_counts(train: DataFrame) -> DataFrame:
    """(kind, token, n): tokens of all texts (kind 0; the end is a line feed) and pairs of bytes in them (kind 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = np.zeros(1 << 16, np.int64)
            for _, data, offsets in pieces(b.column(0)):
                low = LOWER[data]
                s, e, before = word_bounds(low, offsets, SPACED)
                text = stream(low, s, e, before)
                pair = (text.data[:-1].astype(np.int64) << 8) | text.data[1:]
                pairs += np.bincount(pair[text.coded[1:]], minlength=1 << 16)
                _, first, n = np.unique(span_hashes(low, s, e), return_index=True, return_counts=True)
                words = strings(low, s[first], e[first]).cast(pa.binary())
                yield batch(_COUNTED, kind=np.zeros(len(n), np.int32), token=words, n=n)
            some = np.flatnonzero(pairs)
            keys = [bytes([k >> 8, k & 255]) for k in some.tolist()]
            yield batch(_COUNTED, kind=np.ones(len(some), np.int32), token=keys, n=pairs[some])
            yield batch(_COUNTED, kind=[0], token=[bytes([END])], n=[b.num_rows])

    counted = train.select("text").mapInArrow(count, "kind int, token binary, n long")
    return counted.groupBy("kind", "token").agg(F.sum("n").alias("n"))


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """(piece, bucket, keys, counts): the contexts and signs of every piece by bucket, with its own training counts.

    ``rows`` has (doc_id, text, train). The rows of a piece itself stand under bucket -1.
    The result must be written once, as pieces are numbered by task.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            trained = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, _, offsets in pieces(b.column(1), GROUP_BYTES):
                n, tally = len(offsets) - 1, Tally()
                part = b.slice(first, n)
                for at, data, some in pieces(part.column(1)):
                    low, counted = LOWER[data], trained[first + at:first + at + len(some) - 1]
                    for owner, pairs in signs(stream(low, *word_bounds(low, some, SPACED))):
                        tally.add(pairs.ravel(), np.tile(counted[owner], TABLES))
                yield batch(_SENT, piece=[number], bucket=[-1], keys=[_rows_out(part)], counts=[None])
                keys, counts = tally.done()
                home = bucket_of(keys, buckets)
                order = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    some = order[edges[k]:edges[k + 1]]
                    yield batch(_SENT, piece=[number], bucket=[k], keys=[_keys_out(keys[some])], counts=[_squeezed(counts[some])])
                number += 1

    return rows.select("doc_id", "text", "train").mapInArrow(own, SENT)


def _rows_out(b: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(b)
    return out.getvalue().to_pybytes()


def _rows_in(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all().combine_chunks()


def _runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows in a row that agree in column ``by``; the rows come sorted by it."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _others_out(counts: np.ndarray) -> bytes:
    """Counts (decisions, 2), in 32 bits where they fit."""
    return _squeezed(counts.T.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<i8"))


def _others_in(raw: bytes, n: int) -> np.ndarray:
    wide = zstandard.frame_content_size(raw) == 16 * n
    return _unsqueezed(raw, "<i8" if wide else "<u4").reshape(2, n).T


def answered(sent: DataFrame, wanted: np.ndarray, spell: Spelling, buckets: int, others: bool = False, rounds: int = 1) -> DataFrame:
    """(piece, bucket, keys, counts): the packed counts of all pieces for the decisions of each, in the order of their keys, and under ``keys`` how many they are.

    With ``others``, ``keys`` is null and ``counts`` has what the other pieces counted, so a piece puts its own to them.
    ``rounds`` tells in how many parts the buckets come. The plain counts of the sorted keys ``wanted`` stand under piece -1, with their keys.
    """
    spark = sent.sparkSession
    asked, shipped = spark.sparkContext.broadcast(wanted), spark.sparkContext.broadcast(spell)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes = bucket_of(asked.value, buckets)
        for rows in _runs(batches, 1):
            parts = [_keys_in(r[2]) for r in rows]
            keys, counts = decided(*summed(np.concatenate(parts), np.concatenate([_unsqueezed(r[3], "<i8") for r in rows])), shipped.value)
            if others:
                for r, part in zip(rows, parts):
                    some, own = decided(part, _unsqueezed(r[3], "<i8"), shipped.value)
                    rest = _others_out(counts[np.searchsorted(keys, some)] - own)
                    yield batch(_SENT, piece=[r[0]], bucket=[r[1]], keys=[None], counts=[rest])
            else:
                values, times = packed(counts), np.minimum(counts.sum(axis=1), np.iinfo(np.int32).max).astype(np.int32)
            for r, part in zip(rows, parts) if not others else ():
                some, _ = decided(part, np.zeros(len(part), np.int64), shipped.value)
                at = np.searchsorted(keys, some)
                yield batch(_SENT, piece=[r[0]], bucket=[r[1]], keys=[_squeezed(times[at])], counts=[_squeezed(values[at])])
            mine = asked.value[homes == rows[0][1]]
            if len(mine):
                place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                there = keys[place] == mine
                yield batch(_SENT, piece=[-1], bucket=[rows[0][1]], keys=[_keys_out(mine[there])], counts=[_squeezed(counts[place[there]])])

    tasks = min(MAX_TASKS, max(-(-buckets // rounds), spark.sparkContext.defaultParallelism))
    dealt = sent.filter("bucket >= 0").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, SENT)


def weight_sample(train: DataFrame) -> list[bytes]:
    """Texts for the starting weights: of the ids with the smallest hashes, whatever the length, a part of long ones."""
    drawn = train.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(WEIGHT_DOCS)
    size = F.length("text")
    part = F.substring("text", F.pmod(F.xxhash64("doc_id"), size - WEIGHT_PART + 1).cast("int") + 1, F.lit(WEIGHT_PART))
    sample = train.join(F.broadcast(drawn), "doc_id").withColumn("text", F.when(size > WEIGHT_PART, part).otherwise(F.col("text")))
    texts, used = [], 0
    for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(WEIGHT_DOCS).collect():
        raw = r["text"].encode()[:WEIGHT_BYTES - used]
        used += len(raw)
        if raw:
            texts.append(raw)
    return texts


def _pieces_met(batches: Iterator[pa.RecordBatch], spell: Spelling, times: bool) -> Iterator[tuple[pa.Table, Known]]:
    """(texts of a piece, its counts and those of the others together) of rows sorted by piece; with ``times`` the values are those of :func:`with_times`."""
    for piece in _runs(batches, 0):
        own = {r[1]: r for r in piece if r[2] is not None}
        found_there = {r[1]: r[3] for r in piece if r[2] is None}
        texts_of, keys, values = own.pop(-1)[2], [], []
        del piece
        for k in list(own):
            _, _, some, n = own.pop(k)
            some, counts = decided(_keys_in(some), _unsqueezed(n, "<i8"), spell)
            counts = counts + _others_in(found_there.pop(k), len(some))
            keys.append(some)
            values.append(with_times(packed(counts), counts.sum(axis=1)) if times else packed(counts))
        yield _rows_in(texts_of), Known(np.concatenate(keys), np.concatenate(values))


def _one_by_one(rounds: Iterable[DataFrame], name: str) -> DataFrame:
    """A table of the rows of all rounds; what one has shuffled is gone when the next begins."""
    path = None
    for part in rounds:
        path = path or scratch_path(part.sparkSession, name)
        with settings(part.sparkSession, ONCE):
            part.write.mode("append").parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def _weights(rounds: Iterable[DataFrame], spell) -> np.ndarray:
    """Starting weights from all training texts of all pieces; a round has the rows of some pieces and the answers to them, sorted by piece."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, table in _pieces_met(batches, spell.value, True):
            trained = rows.filter(rows.column(2)).column(1).combine_chunks()
            mean, n = fit_piece(training_inputs(trained, table, spell.value))
            if n:
                yield pa.RecordBatch.from_pydict({"w": pa.array([mean.ravel()], pa.list_(pa.float64())), "n": pa.array([float(n)])})

    total, n = np.zeros(INPUTS * SETS), 0.0
    for met in rounds:
        rows = met.mapInArrow(fit, "w array<double>, n double").select("n", F.posexplode("w").alias("pos", "w"))
        with settings(met.sparkSession, ONCE):
            found = rows.groupBy("pos").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n")).collect()  # a row for each weight
        for r in found:
            total[r["pos"]] += r["w"]
        n += found[0]["n"] if found else 0
    return (total / n).astype(np.float32).reshape(INPUTS, SETS) if n else first_weights()


# ------------------------------------------------------------------ scoring


class Head:
    """Counts of the frequent tokens, looked up by hash and compared by their bytes."""

    def __init__(self, tokens: list[bytes], counts: list[int]) -> None:
        self.end = next((c for t, c in zip(tokens, counts) if t == bytes([END])), 0)
        words = [(t, c) for t, c in zip(tokens, counts) if t != bytes([END])]
        data = np.frombuffer(b"".join(t for t, _ in words), np.uint8)
        ends = np.cumsum([len(t) for t, _ in words]).astype(np.int64)
        h = span_hashes(data, ends - [len(t) for t, _ in words], ends) if words else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.words = pa.array([words[i][0] for i in order.tolist()], pa.large_binary())
        self.count = np.array([words[i][1] for i in order.tolist()], np.int64)

    def find(self, h: np.ndarray, words: pa.Array) -> np.ndarray:
        """The count of each word, -1 for one that is not in the head."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return np.where(same.astype(bool), self.count[at], -1)


def _score_piece(rows: pa.Table, head: Head, spell: Spelling, table: Known, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    ids = rows.column(0).combine_chunks()
    for first, data, offsets in pieces(rows.column(1)):
        low = LOWER[data]
        s, e, before = word_bounds(low, offsets, SPACED)
        n = len(before) - 1
        words = np.diff(before)
        # tokens
        h, at, back = np.unique(span_hashes(low, s, e), return_index=True, return_inverse=True)
        spelled_words = strings(low, s[at], e[at])
        count = head.find(h, spelled_words)[back]
        doc = np.repeat(np.arange(n), words)
        logs = np.bincount(doc, weights=np.log10(np.maximum(count, 0) + 1.0), minlength=n) + math.log10(head.end + 1)
        known = np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64) + (head.end > 0)
        rest = count < 0
        pairs, times = np.unique(doc[rest] * len(h) + back[rest], return_counts=True)
        edges = np.searchsorted(pairs, np.arange(n + 1) * len(h)) if len(h) else np.zeros(n + 1, np.int64)
        tokens = spelled_words.take(pa.array(pairs % max(1, len(h)))).cast(pa.binary())
        tail = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), tokens)
        often = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times, pa.int64()))
        # bits
        text, bits = stream(low, s, e, before), np.zeros(n)
        w, block, now = weights, FIRST_BLOCK, -1
        for owner, d in spelled(text, spell):
            x, gate = inputs(table, d)
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for i, j in zip(cuts, cuts[1:]):
                if owner[i] != now:
                    w, block, now = weights, FIRST_BLOCK, owner[i]
                a, z = d.before[i], d.before[j]
                cost, w, block = text_bits(w, x[:, a:z], gate[a:z], d.bit[a:z], block)
                bits[now] += cost
        yield batch(
            _SCORED, doc_id=ids.slice(first, n).cast(pa.int64()), n_tokens=words + 1, head_known=known, head_logs=logs,
            score=-bits * math.log10(2), n_bytes=np.diff(text.bounds) - PAD, tail=tail, times=often,
        )


def lm_scores(
    docs: DataFrame, keep: Column | None = None, doc_id: str = "doc_id", text: str = "text", head_tokens: int = HEAD_TOKENS
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), a row per row of ``docs``.

    ``keep`` (a condition on ``doc_id``) names the training documents, all
    by default. ``score`` is the model's log10 probability of the text,
    ``base_score`` that of add-one token frequencies. A null or empty text is
    the end sign alone. Rows that repeat are counted, and scored, each on
    their own; equal texts score alike. Without training documents the
    predictors know nothing and the base score is 0. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    train = rows if keep is None else rows.filter(keep)
    counted = write_and_read(token_counts(train), "token-counts")
    tokens = counted.filter("kind = 0").select("token", "n")
    total, kinds = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    found = counted.filter("kind = 1").collect()  # at most 65,536 pairs of bytes
    pairs = np.zeros(1 << 16, np.int64)
    for r in found:
        pairs[(r["token"][0] << 8) | r["token"][1]] = r["n"]
    spell = spelling(pairs.reshape(256, 256))
    size_of = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).head()[0]
    buckets = max(1, -(-size_of // GROUP_BYTES))
    marked = rows.withColumn("train", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    sent = write_and_read(gathered(marked, buckets), "bit-counts")
    # buckets, then pieces, are dealt out a part at a time, so only a part of the keys lies in shuffle files beside the tables
    cores = spark.sparkContext.defaultParallelism
    rounds = max(1, min(ROUNDS, buckets // cores))
    none = np.zeros(0, np.int64)
    found = _one_by_one(
        (answered(sent.filter(F.col("bucket") % rounds == k), none, spell, buckets, True, rounds) for k in range(rounds)), "bit-answers")
    spelled_out = spark.sparkContext.broadcast(spell)
    # a piece's texts, under bucket -1, its contexts and own counts, and the answers
    tasks = min(MAX_TASKS, max(-(-buckets // rounds), 4 * cores))
    turn = (F.shiftright("piece", 32) + F.col("piece").bitwiseAND((1 << 32) - 1)) % rounds
    met = [sent.unionByName(found).filter(turn == k).repartition(tasks, "piece").sortWithinPartitions("piece") for k in range(rounds)]
    weights = spark.sparkContext.broadcast(_weights(met, spelled_out))
    # the least count that leaves no more tokens than the head may have
    bound = 1
    if kinds > head_tokens:
        sizes = tokens.withColumn("n", F.least("n", F.lit(1 << 20))).groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
        held = 0
        for r in sizes:
            held += r["k"]
            if held > head_tokens:
                break
            bound = r["n"]
        else:
            bound = 1
        bound = max(bound, 1) if held <= head_tokens else bound
    end = bytes([END])
    top = tokens.filter((F.col("n") >= bound) | (F.col("token") == F.lit(end))).toArrow()
    head = spark.sparkContext.broadcast((top.column("token").to_pylist(), top.column("n").to_pylist()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Head(*head.value)
        for rows_of, table in _pieces_met(batches, spelled_out.value, False):
            yield from _score_piece(rows_of, held, spelled_out.value, table, weights.value)

    row = F.monotonically_increasing_id() * rounds
    scored = _one_by_one((part.mapInArrow(score, SCORED).withColumn("row", row + k) for k, part in enumerate(met)), "lm-scores")
    tail = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select(
        "row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    rare = tokens.filter((F.col("n") < bound) & (F.col("token") != F.lit(end)))
    more = tail.join(rare, "token").groupBy("row").agg(
        F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail_logs"))
    norm = math.log10(total + kinds + 1)
    return scored.drop("tail", "times").join(more, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score", (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
