"""Token ids of whole documents in bit-plane files.

A file holds one contiguous run of documents in ascending id order. Their ids
are cut into blocks of ``BLOCK_IDS``; a block is transposed into planes (all
lowest bits together, then all second bits, ...; or bytes instead of bits),
and every plane is compressed with zstandard by itself.

    magic | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes) | magic

The index (zstandard over JSON) holds the unit and, for each block, its
position, its number of ids and the length of each plane; then, for each
document, its id and number of ids. All numbers are little-endian. Blocks can
be read alone, and a file can be read in a stream.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from semdrift.llm.buffers import pieces
from semdrift.llm.common import batch
from semdrift.session import scratch_path, ship_package, write_and_read

MAGIC = b"BITPLN01"
BLOCK_IDS = 1 << 16
UNIT = "bit"
LEVEL = 3
END_ID = 0
#: Encodings of words that a worker keeps in each of two generations.
CACHE_WORDS = 500_000
SEGMENT = 1 << 22
#: Words that are handed to the library in one text, and the longest of them.
LINES, LINE_CHARS = 512, 256

_FILES = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int64()), ("position", pa.int64()), ("before", pa.int64()),
    ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
])


# ------------------------------------------------------------------ encoding

_CUT = re.compile(rb"(?<![\x00-\x20\x7f])(?<!\xc2[\x85\xa0])(?<![\xe1-\xe3][\x80-\xbf][\x80-\xbf]) ")
_BLANK = np.isin(np.arange(256), [*range(33), 127])
_LETTER = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
#: Signs of ASCII without the apostrophe, which may begin a piece such as 's.
_SIGN = np.isin(np.arange(256), [*b"!#$%&*,.:;?@"])


def _after_blank(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a character that may be white space itself ends before each place; places lie three bytes from the start at least."""
    one, two, three = (data[at - k] for k in (1, 2, 3))
    blank = _BLANK[one] | ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
    return blank | ((three >= 0xE1) & (three <= 0xE3) & (two >= 0x80) & (two < 0xC0) & (one >= 0x80) & (one < 0xC0))


def _odd(texts: list[bytes]) -> set[int]:
    """The texts with a space after a character that may be white space itself."""
    data = np.frombuffer(b"###" + b"###".join(texts), np.uint8)
    at = np.flatnonzero(data == 32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 3)
    return set(np.searchsorted(ends, at[_after_blank(data, at)], side="right").tolist())


def _spans(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes between one edge and the next, which share the buffer of ``data``."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])


def _merged(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """All places of both, in order and once."""
    marked = np.zeros(int(edges[-1]) + 1, bool)
    marked[at] = marked[edges] = True
    return np.flatnonzero(marked)


def _plain(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the edges of an array that :meth:`take` has made."""
    _, where, raw = spans.buffers()
    edges = np.frombuffer(where, np.int64, len(spans) + 1)
    return np.frombuffer(raw, np.uint8, int(edges[-1])) if edges[-1] else np.zeros(0, np.uint8), edges


def _listed(spans: pa.Array) -> list[bytes]:
    data, edges = _plain(spans)
    raw, ends = data.tobytes(), edges.tolist()
    return [raw[low:high] for low, high in zip(ends, ends[1:])]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, word by word.

    The tokenizer always starts a new piece at a space that follows a
    character other than white space, so a word, with that space, is encoded
    by the library once and looked up from then on. A word that was not met
    before is cut at line breaks and before signs that follow a letter, where
    a piece begins, too; only parts that were not met go to the library.
    Special tokens
    hold no space, so one that stands in a text lies within such a word; the library takes it for the token that it names, or
    with ``plain_specials`` for ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: Bytes that white space, in UTF-8, and the names of special tokens begin with; the same without the line break.
        self.marks = np.zeros(256, bool)
        self.marks[[*range(33), 0xC2, 0xE1, 0xE2, 0xE3, *(t.encode()[0] for t in self.specials if t)]] = True
        self.line_marks = self.marks.copy()
        self.line_marks[10] = False
        #: Tokens that begin with a space, which byte-level vocabularies write as the letter U+0120.
        names = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        (self.line_end,) = self.library.encode("\n", add_special_tokens=False).ids
        #: Whether the tokenizer begins a piece at line breaks and signs, whatever stands before.
        ids = [self.library.encode(t, add_special_tokens=False).ids for t in ("a.,\nb;c1!", "a", ".,", "\n", "b", ";c", "1", "!")]
        self.parted = ids[0] == sum(ids[1:], [])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes], odd: np.ndarray) -> list[bytes]:
        """The ids of each word; ``odd`` marks the empty and long ones, and those with bytes that white space or a special token's name may begin with.

        Plain words go to the library many at a time, those that begin with a space as one text:
        such a space always begins a piece, so the ids part at the tokens that begin with one. Words without it, and
        words that hold line breaks, or bytes that other white
        space may begin with, go as lines of one text: a line break before a word is always a piece, and a token, of its
        own; so is one inside a word. Words with other white space or a special token's name in them go one by one.
        """
        out: list[bytes | None] = [None] * len(words)
        spaced = [i for i, is_odd in enumerate(odd.tolist()) if not is_odd and words[i][:1] == b" "]
        lines = [spaced[at:at + LINES] for at in range(0, len(spaced), LINES)]
        texts = [b"".join([words[i] for i in own]).decode("utf-8", "replace") for own in lines]
        for own, e in zip(lines, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            first = np.flatnonzero(self.spaced[ids])
            if len(first) != len(own):
                raise ValueError("the tokenizer does not part words at spaces")
            raw, edges = ids.tobytes(), (4 * np.append(first, len(ids))).tolist()
            for i, low, high in zip(own, edges, edges[1:]):
                out[i] = raw[low:high]
        some = {i: words[i].decode("utf-8", "replace") for i, x in enumerate(out) if x is None}
        plain = [
            i for i, t in some.items()
            if len(t) < LINE_CHARS and (t[:1] == " " or self.parted)
            and t.split() == t.removeprefix(" ").split("\n") and not any(x in t for x in self.specials)
        ]
        lines = [plain[at:at + LINES] for at in range(0, len(plain), LINES)]
        texts = ["\n".join([some[i] for i in own]) for own in lines]
        for own, e in zip(lines, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            last = np.cumsum([1 + some[i].count("\n") for i in own]) - 1
            if len(ends) != last[-1] + 1:
                raise ValueError("the tokenizer does not part words at line breaks")
            raw, at = ids.tobytes(), 0
            for i, end in zip(own, (4 * ends[last]).tolist()):
                out[i] = raw[at:end]
                at = end + 4
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([some[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    @staticmethod
    def _maybe_odd(data: np.ndarray, edges: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Whether a word is empty or long, or holds one of the bytes ``marks`` after the space that it may begin with."""
        size = np.diff(edges)
        marked = marks[data]
        heads = edges[:-1][size > 0]
        heads = heads[data[heads] == 32]
        marked[heads] = False
        odd = (size == 0) | (size >= LINE_CHARS)
        odd[np.searchsorted(edges, heads, side="right") - 1] |= size[np.searchsorted(edges, heads, side="right") - 1] == 1
        odd[np.searchsorted(edges, np.flatnonzero(marked), side="right") - 1] = True
        return odd

    def _by_parts(self, words: pa.Array) -> list[bytes]:
        """The ids of words, each from those of its parts."""
        data, edges = _plain(words)
        odd = self._maybe_odd(data, edges, self.line_marks)
        line, sign = data == 10, np.zeros(len(data), bool)
        line[edges[edges < len(data)]] = False  # a break at a word's edge or beside another stays with its word
        line[edges[1:][edges[1:] > 0] - 1] = False
        twins = np.flatnonzero((data[1:] == 10) & (data[:-1] == 10))
        line[twins] = line[twins + 1] = False
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        sign[1:] = letter[:-1] & _SIGN[data[1:]]
        here = sign | line
        here[1:] |= line[:-1]
        at = np.flatnonzero(here)
        at = at[~odd[np.searchsorted(edges, at, side="right") - 1]]
        cuts = _merged(at, edges)
        found, ends = _plain(self._ids(_spans(data, cuts), False))
        return _listed(_spans(found, ends[np.searchsorted(cuts, edges)]))

    def _ids(self, words: pa.Array, cut: bool) -> pa.Array:
        """The ids of each word; those not met before are cut into parts or go to the library."""
        coded = words.dictionary_encode()
        names = _listed(coded.dictionary)
        out = list(map(self.known.get, names))
        new = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = out[i] = self.older.get(names[i])
            if ids is None:
                new.append(i)
            else:
                self.known[names[i]] = ids
        if new:
            some = coded.dictionary.take(pa.array(new))
            if cut and self.parted:
                found = self._by_parts(some)
            else:
                found = self._encoded([names[i] for i in new], self._maybe_odd(*_plain(some), self.marks))
            for i, ids in zip(new, found):
                out[i] = self.known[names[i]] = ids
        return pa.array(out, pa.large_binary()).take(coded.indices)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        edges = np.cumsum([0, *map(len, texts)])
        return self.encode_rows(np.frombuffer(b"".join(texts), np.uint8), edges)

    def encode_rows(self, data: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """The ids of the text between each edge and the next."""
        if not len(data):
            return [b""] * (len(edges) - 1)
        if len(self.known) > CACHE_WORDS:  # words in use come back from the older generation, the others are forgotten
            self.known, self.older = {}, self.known
        at = 3 + np.flatnonzero(data[3:] == 32)
        cuts = _merged(at[~_after_blank(data, at)], edges)
        ids, ends = _plain(self._ids(_spans(data, cuts), True))
        return _listed(_spans(ids, ends[np.searchsorted(cuts, edges)]))

    def segments(self, text: bytes) -> Iterator[bytes]:
        """The ids of a text of any length, a bounded stretch at a time."""
        at = 0
        while len(text) - at > SEGMENT:
            cut = _CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            yield self._one(text[at:cut.start()], at > 0)
            at = cut.start() + 1
        yield self._one(text[at:], at > 0)

    def _one(self, text: bytes, spaced: bool) -> bytes:
        return self.encode([b" " + text if spaced else text])[0]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    if (path, plain_specials) not in _ENCODERS:
        _ENCODERS[path, plain_specials] = Encoder(path, plain_specials)
    return _ENCODERS[path, plain_specials]


# ------------------------------------------------------------------ the file format


def planes(ids: np.ndarray, unit: str = UNIT) -> list[bytes]:
    """The planes of a block of 32-bit ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    columns = [np.ascontiguousarray(rows[:, k]) for k in range(4)]
    return [np.packbits(column & np.uint8(1 << k)).tobytes() for column in columns for k in range(8)]


def from_planes(raw: list[bytes], n: int, unit: str = UNIT) -> np.ndarray:
    if unit == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in raw], axis=1)
    else:
        rows = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(raw):
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
            if bits.any():
                rows[:, k // 8] |= bits << np.uint8(k % 8)
    return np.ascontiguousarray(rows).view("<u4").ravel()


class Writer:
    """Appends documents to one file; holds at most a block and the index."""

    def __init__(self, out, unit: str = UNIT, block_ids: int = BLOCK_IDS, level: int = LEVEL) -> None:
        self.out, self.unit, self.block_bytes = out, unit, 4 * block_ids
        self.squeeze = zstandard.ZstdCompressor(level=level).compress
        self.held, self.at, self.n_ids = bytearray(), len(MAGIC), 0
        self.blocks, self.docs = [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, stretches: Iterator[bytes]) -> None:
        count = 0
        for ids in stretches:
            count += len(ids) // 4
            self.held += ids
            while len(self.held) >= self.block_bytes:
                self._flush(self.block_bytes)
        self.docs.append([doc_id, count])
        self.n_ids += count

    def _flush(self, size: int) -> None:
        block = np.frombuffer(bytes(self.held[:size]), "<u4")
        del self.held[:size]
        packed = [self.squeeze(p) for p in planes(block, self.unit)]
        for p in packed:
            self.out.write(p)
        self.blocks.append([self.at, len(block), [len(p) for p in packed]])
        self.at += sum(map(len, packed))

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        index = self.squeeze(json.dumps({"unit": self.unit, "blocks": self.blocks, "docs": self.docs}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class Reader:
    """Reads a file through random access (``read_at``)."""

    def __init__(self, read_at, size: int) -> None:
        tail = len(MAGIC) + 8
        end = read_at(tail, size - tail)
        if end[8:] != MAGIC or read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a bit-plane file")
        length = int.from_bytes(end[:8], "little")
        index = json.loads(zstandard.ZstdDecompressor().decompress(read_at(length, size - tail - length)))
        self.read_at, self.unit, self.blocks, self.docs = read_at, index["unit"], index["blocks"], index["docs"]

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = self.blocks[i]
        raw, expand = self.read_at(sum(lengths), at), zstandard.ZstdDecompressor().decompress
        ends = np.cumsum(lengths).tolist()
        return from_planes([expand(raw[e - k:e]) for e, k in zip(ends, lengths)], n, self.unit)

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, ids before it in the file, its ids as stretches of bytes); stretches must be used up in order."""
        held, nxt, before = b"", 0, 0
        for doc_id, count in self.docs:
            stretches, need = [], 4 * count
            while need > len(held):
                stretches.append(held)
                need -= len(held)
                held = self.block(nxt).tobytes()
                nxt += 1
            stretches.append(held[:need])
            held = held[need:]
            yield doc_id, before, stretches
            before += count


# ------------------------------------------------------------------ Spark stages


def write_files(
    docs: DataFrame, tokenizer: str, folder: str, unit: str = UNIT, block_ids: int = BLOCK_IDS,
    doc_id: str = "doc_id", text: str = "text", plain_specials: bool = False,
) -> DataFrame:
    """(part, path, n_docs, n_ids) of the files written below ``folder``, one for each range of ids.

    ``folder`` must be one that all executors share. Texts move once, to the
    range of their id, and are encoded in order by the task that writes the
    file. A task that runs again writes another file; the returned rows name
    the files that count.
    """
    ship_package(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = pfs.FileSystem.from_uri(folder)
        path, writer, out = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.bitplanes", None, None
        encode = encoder(tokenizer, plain_specials)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            if writer is None and b.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(path)
                writer = Writer(out, unit, block_ids)
            ids = b.column(0).to_pylist()
            for first, data, offsets in pieces(b.column(1), SEGMENT):
                if len(offsets) == 2 and len(data) > SEGMENT:
                    writer.add(ids[first], (x for part in (encode.segments(data.tobytes()), [end]) for x in part))
                    continue
                for k, x in enumerate(encode.encode_rows(data, offsets)):
                    writer.add(ids[first + k], [x, end])
        if writer is not None:
            writer.close()
            out.close()
            yield batch(_FILES, part=[part], path=[path], n_docs=[len(writer.docs)], n_ids=[writer.n_ids])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "part long, path string, n_docs long, n_ids long")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it. A file is read block
    by block by one task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    starts = files.select("part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    starts = write_and_read(starts, "files")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pfs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                with store.open_input_file(row["path"]) as f:
                    reader = Reader(lambda n, at, f=f: f.read_at(n, at), f.size())
                    out: list[tuple] = []
                    for position, (doc, ids_before, stretches) in enumerate(reader.documents()):
                        crc = 0
                        for x in stretches:
                            crc = zlib.crc32(x, crc)
                        count = sum(map(len, stretches)) // 4
                        out.append((doc, row["part"], position, row["base"] + ids_before, count, crc))
                        if len(out) == 10_000:
                            yield batch(_READ, **dict(zip(_READ.names, map(list, zip(*out)))))
                            out = []
                    if out:
                        yield batch(_READ, **dict(zip(_READ.names, map(list, zip(*out)))))

    count = max(1, starts.count())
    return (
        starts.repartitionByRange(count, "part")
        .mapInArrow(read, "doc_id long, part long, position long, before long, n_tokens long, ids_crc32 long")
        .select("doc_id", F.col("before").alias("start"), "n_tokens", "ids_crc32")
    )


def token_files(
    docs: DataFrame, tokenizer: str, unit: str = UNIT, doc_id: str = "doc_id", text: str = "text", plain_specials: bool = False
) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document written to bit-plane files and read back.

    Each document's ids end in id 0, which is counted. A null text is empty:
    the end id alone. Ids are in ascending ``doc_id`` order, null ids first;
    rows that share an id follow in the order of their texts. A special token's name in
    a text is that token, as the library's ``encode`` has it, or with ``plain_specials`` ordinary text. An empty table writes no
    file. Other columns are not read.
    """
    folder = scratch_path(docs.sparkSession, "token-files")
    files = write_and_read(write_files(docs, tokenizer, folder, unit, BLOCK_IDS, doc_id, text, plain_specials), "token-index")
    return read_files(files, folder)
