"""Decontamination, packing and token files against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from semdrift.llm import decontaminate, packing, tokenfiles
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items):
    windows = set()
    for item, text in items:
        w = words(text)
        if w:
            windows |= {(str(item), tuple(w[i:i + 10])) for i in range(max(1, len(w) - 9))}
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i:i + len(x)]) == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "shipped"), [(100_000, 1_000_000), (3, 1_000_000), (3, 0)])
def test_contamination_equals_plain(spark, monkeypatch, block, shipped):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 5)  # frequent shingles are spread in the join
    rng = random.Random(5)
    vocabulary = "a b c Dé ö 7 x1 the".split()

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(n))

    items = [(1, text(30)), (2, text(12)), (10, text(4)), (11, text(1)), (12, ""), (13, None), (14, "b b b b b b b b b b b b"), (2, "the the")]
    docs = [(i, text(rng.randint(0, 40))) for i in range(40)]
    docs += [(100 + i, text(7) + (items[i % 3][1] or "") + text(9) + (items[i % 2][1] or "")) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "b " * 25), (202, "b " * 25), (None, items[0][1].upper().replace("É", "é").replace("Ö", "ö"))]
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), block_windows=block, shipped_windows=shipped)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_hits(docs, items)


@pytest.mark.parametrize("shipped", [1_000_000, 0])
def test_contamination_of_odd_and_empty_tables(spark, odd, shipped):
    bench = spark.createDataFrame([("q", "Two three, four")], "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    short = [(d, t) for d, t in rows if d != 7]
    got = [tuple(r) for r in decontaminate.contamination(odd, bench, shipped_windows=shipped).collect()]
    assert sorted([g for g in got if g[0] != 7], key=repr) == plain_hits(short, [("q", "Two three, four")])
    assert [g[1:4] for g in got if g[0] == 7] == [(300_000, 0, 0)]
    assert decontaminate.contamination(odd.limit(0), bench, shipped_windows=shipped).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.limit(0)).collect())


# ------------------------------------------------------------------ packing


def check_bins(rows, counts, lengths):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.bin_offset)
        end = 0
        for r in parts:
            assert r.bin_offset == end
            end += r.length
        assert parts[0].bin_length == min(c for c in lengths if c >= end)
    seen = sorted((str(r.doc_id), r.start, r.length) for r in rows)
    want = sorted((str(d), s, min(max(lengths), n - s)) for d, n in counts for s in range(0, n, max(lengths)))
    assert seen == want


def test_every_token_is_packed_once(spark):
    rng = random.Random(6)
    counts = [(i, rng.choice([1, 2, 3, 10, 63, 64, 65, 300, rng.randint(1, 200)])) for i in range(900)] + [(5, 40), (5, 40), (None, 7)]
    table = spark.createDataFrame(counts, "doc_id long, n_tokens long")
    for shard in (10_000, 100):
        check_bins(packing.pack(table, (16, 32, 64), shard).collect(), counts, (16, 32, 64))


def test_best_fit_takes_the_least_room():
    # 50 opens a bin of 64, 40 another (room 24); 20 goes there, and 12 fits a room of 14, not one of 4
    bins, offsets, sizes = packing.best_fit([50, 40, 20, 12], (64,))
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 40, 50] and sizes == [64, 64]


def test_bins_shrink_and_waste_little():
    rng = np.random.default_rng(7)
    sizes = sorted(rng.integers(1, 4097, 4000).tolist(), reverse=True)
    bins, _, lengths = packing.best_fit(sizes)
    used = np.bincount(bins, weights=sizes)
    assert (used <= lengths).all() and used.sum() / sum(lengths) > 0.98
    assert packing.best_fit([5], (8, 64))[2] == [8]
    assert packing.best_fit([], (8,)) == ([], [], [])


def test_packing_of_odd_and_empty_tables(spark, odd):
    counts = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1) for r in odd.collect()]
    check_bins(packing.pack_documents(odd).collect(), counts, packing.LENGTHS)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_rows_that_repeat_are_dealt_to_all_shards(spark):
    counted = spark.range(8000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("n_tokens"))
    found = packing.pack(counted, shard_pieces=1000).withColumn("shard", F.col("bin_id").bitwiseAND(F.lit(-1 << 32)))
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sum(sizes) == 8000 and len(sizes) == 8 and max(sizes) < 1300


# ------------------------------------------------------------------ token files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def plain_tokens(rows):
    library = Tokenizer.from_file(VOCABULARY)
    at, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_special_names_are_what_the_library_takes_them_for():
    for plain, ids in ((False, [64, 50256, 65]), (True, None)):
        library = Tokenizer.from_file(VOCABULARY)
        library.encode_special_tokens = plain
        want = ids or library.encode("a<|endoftext|>b", add_special_tokens=False).ids
        assert np.frombuffer(tokenfiles.Encoder(VOCABULARY, plain).encode([b"a<|endoftext|>b"])[0], "<u4").tolist() == want
    assert len(want) > 3


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_token_files_equal_plain(spark, odd, unit):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in tokenfiles.token_files(odd, VOCABULARY, unit).collect()]
    assert sorted(got, key=lambda r: r[1]) == plain_tokens(rows)
    assert tokenfiles.token_files(odd.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("plain_specials", [False, True])
def test_words_are_encoded_as_in_the_whole_text(plain_specials):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = plain_specials
    rng = random.Random(8)
    signs = [" ", " ", "  ", "\n", "\t ", " ", "  ", "  ", "　", "ab", "é", "’s", "'s", "don't", "12", "!?", "<|endoftext|>", "\x1c ", "日本", "x"]
    encoder = tokenfiles.Encoder(VOCABULARY, plain_specials)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_long_texts_are_encoded_in_segments(monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT", 50)
    encoder = tokenfiles.Encoder(VOCABULARY)
    text = ("some words  here\n and é there. " * 20).encode()
    assert b"".join(encoder.segments(text)) == encoder.encode([text])[0]


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes_round_trip(unit):
    ids = np.random.default_rng(9).integers(0, 2**32, 1001, dtype=np.uint64).astype("<u4")
    for n in (0, 1, 8, 1001):
        assert (tokenfiles.from_planes(tokenfiles.planes(ids[:n], unit), n, unit) == ids[:n]).all()


def test_words_are_parted_at_spaces_as_the_library_parts_them():
    """Every kind of white space, word and text boundary, against the library on the whole text; what may be odd is found in bulk."""
    rng = random.Random(21)
    blanks = [" ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n ", "  ", "\u0085 ", "  ", "　 ", "  ", "\x1c ", "\x7f "]
    words = ["a", "it's", "naïve", "été", "x" * 300, "…", "漢字", "12,5", "#$%", "<|endoftext|>", "<", "Ġ", "à", "​", "é"]
    texts = ["", " ", " a", "a ", "  a  "] + ["".join(rng.choice(words) + rng.choice(blanks[:1] * 12 + blanks) for _ in range(60)) for _ in range(150)]
    encoder = tokenfiles.Encoder(VOCABULARY)
    got = encoder.encode([t.encode() for t in texts])
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.library.encode(t, add_special_tokens=False).ids
    spaced = [i for i, t in enumerate(texts) if tokenfiles._CUT.split(t.encode()) != t.encode().split(b" ")]
    assert set(spaced) <= tokenfiles._odd([t.encode() for t in texts])


def test_plain_words_reach_the_library_in_one_text(monkeypatch):
    encoder, seen = tokenfiles.Encoder(VOCABULARY), []

    class Noted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **how)

    library, encoder.library = encoder.library, Noted()
    encoder.encode([b"first some plain words"])
    assert len(seen) == 2 and sorted(max(seen, key=len).split(" ")) == ["", "plain", "some", "words"]


def test_parts_of_words_that_were_met_are_not_encoded_again(monkeypatch):
    """Signs after a word, and lines, come from what is known of the parts; the ids are those of the whole text."""
    encoder, seen = tokenfiles.Encoder(VOCABULARY), []

    class Noted:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return library.encode_batch_fast(texts, **how)

    library, encoder.library = encoder.library, Noted()
    encoder.encode([b"Start some\nplain words."])
    seen.clear()
    text = "Start words. words some. some\nplain. plain\nStart."
    got = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == [" plain"]


@pytest.mark.parametrize("plain_specials", [False, True])
def test_words_cut_into_parts_are_encoded_as_in_the_whole_text(plain_specials):
    library = Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = plain_specials
    rng = random.Random(31)
    signs = [
        " ", " ", " ", "\n", "\n", "\n\n", "\r", "\t", "a", "Z", "9", "é", "Ã", "×", "÷", "ß", "ﬁ", "日", "…", "’", "\u00a0", "\u3000", "\u2028", "\x85",
        ".", ",", "!", "?", "...", "#", "$", "%", "&", "*", "@", ":", ";", "'", "'s", "'ll", "'T", "<", "<|endoftext|>", "|>", "(", "\"", "-", "\x00", "\x7f",
    ]
    encoder = tokenfiles.Encoder(VOCABULARY, plain_specials)
    for _ in range(20):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)]
        for t, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
