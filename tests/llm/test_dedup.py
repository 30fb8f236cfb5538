"""Exact, line and SimHash de-duplication against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from semdrift.llm import exact, lines, simhash
from semdrift.session import write_and_read

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(AZ)


# ------------------------------------------------------------------ exact


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max((-1 if x is None else x) for x in ids)
        out.append((i, keep, len(ids), (-1 if i is None else i) == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_minimal_perfect_hash_is_minimal_and_perfect():
    words = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), "<u8").reshape(-1, 4)
    for n in (0, 1, 2, 777, 5000):
        index = exact.build_index(words[:n])
        assert sorted(exact.slots(index, words[:n]).tolist()) == list(range(n))


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError):
        exact.build_index(np.ones((2, 4), np.uint64))


def test_exact_dedup_equals_plain(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = [tuple(r) for r in exact.exact_dedup(odd).collect()]
    assert sorted(got, key=repr) == plain_exact(rows)


def test_exact_dedup_spreads_a_crowded_shard(spark):
    rng = random.Random(1)
    rows = [(i, "Same text" if i % 3 == 0 else f"text {rng.randrange(400)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in exact.exact_dedup(docs).collect()), key=repr) == plain_exact(rows)


def test_known_and_unknown_texts(spark):
    history = spark.createDataFrame([(10, "Old"), (11, "old"), (12, "other")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "OLD"), (2, "new"), (3, "NEW"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs, history).collect()}
    assert got == {1: (11, 2, False), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert exact.exact_dedup(none).count() == 0
    assert lines.drop_boilerplate(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0


# ------------------------------------------------------------------ lines


def plain_lines(rows, ratio, least):
    strip = " \t\r\x0b\x0c"
    pages, has = Counter(), Counter()
    for _, host, text in rows:
        pages[host] += 1
        for x in {x.strip(strip) for x in text.split("\n")} - {""} if text is not None else ():
            has[host, x] += 1
    drop = {k for k, n in has.items() if n >= least and n >= pages[k[0]] * ratio}
    return sorted(
        ((i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(strip)) not in drop)) for i, h, t in rows), key=repr)


@pytest.mark.parametrize("shipped", [True, False])
def test_line_dedup_equals_plain(spark, monkeypatch, shipped):
    if not shipped:
        monkeypatch.setattr(lines, "SHIPPED_LINES", 0)
    rng = random.Random(2)
    rows = [
        (i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", " menu ", f"own {i}", "", "half" if i % 2 else "x"]) for _ in range(5)))
        for i in range(60)
    ] + [(90, "a", None), (91, "b", ""), (92, None, "menu\n\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = lines.drop_boilerplate(docs, ratio=0.4, min_pages=3, n_lines="n", n_dropped="k")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == plain_lines(rows, 0.4, 3)
    for r in got.collect():
        assert r.k == r.n - (0 if r.text is None else len(r.text.split("\n"))) or r.text == ""


def test_line_dedup_keeps_odd_rows_and_columns(spark, odd):
    got = lines.drop_boilerplate(odd)
    assert got.columns == odd.columns
    assert sorted(got.collect(), key=repr) == sorted(odd.collect(), key=repr)


# ------------------------------------------------------------------ SimHash


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints):
    """Component of each fingerprint by comparing all pairs."""
    nodes = sorted(set(prints))
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {x: find(x) for x in nodes}


def test_every_pair_within_the_radius_shares_a_table():
    rng, masks = random.Random(3), simhash.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(diff & m == 0 for m in masks)


def test_fingerprints_equal_plain(odd):
    got = {(r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(odd).collect()}
    assert got == {(r.doc_id, plain_print(r.text)) for r in odd.collect()}


@pytest.mark.parametrize("block", [2048, 16])
def test_links_equal_all_pairs(spark, block):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):  # crowds whose members differ in few bits, some crowds near others
        centre = rng.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints |= {rng.getrandbits(64) for _ in range(60)} | {0, 1, 2**64 - 1}
    signed = [(simhash._signed(x),) for x in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), block=block).collect()
    got = {r.id % (1 << 64): r.root for r in links}
    want = plain_classes(prints)
    classes = defaultdict(set)
    for x, r in want.items():
        classes[r].add(x)
    mine = defaultdict(set)
    for x in prints:
        mine[got.get(x, simhash._signed(x))].add(x)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates_of_odd_rows(odd):
    rows = odd.collect()
    prints = [plain_print(r.text) for r in rows]
    root = plain_classes(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]] = min(least.get(root[p], r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", least.get(root[p])) for r, p in zip(rows, prints)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=repr) == want


@pytest.mark.parametrize("n_pages", [50, 400, 2000])
def test_default_ratio_at_several_host_sizes(spark, n_pages):
    """A line on one page in 40 goes on hosts of all sizes where three pages have it; one on 1 in 200 stays."""
    rows = [
        (i, "h", "\n".join([f"own {i}"] + ["menu"] * (i % 12 == 0) + ["footer"] * (n_pages > 50 and i % 40 == 0) + ["quote"] * (i % 200 == 0)))
        for i in range(n_pages)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    left = {x for r in lines.drop_boilerplate(docs).collect() for x in r.text.split("\n")}
    assert left == {f"own {i}" for i in range(n_pages)} | {"quote"}


def test_buckets_are_not_broadcast(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return write_and_read(df, name)

    monkeypatch.setattr(simhash, "write_and_read", kept)
    near = spark.createDataFrame([(x,) for x in (0, 1, 3, 1 << 40, 1 << 41)], "fp long")
    assert {r.root for r in simhash.fingerprint_links(near).collect()} == {0}
    assert "BroadcastHashJoin" not in plans["buckets"] and "SortMergeJoin" in plans["buckets"]
