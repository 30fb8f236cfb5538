"""Filter audit, pivot search and resampling against plain versions."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from semdrift.llm import audit, pivotsearch, resample

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ------------------------------------------------------------------ filter audit


def plain_mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(name for name, fails in (
        ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
        ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text))),
    ) if fails)


def plain_audit(rows, labels):
    """Rows of the report, document by document."""
    good, toxic = ({i for i, *v in labels if v[at] == 1} for at in (0, 1))
    failed = []
    for i, text, part in rows:
        text = text or ""
        known = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        failed.append((part or "", plain_mask(text) + "E" * known, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        shapley = Counter()
        steps = []
        for order in ("".join(p) for p in permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                hit = [f for f in left if letter in f[0]]
                left = [f for f in left if letter not in f[0]]
                shapley[letter] += len(hit)
                steps.append((order, step, letter, len(left), len(hit), sum(letter in f[0] for f in own) - len(hit),
                              sum(f[0] == letter for f in own), sum(f[1] for f in hit), sum(f[2] for f in hit)))
        out += [(part, order, step, *counts, shapley[letter]) for order, step, letter, *counts in steps]
    return sorted(out)


LONG = " ".join(f"word{i}" for i in range(60))
AUDITED = [
    (5, LONG, "s1"), (3, LONG, "s2"), (9, LONG, "s1"), (3, LONG, "s2"), (None, LONG, "s1"), (7, None, None), (2, "", "s1"), (8, "LOUD TEXT #1", "s1"),
    (4, "LOUD TEXT #1", None), (6, "same same " * 40, "s2"), (10, LONG.upper(), "s1"), (1, "x" * 3_000_000 + " y" * 60, "s1"), (11, "Ä" * 19 + "A", "s2"),
    (12, "Ä" * 20 + "A", "s2"), (13, "a\x1fb\x85c " * 50, ""),
]
LABELS = [(5, 1, 0), (3, 0, 1), (3, 1, 0), (8, 1, 1), (None, 1, 1), (99, 1, 1), (6, None, 1)]


def audited(spark, path, **kwargs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, audit.filter_audit(spark, path, labels, **kwargs).collect()))


@pytest.mark.parametrize("batches", [1, 5, 50])
def test_audit_equals_plain_version_in_any_number_of_batches(spark, tmp_path, batches):
    """One file for each row and the larger ids first, so that holders of a text are retracted again and again."""
    for i, row in enumerate(AUDITED):
        one = spark.createDataFrame([(*row, 1, "x")], "doc_id long, text string, source string, mask int, digest string").coalesce(1)
        one.write.mode("append").parquet(str(tmp_path / "docs"))
    assert audited(spark, str(tmp_path / "docs"), batches=batches) == plain_audit(AUDITED, LABELS)


def test_audit_goes_on_where_it_ended(spark, tmp_path):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs, target, checkpoint = (str(tmp_path / n) for n in ("docs", "tables", "progress"))
    later_first = sorted(AUDITED, key=lambda r: -(r[0] or 0))
    for part in (later_first[:6], later_first[6:]):
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(2).write.mode("append").parquet(docs)
        audit.stream_changes(spark, docs, labels, target, checkpoint, 1)
    changes = spark.read.schema(audit.CHANGE_COLUMNS).parquet(*[str(p) for p in (tmp_path / "tables" / "changes").glob("batch=*")])
    assert changes.filter("delta < 0").count() > 0
    assert sorted(map(tuple, audit.report(audit.counters(spark, target)).collect())) == plain_audit(AUDITED, LABELS)


def test_audit_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    assert audited(spark, str(tmp_path / "docs")) == []


def test_labels_are_not_broadcast(spark):
    marked = spark.createDataFrame([(1, "a", b"x", 0, 1), (2, "a", b"y", 1, 2), (None, "b", b"z", 0, 1)], "doc_id long, part string, digest binary, mask int, n long")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    judged = audit.judge(marked, labels)
    plan = judged._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    got = sorted((tuple(r) for r in judged.collect()), key=repr)
    assert [(r[0], *r[5:]) for r in got] == [(1, True, True), (2, False, False), (None, False, False)]


def test_pieces_of_a_text_change_no_mask(monkeypatch):
    texts = [LONG.encode(), b"A" * 500, ("Ä b " * 60).encode(), b"", b"  \n", b"a b " * 30 + b"#"]
    whole = [audit.failures(t) for t in texts]
    monkeypatch.setattr(audit, "PIECE", 7)
    assert [audit.failures(t) for t in texts] == whole


# ------------------------------------------------------------------ pivot search


def plain_top_k(rows, step, k):
    """(query_id, rank, vec_id, score) by all products in whole numbers."""
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i is None or i % step:
            continue
        found = sorted(((-sum(a * b for a, b in zip(q, v)), math.inf if j is None else j, j) for n, (j, v) in enumerate(usable) if n != at))[:k]
        out += [(i, r, j, -s) for r, (s, _, j) in enumerate(found, 1)]
    return sorted(out, key=repr)


def searched(spark, rows, step, k, **kwargs):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, row int").repartition(3)
    return sorted(map(tuple, pivotsearch.top_k(df, F.col("vec_id") % step == 0, k, **kwargs).collect()), key=repr)


def vectors(n, d, seed, kind):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if kind == "groups":
        x = x * 0.05 + rng.normal(size=(8, d))[rng.integers(8, size=n)] * rng.uniform(0.1, 3)
    if kind == "copies":
        x[: n // 3] = x[0]
    return [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("kind", ["anywhere", "groups", "copies"])
def test_search_equals_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(pivotsearch, "BLOCK_ROWS", 24)
    monkeypatch.setattr(pivotsearch, "QUERY_ROWS", 7)
    rows = vectors(400, 6, 3, kind)
    assert searched(spark, rows, 5, 10) == plain_top_k(rows, 5, 10)


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (10, [1.0, 0.5]), (10, [1.0, 0.5]), (20, None), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (None, [3.0, 3.0]),
            (7, [-0.0001, 0.0]), (8, [0.0, 0.0]), (9, []), (60, []), (11, [5.0])]
    rows = [(i, v) for i, v in rows]
    padded = [(i, None if v is None else v + [0.0] * (2 - len(v))) for i, v in rows]
    assert searched(spark, rows, 10, 3) == plain_top_k(padded, 10, 3)
    assert searched(spark, [], 10, 3) == [] == searched(spark, [(1, [1.0])], 10, 3)
    assert searched(spark, [(10, [1.0])], 10, 3) == []


def test_search_past_exact_doubles_and_longs(spark):
    rows = [(i, [float(np.float32(2.0**18 + i)), float(i), -2.0**17]) for i in range(40)]
    assert searched(spark, rows, 10, 4) == plain_top_k(rows, 10, 4)
    with pytest.raises(ValueError, match="long"):
        searched(spark, [(0, [1e30]), (1, [1.0])], 10, 4)


def test_no_bound_is_below_a_score(spark):
    rng = np.random.default_rng(5)
    v = np.floor(1024 * rng.normal(size=(300, 5))).astype(np.int64)
    longest = float(np.sqrt((v * v).sum(1).max()))
    lifted = pivotsearch._lifted(v, longest)
    pivots = pivotsearch.choose_pivots(lifted, 9)
    apart = pivotsearch._apart(lifted, pivots)
    nearest, dist = apart.argmin(1), apart.min(1)
    index = pivotsearch.Index(5, longest, pivots, np.arange(300), nearest, dist, dist)
    q = np.floor(1024 * rng.normal(size=(50, 5)) * rng.uniform(0, 3, (50, 1))).astype(np.int64)
    assert (pivotsearch.reach(index, q) >= q @ v.T).all()


def test_far_groups_are_not_expanded(spark, monkeypatch):
    monkeypatch.setattr(pivotsearch, "BLOCK_ROWS", 16)
    asked = []
    write = pivotsearch.write_and_read

    def counting(df, name):
        out = write(df, name)
        if name == "pivot-wanted":
            asked.append(out.count())
        return out

    monkeypatch.setattr(pivotsearch, "write_and_read", counting)
    rng = np.random.default_rng(6)
    middles = np.eye(8)
    rows = [(i, [float(np.float32(v)) for v in middles[i % 8] + rng.normal(0, 0.001, 8)]) for i in range(800)]
    assert searched(spark, rows, 40, 5) == plain_top_k(rows, 40, 5)
    assert sum(asked) < 0.6 * 20 * 800 / 16


# ------------------------------------------------------------------ resampling


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    return len(words), [crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, share=5, least=20):
    of_docs = [plain_features(t) for _, t in docs]
    s, t = Counter(b for _, f in of_docs for b in f), Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = s.total() + 10_000, t.total() + 10_000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10_000)]
    rows = []
    for (i, _), (n, f) in zip(docs, of_docs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, row in enumerate(order[:len(order) * share // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def resampled(spark, docs, target, **kwargs):
    df = spark.createDataFrame([(i, t, 3, "r") for i, t in docs], "doc_id long, text string, score int, row string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, resample.resample(df, goal, **kwargs).collect()), key=repr)


def test_resample_equals_plain_version(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(50)] + ["Über", "naïve", "9", "Z"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(300)]
    docs += [(5, docs[5][1])] * 30 + [(None, docs[6][1] * 3)] * 3 + [(400, None), (401, ""), (402, "a-b\x00c " * 30), (403, "long " * 300_000), (404, "q" * 2_500_000)]
    target = [" ".join(rng.choice(words[:9], 30)) for _ in range(20)] + [None, ""]
    assert resampled(spark, docs, target, share=20) == plain_resample(docs, target, 20)


def test_resample_of_empty_tables(spark):
    docs = [(i, f"one two {i} " * 10) for i in range(40)]
    assert resampled(spark, [], ["a b"]) == []
    assert resampled(spark, docs, []) == plain_resample(docs, [])


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    for top in (0, 1, 3, 2**40):
        counts = rng.integers(0, top + 1, (5, 300)) * (rng.random((5, 300)) < 0.3)
        for gain in (np.zeros(300, np.int64), rng.integers(-20_000, 20_000, 300), np.full(300, -16_384), rng.integers(0, 2, 300)):
            planes, weight = resample.gain_planes(gain)
            np.testing.assert_array_equal(resample.weigh(counts, planes, weight), counts @ gain)


def test_pieces_of_a_text_change_no_feature(monkeypatch):
    text = "Alpha beta, ünï 12x! " * 40
    whole = Counter(b for _, buckets in resample.bucket_runs(text.encode()) for b in buckets.tolist())
    for piece in (1, 5, 64, 500):
        monkeypatch.setattr(resample, "PIECE", piece)
        assert Counter(b for _, buckets in resample.bucket_runs(text.encode()) for b in buckets.tolist()) == whole
    assert whole == Counter(plain_features(text)[1])
