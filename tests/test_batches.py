import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semdrift.operators import batches
from semdrift.operators.skew import number_rows


def test_record_shapes(spark):
    lines = ['["a","b"]', '["a","b","c"]', '{"texts":["x","y"]}', '{"response":"r","context":"c"}', '{"response":"r"}', "junk"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, line string").orderBy("i")
    got = df.select(batches.unify_record(F.col("line")).alias("t"), batches.response_context(F.col("line")).alias("p")).collect()
    assert [r["t"] for r in got] == [["a", "b"], ["a", "b", "c"], ["x", "y"], None, None, None]
    assert [r["p"] for r in got] == [None, None, None, ["r", "c"], None, None]


def test_arity(spark):
    rows = [("m", ["a", "b"]), ("m", ["c", "d"]), ("m", ["e", "f", "g"]), ("t", ["1", "2", "3"])]
    verdict, rejects = batches.check_arity(spark.createDataFrame(rows, "dataset string, texts array<string>"))
    assert {r["dataset"]: r["ok"] for r in verdict.collect()} == {"m": False, "t": True}
    assert [tuple(r["texts"]) for r in rejects.collect()] == [("e", "f", "g")]


def test_sizes_must_divide():
    plan = batches.BatchPlan(64, 8, 2)
    assert (plan.global_size, plan.per_dataset) == (512, 256)
    for bad in ((5, 1, 2), (0, 1, 1), (4, 2, 4)):
        with pytest.raises(ValueError):
            batches.BatchPlan(*bad)


def test_draws_follow_weights_and_arity(spark):
    weights = [("a", 5, 2), ("b", 1, 2), ("c", 2, 3), ("d", 2, 3)]
    draws = batches.draw_datasets(spark.range(4000).withColumnRenamed("id", "batch"), weights, 2, 1).collect()
    arity = {n: a for n, _, a in weights}
    by_batch = {}
    for r in draws:
        by_batch.setdefault(r["batch"], set()).add(arity[r["dataset"]])
    assert all(len(v) == 1 for v in by_batch.values())
    first = Counter(r["dataset"] for r in draws if r["draw"] == 0)
    for name, weight, _ in weights:
        assert abs(first[name] / 4000 - weight / 10) < 0.03


def test_epoch_order_changes_with_the_epoch(spark):
    df = spark.range(50).select("id", F.lit("d").alias("dataset"))
    orders = [[r["id"] for r in batches.shuffled(df, "id", 1, e).orderBy("ord").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(50))


def test_batches_never_repeat_a_text(spark):
    """A third of all samples shares one text."""
    rows = [(i, ["hot" if i % 3 == 0 else f"t{i % 40}", f"u{i}"]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, texts array<string>")
    ordered = number_rows(df.withColumn("_k", F.md5(F.col("id").cast("string"))), [F.col("_k"), F.col("id")])
    got = batches.unique_batches(ordered, "id", 20).collect()
    assert sorted(r["id"] for r in got) == list(range(300))
    texts = dict(rows)
    placed = {}
    for r in got:
        if r["batch"] is not None:
            placed.setdefault(r["batch"], []).append(r)
    for batch, members in placed.items():
        seen = Counter(t for r in members for t in texts[r["id"]])
        assert max(seen.values()) == 1 and len(members) <= 20
        assert all(r["complete"] == (len(members) == 20) for r in members)
    assert len(placed) == 15
    for r in got:  # whatever waits would repeat a text in every short batch
        if r["batch"] is None:
            for members in placed.values():
                assert len(members) == 20 or set(texts[r["id"]]) & {t for m in members for t in texts[m["id"]]}


def faults_by_hand(uses, texts, arity):
    """Checks batches row by row: (repeats, mixed arities, waiting samples that fit a short batch of their dataset)."""
    members = {}
    for use, batch, dataset, i in uses:
        if batch is not None:
            members.setdefault(batch, []).append((dataset, i))
    repeats = sum(max(Counter(t for _, i in m for t in set(texts[i])).values()) > 1 for m in members.values())
    mixed = sum(len({arity[d] for d, _ in m}) > 1 for m in members.values())
    return members, repeats, mixed


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_over_draws_reach_a_fixed_point(spark, seed):
    """Datasets of very different sizes, a text that half of one dataset shares, pairs of texts that bar each other."""
    rows = [(("a", "b", "c")[i % 7 // 3], i, [f"t{i % 90}", "hot" if i % 2 and i % 7 < 3 else f"u{i % 70}"]) for i in range(700)]
    rows = [(d, i, [*t, f"w{i % 33}"] if d == "c" else t) for d, i, t in rows]
    samples = spark.createDataFrame(rows, "dataset string, id bigint, texts array<string>")
    weights, plan, n = [("a", 3, 2), ("b", 2, 2), ("c", 1, 3)], batches.BatchPlan(5, 2, 2), 60
    found = batches.training_batches(samples, "id", weights, plan, n, seed)
    capacity = batches.batch_capacity(spark, weights, plan, n, seed)
    uses, texts = [tuple(r) for r in found.collect()], {i: t for _, i, t in rows}
    members, repeats, mixed = faults_by_hand(uses, texts, {n: a for n, _, a in weights})
    assert repeats == mixed == 0 and len({u[0] for u in uses}) == len(uses)
    assert {u[3] for u in uses} == set(texts)  # no sample is lost
    room = {(r["batch"], r["dataset"]): r["places"] for r in capacity.collect()}
    for batch, m in members.items():
        for dataset, k in Counter(d for d, _ in m).items():
            assert k <= room[batch, dataset]
            room[batch, dataset] -= k
    for (batch, dataset), left in room.items():
        if left:
            there = {t for _, i in members.get(batch, []) for t in texts[i]}
            assert all(set(texts[i]) & there for _, b, d, i in uses if b is None and d == dataset)
    faults = batches.batch_faults(found, samples, "id", capacity).collect()
    assert len(faults) == n and all((r["places"], r["over"], r["arities"], r["repeats"], r["fitting"]) == (plan.global_size, 0, 1, 0, 0) for r in faults)


def test_faults_are_seen(spark):
    rows = [("a", i, [f"t{i % 5}", f"u{i}"]) for i in range(12)] + [("b", 20, ["x", "y", "z"])]
    samples = spark.createDataFrame(rows, "dataset string, id bigint, texts array<string>")
    capacity = spark.createDataFrame([(0, "a", 4), (0, "b", 4), (1, "a", 2)], "batch bigint, dataset string, places bigint")
    uses = [(0, 0, "a", 0), (1, 0, "a", 5), (2, 0, "b", 20), (3, 1, "a", 1), (4, 1, "a", 2), (5, 1, "a", 3), (6, None, "a", 4), (7, None, "a", 10)]
    found = spark.createDataFrame(uses, "use bigint, batch bigint, dataset string, id bigint")
    rows = {r["batch"]: r for r in batches.batch_faults(found, samples, "id", capacity).collect()}
    assert (rows[0]["arities"], rows[0]["repeats"], rows[0]["fitting"], rows[0]["over"]) == (2, 1, 1, 0)
    assert (rows[1]["arities"], rows[1]["repeats"], rows[1]["fitting"], rows[1]["over"]) == (1, 0, 0, 1)
    uses = {r["use"]: r for r in batches.use_faults(found, samples, "id", capacity).collect()}
    assert {u: (r["repeats"], r["fitting"]) for u, r in uses.items() if r["repeats"] or r["fitting"]} == {0: (1, 0), 1: (1, 0), 6: (0, 1)}
    assert sorted(uses) == list(range(8))


def test_lost_samples_are_missed(spark, sf_dir, monkeypatch):
    """Batches that lose samples differ from the SQL: the query has a row for each use of a sample, also of those passed over."""
    from oracle import compare, connect
    from semdrift.plans.catalog import load

    key = "p05_unique_batches"
    query, sql = (found[key] for found in load())
    assert compare(spark, connect(sf_dir), sf_dir, query, sql)[0] is None
    whole = batches.training_batches
    monkeypatch.setattr(batches, "training_batches", lambda *a, **b: whole(*a, **b).filter("batch IS NOT NULL"))
    assert compare(spark, connect(sf_dir), sf_dir, query, sql)[0] is not None
