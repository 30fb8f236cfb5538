
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from semdrift.operators import descent, embed, nearest, reduce, similar
from semdrift.operators import drift as D


def frame(spark, x, start=0):
    return spark.createDataFrame([(i + start, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def collect(df, key="id", col="v"):
    return np.array([r[col] for r in df.orderBy(key).collect()])


def test_pca_equals_numpy(spark):
    x = np.random.default_rng(0).normal(size=(80, 6)) @ np.random.default_rng(1).normal(size=(6, 6))
    x = np.column_stack([x, np.full(80, 0.1)])  # a constant dimension
    coords, fit = reduce.pca_coordinates(frame(spark, x), "id", "v", 50)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    z[:, -1] = 0
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    scores = u * s
    signs = np.sign(scores[np.abs(scores).argmax(0), np.arange(scores.shape[1])])
    assert fit.k == 7
    np.testing.assert_allclose(fit.ratio[:6], (s**2 / (s**2).sum())[:6], atol=1e-9)
    np.testing.assert_allclose(collect(coords, col="pos")[:, :6], (scores * signs)[:, :6], atol=1e-6)
    variance = reduce.variance_table(coords, fit)
    assert variance.orderBy("component").collect()[-1]["cumulative_variance"] == pytest.approx(1.0)
    need = int(np.searchsorted(np.cumsum(s**2 / (s**2).sum()), 0.95) + 1)
    assert reduce.components_needed(variance).head()[0] == need


def test_components_not_reached(spark):
    table = spark.createDataFrame([(1, 0.5), (2, 0.2)], "component int, explained_variance double")
    assert reduce.components_needed(reduce.cumulative(table)).head()[0] == 3


def test_few_rows_limit_components(spark):
    _, fit = reduce.pca_coordinates(frame(spark, np.random.default_rng(2).normal(size=(4, 6))), "id", "v", 50)
    assert fit.k == 3


def brute_knn(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    d = np.round(d, 9)
    return [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


@pytest.mark.parametrize("group", [40, None])
def test_knn_equals_brute_force(spark, group):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(90, 3)) + 30, np.ones((50, 3))])  # a crowd of copies
    got = {}
    for r in similar.knn(frame(spark, x), "id", "v", 4, group).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbor"]
    want = brute_knn(x, 4)
    assert {i: [got[i][r] for r in (1, 2, 3, 4)] for i in got} == dict(enumerate(want))


def clustered(n, seed=0, d=8):
    """Vectors around 40 middles of very different sizes; a tenth lie anywhere."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 10, (40, d))
    at = rng.choice(40, n, p=(p := 1 / np.arange(1, 41)) / p.sum())
    x = middles[at] + rng.normal(0, 0.5, (n, d))
    x[: n // 10] = rng.uniform(-30, 30, (n // 10, d))
    return x


def test_tree_search_is_exact_and_ships_little(spark, monkeypatch):
    k, shipped = 5, {}
    write = nearest.write_and_read

    def counting(df, name):
        out = write(df, name)
        if name == "nearest-asked":
            shipped[n] = shipped.get(n, 0) + out.count() * nearest.group_rows(n) // 4
        return out

    monkeypatch.setattr(nearest, "write_and_read", counting)
    for n in (2000, 8000, 32_000):
        x = clustered(n)
        rows = spark.createDataFrame(pd.DataFrame({"id": range(n), "vec": list(x)}), "id bigint, vec array<double>").repartition(8)
        found = nearest.search(rows, k).toPandas().sort_values(["id", "rank"])
        assert len(found) == n * k
        got = found.neighbor.to_numpy().reshape(n, k)
        for at in range(0, n, 2000):
            part = x[at:at + 2000]
            d = np.sqrt(np.maximum((part ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None] - 2 * part @ x.T, 0))
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            want = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
            np.testing.assert_allclose(np.take_along_axis(d, got[at:at + 2000], axis=1), want, atol=1e-6)
    # Rows shipped to groups (a block counts as full): sixteen times the rows, far less than 256 times the copies.
    assert shipped[32_000] < 64 * shipped[2000]
    assert nearest.group_rows(500) < 500  # several groups on the smallest table of vectors


@pytest.mark.parametrize("kind", ["clustered", "anywhere"])
def test_descent_finds_most_neighbours(spark, kind):
    x = clustered(3000) if kind == "clustered" else np.random.default_rng(9).normal(size=(2000, 24))
    x[:60] = x[0]  # a crowd of copies
    rows = frame(spark, x).repartition(6)
    exact = similar.knn(rows, "id", "v", 10).cache()
    found = similar.knn(rows, "id", "v", 10, exact=False).cache()
    shares = {r["rank"]: r["recall"] for r in descent.recall(found, exact).collect()}
    assert sorted(shares) == list(range(1, 11)) and min(shares.values()) >= 0.9
    assert found.groupBy("id").count().filter("count <> 10").count() == 0
    assert found.join(exact.select("id", "neighbor", F.col("distance").alias("d")), ["id", "neighbor"]).filter("distance <> d").count() == 0
    few = similar.knn(frame(spark, x[:3]), "id", "v", 5, exact=False)
    assert few.count() == 6 and similar.knn(rows.filter("id < 0"), "id", "v", 5, exact=False).count() == 0


def test_tree_search_for_other_queries(spark):
    rng = np.random.default_rng(8)
    c, q = clustered(3000, 1, 4), np.concatenate([clustered(300, 2, 4), rng.normal(1000, 1, (20, 4))])
    found = nearest.search(frame(spark, c).withColumnRenamed("v", "vec"), 3, frame(spark, q).withColumnRenamed("v", "vec"), 100)
    got = found.toPandas().sort_values(["id", "rank"]).neighbor.to_numpy().reshape(len(q), 3)
    d = np.round(np.linalg.norm(q[:, None] - c[None], axis=2), 9)
    assert (got == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_tree_search_of_few_and_equal_rows(spark):
    few = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0]])).withColumnRenamed("v", "vec")
    assert sorted((r.id, r.neighbor, r.distance, r["rank"]) for r in nearest.search(few, 5).collect()) == [(0, 1, 1.0, 1), (1, 0, 1.0, 1)]
    assert nearest.search(few.filter("id < 0"), 5).count() == 0 == nearest.search(few, 5, few.filter("id < 0")).count()
    same = frame(spark, np.ones((900, 2))).withColumnRenamed("v", "vec")
    found = nearest.search(same, 2, group=64).filter("id >= 2").select("neighbor", "distance").distinct().collect()
    assert sorted(map(tuple, found)) == [(0, 0.0), (1, 0.0)]


def test_vectors_of_no_length_are_at_right_angles(spark):
    corpus = frame(spark, np.array([[0.0, 0.0], [1.0, 0.0], [0.0, -2.0]])).withColumnRenamed("v", "embedding")
    queries = frame(spark, np.array([[0.0, 0.0], [1.0, 0.1]])).withColumnsRenamed({"v": "embedding", "id": "q"})
    both = [similar.top_k_similar(corpus, queries, 3, "id", "q", max_shipped=m).collect() for m in (1, 1 << 20)]
    sides = [sorted((r["query"], r["id"], r["rank"], round(r["cosine"], 6)) for r in rows) for rows in both]
    assert sides[0] == sides[1]


@pytest.mark.parametrize("shipped", [64 << 20, 100])
def test_top_k_equals_brute_force(spark, shipped):
    rng = np.random.default_rng(4)
    c, q = rng.normal(size=(150, 5)), rng.normal(size=(20, 5))
    corpus = frame(spark, c).withColumnRenamed("v", "embedding").repartition(5)
    queries = frame(spark, q).withColumnsRenamed({"v": "embedding", "id": "q"})
    got = {}
    for r in similar.top_k_similar(corpus, queries, 3, "id", "q", max_shipped=shipped).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], r["cosine"])
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    for i in range(20):
        best = np.argsort(-cos[i])[:3]
        assert [got[i][r][0] for r in (1, 2, 3)] == list(best)
        np.testing.assert_allclose([got[i][r][1] for r in (1, 2, 3)], cos[i][best], atol=1e-8)


def test_hash_embedding_by_hand(spark):
    texts = ["alpha beta alpha", "", "gamma", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r["e"] for r in df.select("id", embed.hash_embedding(F.col("text"), 16).alias("e")).orderBy("id").collect()]
    for text, vec in zip(texts, got):
        want = np.zeros(16)
        for w in (text or "").split():
            code = embed.word_code(w)
            want[(code >> 4) % 16] += 1 - 2 * (code & 1)
        size = np.linalg.norm(want)
        np.testing.assert_allclose(vec, want / size if size else want, atol=1e-6)


def test_two_texts_and_batches(spark):
    pair = ["This is a test executive order about national security.", "This order concerns economic policy and regulation."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pair)], "id int, text string")
    for vectors in (embed.embed_documents(df, "id"), embed.encode_with_model(df, "id", embed.ngram_model())):
        a, b = [np.array(r["embedding"]) for r in vectors.orderBy("id").collect()]
        assert len(a) > 0 and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) < 1
    ten = spark.createDataFrame([(i, f"Test text {i}") for i in range(10)], "id int, text string")
    assert embed.encode_with_model(ten, "id", embed.ngram_model(), batch_size=3).count() == 10


def test_incremental_store(spark):
    calls = []

    def encode(docs):
        calls.append(docs.count())
        return docs.select("filename", "content_md5", F.array(F.lit(1.0).cast("float")).alias("embedding"))

    def snapshot(rows):
        return spark.createDataFrame(rows, "filename string, text string").withColumn("content_md5", F.md5("text"))

    first = snapshot([("a", "1"), ("b", "2"), ("c", "3")])
    store = embed.refresh_store(first, None, encode)
    second = snapshot([("a", "1"), ("b", "changed"), ("d", "4")])
    again = embed.refresh_store(second, store, encode)
    assert sorted(r["filename"] for r in again.collect()) == ["a", "b", "d"]
    embed.refresh_store(second, again, encode)
    assert calls == [3, 2, 0]
    assert embed.store_is_valid(second, again).head()["valid"] and not embed.store_is_valid(first, again).head()["valid"]


def test_drift_edges(spark):
    rows = [("2000", [1.0, 0.0]), ("2000", [1.0, 0.0]), ("2003", [0.0, 1.0]), ("2004", [0.0, 0.0]), ("Unknown", [9.0, 9.0])]
    df = spark.createDataFrame(rows, "year string, embedding array<double>")
    centroids = D.yearly_centroids(df)
    moves = [tuple(r) for r in D.consecutive_drift(centroids).orderBy("to_year").collect()]
    assert moves == [(2000, 2003, 1.0), (2003, 2004, 1.0)]
    single = D.yearly_centroids(df.filter("year = '2000'"))
    assert D.consecutive_drift(single).count() == 0
    trend = D.trend(D.centroid_positions(single)).head()
    assert (trend["slope"], trend["n_years"]) == (0.0, 1)


def test_positions_equal_numpy(spark):
    x = np.random.default_rng(5).normal(size=(12, 4))
    rows = [(2000 + 2 * i, 1, [float(v) for v in r]) for i, r in enumerate(x)]
    centroids = spark.createDataFrame(rows, "year int, n int, centroid array<double>")
    got = D.centroid_positions(centroids).orderBy("year").collect()
    c = x - x.mean(0)
    scores = c @ np.linalg.svd(c, full_matrices=False)[2][0]
    scores *= np.sign(scores[np.abs(scores).argmax()])
    np.testing.assert_allclose([r["position"] for r in got], scores, atol=1e-9)
    slope = np.polyfit(range(12), scores, 1)[0]
    assert D.trend(D.centroid_positions(centroids)).head()["slope"] == pytest.approx(slope)


def test_unit_computes_a_length_once(spark):
    """A long vector takes time in proportion to its length, not to its square."""
    import time

    from semdrift.functions.vectors import unit

    rows = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda x: x.cast("double")).alias("v"))
    began = time.time()
    found = rows.select(F.aggregate(unit(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert time.time() - began < 15
    assert all(abs(r["n"] - 1) < 1e-9 for r in found)
    odd = spark.createDataFrame([([3.0, 4.0],), ([],), (None,), ([0.0],)], "v array<double>").select(unit(F.col("v"))).collect()
    assert [r[0] for r in odd] == [[0.6, 0.8], [], None, [0.0]]


def test_learned_and_weighted_vectors_clean_the_texts_once(spark, sf_dir):
    """What the last pass reads is the kept table, not the documents."""
    from semdrift.plans.catalog import load

    for key in ("e04_weighted_hash_embedding", "e05_learned_embedding"):
        assert not [f for f in load()[0][key](spark, sf_dir).inputFiles() if "documents.parquet" in f]


def test_a_neighbour_task_holds_its_distances_once():
    import tracemalloc

    import pyarrow as pa

    from semdrift.functions.arrow import from_matrix
    from semdrift.operators import nearest

    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 3, (300, 6)) * 0.1, rng.integers(0, 3, (30_000, 6)) * 0.1  # many ties
    y[:] += rng.normal(size=y.shape) * (np.arange(len(y)) % 3 > 0)[:, None]
    ids = rng.permutation(30_000)

    def table(v, names, **more):
        return pa.table({"id": pa.array(names, pa.int64()), "vec": from_matrix(v, pa.float64()), **more})

    d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)), nearest.DECIMALS)
    want = [ids[np.lexsort((ids, row))[:15]].tolist() for row in d]
    some = np.sort(d, axis=1)[:, 4]
    for kth in (np.full(len(x), np.nan), some):
        n = pa.array(np.zeros(len(x), np.int64))
        asking = table(x, np.arange(len(x)), grp=n, leaf=n, kth=pa.array(kth, from_pandas=True))
        tracemalloc.start()
        got = nearest._meet(15, False)(asking, table(y, ids))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 3 * 8 * nearest.MAX_CELLS
        lists = [[] for _ in x]
        for i, j in zip(got.column("id").to_pylist(), got.column("neighbor").to_pylist()):
            lists[i].append(j)
        limit = np.where(np.isnan(kth), np.inf, kth)
        place = {int(i): at for at, i in enumerate(ids)}
        assert lists == [[j for j in w if d[i, place[j]] <= limit[i]] for i, w in enumerate(want)]


@pytest.mark.parametrize("scale", [1e-14, 1.0, 1e6, 1e18])
def test_only_distances_that_may_count_are_worked_out(monkeypatch, scale):
    """A rough product rules pairs out, far from the origin as well; no block of distances is made."""
    import pyarrow as pa

    from semdrift.functions.arrow import from_matrix
    from semdrift.operators import nearest

    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 12)) * scale + 1000 * scale
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), nearest.DECIMALS)
    np.fill_diagonal(d, np.inf)
    ids, worked = np.arange(2000), []
    want = [[j for j in np.lexsort((ids, row))[:4]] for row in d]
    plain = nearest.distances

    def counted(a, b):
        worked.append(len(a) * len(b))
        return plain(a, b)

    monkeypatch.setattr(nearest, "distances", counted)
    kth, n = np.full(2000, np.nan), pa.array(np.zeros(2000, np.int64))
    for _ in range(2):  # without limits, then with those found
        table = pa.table({"id": pa.array(ids), "vec": from_matrix(x, pa.float64()), "grp": n, "leaf": n, "kth": pa.array(kth, from_pandas=True)})
        got = nearest._meet(4, True)(table, table.select(["id", "vec"]))
        lists = [[] for _ in x]
        for i, j in zip(got.column("id").to_pylist(), got.column("neighbor").to_pylist()):
            lists[i].append(j)
        assert lists == want
        kth = np.zeros(2000)
        np.maximum.at(kth, got.column("id").to_numpy(), got.column("distance").to_numpy())
    assert sum(worked) == 2000 * nearest.HEAD
