import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.config import AnalysisSettings
from semdrift.operators import layout, mesh, quadtree, reduce
from semdrift.operators.similar import knn


def points(spark, n=90, d=8):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, d)) * 6
    x = np.concatenate([rng.normal(c, 1.0, size=(n // 3, d)) for c in centres])
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def trust(x, y, k=10):
    dx, dy = (np.linalg.norm(a[:, None] - a[None], axis=2) for a in (x, y))
    for d in (dx, dy):
        np.fill_diagonal(d, np.inf)
    rank = dx.argsort(1).argsort(1) + 1
    near = dy.argsort(1)[:, :k]
    n = len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(np.maximum(rank[i, near[i]] - k, 0).sum() for i in range(n))


def test_weights(spark):
    _, df = points(spark)
    near = knn(df, "id", "v", 10)
    member = layout.neighbor_weights(near, "umap").groupBy("id").agg(F.sum("weight").alias("s")).collect()
    np.testing.assert_allclose([r["s"] for r in member], np.log2(10), atol=1e-4)
    rows = layout.neighbor_weights(near, "tsne", 5).groupBy("id").agg(F.collect_list("weight").alias("w")).collect()
    for r in rows:
        p = np.array(r["w"])
        assert abs(p.sum() - 1) < 1e-9 and abs(np.exp(-(p * np.log(p)).sum()) - 5) < 1e-3
    both = layout.symmetrise(layout.neighbor_weights(near, "tsne", 5), "tsne")
    assert abs(both.agg(F.sum("w")).head()[0] - 1) < 1e-9
    flipped = both.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    assert both.exceptAll(flipped).count() == 0


def test_layouts_keep_neighbourhoods(spark, monkeypatch):
    """Finished layouts over several parts keep more than the principal axes."""
    monkeypatch.setattr(layout.nearest, "LEAST_GROUP", 32)
    monkeypatch.setattr(layout.nearest, "group_rows", lambda n: 32)
    monkeypatch.setattr(layout, "CELL_PARTS", 2)
    x, df = points(spark)
    settings = AnalysisSettings(perplexity=8, tsne_iterations=120)
    found = layout.reduce_all(df, "id", "v", settings)
    assert set(found) == {"pca", "tsne", "umap"}
    flat = {m: np.array([(r["x"], r["y"]) for r in reduce.xy(t, "id").orderBy("id").collect()]) for m, t in found.items()}
    for method, y in flat.items():
        assert y.shape == (90, 2) and np.isfinite(y).all()
    z = (x - x.mean(0)) / x.std(0)
    base = trust(z, flat["pca"])
    assert trust(z, flat["umap"]) > base and trust(z, flat["tsne"]) > base


def test_parts_do_not_change_a_layout(spark, monkeypatch):
    """The same forces whether points lie in one part or in many; the first epochs agree to rounding and tree error."""
    _, df = points(spark)
    runs = []
    for size in (1000, 16):
        monkeypatch.setattr(layout.nearest, "group_rows", lambda n, size=size: size)
        rows = layout.reduce_all(df, "id", "v", AnalysisSettings(perplexity=8, tsne_iterations=4), epochs=4, methods=("tsne", "umap"))
        runs.append({m: np.array([r["pos"] for r in t.orderBy("id").collect()]) for m, t in rows.items() if m != "pca"})
    for method in ("tsne", "umap"):
        np.testing.assert_allclose(runs[0][method], runs[1][method], atol=1e-6 * np.ptp(runs[0][method]))


def test_crowds_and_points_without_edges(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.repeat([[5.0, 5.0, 5.0]], 60, axis=0), rng.normal(size=(40, 3))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    settings = AnalysisSettings(perplexity=5, tsne_iterations=12, umap_neighbors=6)
    found = layout.reduce_all(df, "id", "v", settings, epochs=6)
    for method in ("tsne", "umap"):
        rows = {r["id"]: r["pos"] for r in found[method].collect()}
        assert sorted(rows) == list(range(100)) and np.isfinite(list(rows.values())).all()
    coords = df.select("id", F.col("v").alias("pos"))
    alone = layout.umap_layout(coords, "id", spark.createDataFrame([], "u bigint, v bigint, w double"), epochs=2)
    assert alone.count() == 100
    assert layout.umap_layout(coords.filter("id < 0"), "id", spark.createDataFrame([], "u bigint, v bigint, w double"), epochs=2).count() == 0


def plain_push(p, w, kernel):
    dx, dy = p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1]
    return np.array([(v * w[None, :] * (1 - np.eye(len(p)))).sum(1) for v in kernel(dx, dy)])


@pytest.mark.parametrize("spread", [0.2, 5.0, 60.0])
def test_push_is_within_a_percent_of_the_direct_sum(spread):
    def kernel(dx, dy):
        q = 1 / (1 + dx * dx + dy * dy)
        return q * q * dx, q * q * dy, q

    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, spread, (1500, 2)), rng.normal(spread, spread / 20, (500, 2)), np.full((20, 2), spread)])
    w = rng.integers(1, 4, len(p)).astype(float)
    side = layout._side(np.ptp(p))
    halves = [quadtree.count_cells(*p[at].T, w[at], side) for at in (slice(0, 700), slice(700, None))]
    tree = quadtree.build(*quadtree.coarser(quadtree.merge_cells(halves), side))
    got, want = quadtree.push(tree, p[:, 0], p[:, 1], w, kernel), plain_push(p, w, kernel)
    assert np.linalg.norm(got[:2] - want[:2]) < 0.01 * np.linalg.norm(want[:2])
    assert abs(got[2].sum() - want[2].sum()) < 0.01 * want[2].sum()
    exact = quadtree.push(tree, p[:, 0], p[:, 1], w, kernel, theta=0.0)
    assert np.linalg.norm(exact[:2] - want[:2]) < 1e-3 * np.linalg.norm(want[:2])


def closeness(dx, dy):
    q = 1 / (1 + dx * dx + dy * dy)
    return q * q * dx, q * q * dy, q


@pytest.mark.parametrize("spread", [0.2, 5.0, 40.0])
def test_mesh_is_within_a_percent_of_the_direct_sum(spread):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.normal(0, spread, (1500, 2)), rng.normal(spread, spread / 20, (500, 2)), np.full((20, 2), spread)])
    w = rng.integers(1, 4, len(p)).astype(float)
    want = plain_push(p, w, closeness)
    assert mesh.fits(*p.T) and not mesh.fits(*(1000 * p.T)) and not mesh.fits(*(1e-4 * p.T))
    for own in (slice(0, len(p)), slice(300, 900)):
        got, z = mesh.push(*p.T, w, own)
        assert np.linalg.norm(got - want[:2, own]) < 0.01 * np.linalg.norm(want[:2, own])
        assert abs(z - (want[2] * w).sum()) < 0.001 * (want[2] * w).sum()


@pytest.mark.parametrize("kind", ["pairs", "mesh", "tree"])
def test_push_of_own_points(kind):
    p = np.random.default_rng(5).normal(0, 400.0 if kind == "tree" else 9.0, (700, 2))
    w = np.ones(len(p))
    want = plain_push(p, w, closeness)
    parts = [layout._push_all(*p.T, w, own, closeness, 700 if kind == "pairs" else 0) for own in (slice(0, 250), slice(250, 700))]
    got, z = np.concatenate([f for f, _ in parts], axis=1), sum(share for _, share in parts)
    near = 1e-9 if kind == "pairs" else 0.01
    assert np.linalg.norm(got - want[:2]) < near * np.linalg.norm(want[:2]) and abs(z - want[2].sum()) < near * want[2].sum()


def test_an_epoch_of_tsne_shuffles_nothing(spark, monkeypatch):
    """Places of all points go to the tasks; the layout is that of epochs which shuffle places, to the error of their tree."""
    _, df = points(spark)
    coords = df.select("id", F.col("v").alias("pos"))
    edges = layout.symmetrise(layout.neighbor_weights(knn(df, "id", "v", 12), "tsne", 4), "tsne")
    heavy = spark.createDataFrame([(3, 5.0), (50, 2.0)], "id bigint, weight double")
    shuffled, runs = layout._run, []

    def refused(*_):
        raise AssertionError("shuffled")

    for most, run in ((layout.MOST_SENT, refused), (0, shuffled)):
        monkeypatch.setattr(layout, "MOST_SENT", most)
        monkeypatch.setattr(layout, "_run", run)
        rows = layout.tsne_layout(coords, "id", edges, 6, weights=heavy).orderBy("id").collect()
        runs.append(np.array([(r["x"], r["y"]) for r in rows]))
    assert runs[0].shape == (90, 2)
    np.testing.assert_allclose(runs[0], runs[1], atol=0.005 * np.ptp(runs[1]))


def test_cells_become_coarser_until_few(monkeypatch):
    monkeypatch.setattr(quadtree, "MOST_CELLS", 30)
    p = np.random.default_rng(2).normal(size=(400, 2))
    cells, side = quadtree.coarser(quadtree.count_cells(p[:, 0], p[:, 1], np.ones(400), 0.01), 0.01)
    assert len(cells) <= 30 and cells[:, 2].sum() == 400 and side > 0.01
    np.testing.assert_allclose(cells[:, 3:].sum(0), p.sum(0))


def test_layout_is_repeatable(spark):
    _, df = points(spark, 45)
    runs = [layout.reduce_all(df, "id", "v", epochs=2, methods=("umap",))["umap"].orderBy("id").collect() for _ in range(2)]
    np.testing.assert_allclose(*[[r["pos"] for r in rows] for rows in runs], atol=1e-6)


def test_curve_matches_known_values():
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.03


def test_each_part_has_a_partition_of_its_own(spark, monkeypatch):
    """No task of an epoch works on two parts while others have none, and the fixed rows stay where they lie."""
    monkeypatch.setattr(layout.nearest, "group_rows", lambda n: 16)
    _, df = points(spark)
    start = df.select("id", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    edges = layout.symmetrise(layout.neighbor_weights(knn(df, "id", "v", 5), "umap"), "umap")
    parts = layout._dealt(df.select("id", F.col("v").alias("vec")), start, edges, None)
    homes = [r[0] for r in parts.fixed.select(F.spark_partition_id()).collect()]
    assert len(homes) > 5 and len(set(homes)) == len(homes)
    with layout.settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        sent = parts.start.repartition(parts.n_parts, "part")
        met = sent.groupBy("part").cogroup(parts.fixed.groupBy("part")).applyInArrow(lambda a, b: a, layout.SENT)
        assert met._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
