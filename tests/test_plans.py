import contextlib
import glob
import io

import pytest
from pyspark.sql import functions as F

from semdrift.config import PRESIDENTS, AnalysisSettings, CleanSettings, EmbedSettings, Settings
from semdrift.operators.ingest import in_years
from semdrift.plans import plotdata, report, stages
from semdrift.plans.manifest import MOST_PARTS, Store
from semdrift.session import shared_dir
from semdrift.sources.corpus import corpus


def formatted(df) -> str:
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    return shown.getvalue()


def test_sparse_composition(spark):
    rows = [(0, "Clinton"), (0, "Clinton"), (0, "Obama"), (1, "Unknown"), (2, None)]
    got = {r["cluster"]: r for r in plotdata.composition_heatmap(spark.createDataFrame(rows, "cluster int, president string")).collect()}
    assert got[0]["Clinton"] == pytest.approx(2 / 3) and got[0]["Obama"] == pytest.approx(1 / 3)
    assert all(got[c][p] == 0 for c in (1, 2) for p in PRESIDENTS)


def test_modal_president(spark):
    rows = [(0, "B"), (0, "A"), (1, None), (2, None), (2, "Z")]
    got = {r["cluster"]: tuple(r)[1:] for r in report.cluster_stats(spark.createDataFrame(rows, "cluster int, president string")).collect()}
    assert got == {0: (2, "A"), 1: (1, "Unknown"), 2: (2, "Z")}


def test_single_year_has_no_line(spark):
    positions = spark.createDataFrame([(2000, 0, 0.0)], "year int, idx int, position double")
    trend = spark.createDataFrame([(0.0, 0.0, 1)], "slope double, intercept double, n_years int")
    assert plotdata.gravity_line(positions, trend).count() == 0


def test_date_range_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter(in_years(F.col("o_orderdate"), 1994, 1996)).select("o_orderkey")
    plan = formatted(orders)
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual" in pushed and "LessThanOrEqual" in pushed


def test_cleaning_has_no_shuffle_and_no_python(spark, sf_dir):
    from semdrift.operators.clean import clean_and_measure

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = formatted(clean_and_measure(docs, "doc_id", CleanSettings(use_lemmas=False)))
    assert "Exchange" not in plan and "Python" not in plan


def jobs_of(spark, name, call):
    """What ``call`` gives, and how many jobs it started."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return call(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_an_unchanged_run_starts_no_job(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).write.parquet(str(tmp_path / "documents.parquet"))
    settings = Settings(clean=CleanSettings(use_lemmas=False), embed=EmbedSettings(dim=16),
                        analysis=AnalysisSettings(restarts=1, k_stop=4, eps_values=(0.3, 0.6), umap_neighbors=5))

    # Reading a table anew takes a job for its schema, whatever is done with it.
    inputs = [corpus(spark, str(tmp_path)).select("filename", "text") for _ in range(3)]

    def run(**kwargs):
        return stages.run(spark, inputs.pop(), str(tmp_path / "out"), settings, methods=kwargs.pop("methods", ("pca",)), **kwargs)

    def scratch():
        return {p for p in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*-*") if len(p.rsplit("-", 1)[1]) == 32}

    before = scratch()
    first, n = jobs_of(spark, "first", run)
    assert n > 20 and scratch() == before
    rows = {name: sorted(map(str, t.collect())) for name, t in first.items()}
    assert rows["report"] and rows["cluster_stats"] and rows["coordinate_export"] and rows["metadata_with_stats"]
    again, n = jobs_of(spark, "again", run)
    assert n == 0 and {name: sorted(map(str, t.collect())) for name, t in again.items()} == rows
    more, n = jobs_of(spark, "one layout more", lambda: run(methods=("pca", "umap")))
    assert n > 0 and more["umap_coordinates"].count() == more["pca_coordinates"].count()
    kept = Store(spark, str(tmp_path / "out"))
    assert kept.manifest("pca_coordinates").version == kept.manifest("kmeans_labels").version == 1


def test_a_killed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    store.keyed("t", "one", "s", lambda: rows(("a", 1), ("b", 1)), "k", "v", lambda todo: todo)
    monkeypatch.setattr(Store, "commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        store.keyed("t", "two", "s", lambda: rows(("a", 2)), "k", "v", lambda todo: todo)
    monkeypatch.undo()
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 1), ("b", 1)] and store.read("other") is None
    with pytest.raises(RuntimeError, match="another run"):
        store.commit("t", store.manifest("t"))


def test_keyed_tables_take_changes_only(spark, tmp_path):
    store, made = Store(spark, str(tmp_path)), []

    def step(name, now, settings="s"):
        def make(todo):
            made.append(sorted(r["k"] for r in todo.collect()))
            return todo

        table = spark.createDataFrame(sorted(now.items()), "k string, v int")
        assert dict(map(tuple, store.keyed("t", name, settings, lambda: table, "k", "v", make).collect())) == now
        return {r["k"]: r["v"] for r in store.read("t").collect()} == now

    assert step("1", {"a": 1, "b": 1, "c": 1}) and step("2", {"a": 2, "c": 1, "d": 1}) and step("3", {"a": 1, "b": 3, "d": 1})
    assert made == [["a", "b", "c"], ["a", "d"], ["a", "b"]]
    for i in range(MOST_PARTS + 2):  # folders are merged on the way
        assert step(f"more {i}", {"a": 10 + i, "d": 1})
    assert len(store.manifest("t").parts) <= MOST_PARTS and all(m == ["a"] for m in made[3:])
    assert step("other settings", {"a": 10, "d": 1}, "s2") and made[-1] == ["a", "d"]
    assert step("none", {}, "s2") and step("some", {"z": 1}, "s2")


def test_whole_run_twice(spark, sf_dir, tmp_path, monkeypatch):
    docs = corpus(spark, sf_dir).select("filename", "text")
    settings = Settings(clean=CleanSettings(use_lemmas=False), embed=EmbedSettings(dim=16),
                        analysis=AnalysisSettings(restarts=2, k_stop=4, eps_values=(0.3, 0.6)))
    tables = stages.run(spark, docs, str(tmp_path), settings, methods=("pca",))
    n = tables["embeddings"].count()
    assert tables["metadata"].count() == tables["kmeans_labels"].count() == tables["dbscan_labels"].count() == n > 150
    assert tables["semantic_drift"].count() == 31
    assert set(tables["pca_coordinates"].columns) == {"filename", "x", "y"}
    before = {r["filename"]: r["content_md5"] for r in tables["embeddings"].collect()}

    encoded = []

    def encode(todo):
        encoded.append(todo.count())
        return todo.select("filename", "content_md5", F.array_repeat(F.lit(0.25).cast("float"), 16).alias("embedding"))

    places = stages.Places(str(tmp_path))
    changed = docs.withColumn("text", F.when(F.col("filename").startswith("EO_12890_"), F.concat("text", F.lit(" appended words"))).otherwise(F.col("text")))
    cleaned = stages.clean_stage(spark, changed, places, settings)
    after = stages.embed_stage(spark, cleaned, places, settings, encode)
    assert encoded == [1] and after.count() == n
    differing = [r["filename"] for r in after.collect() if before[r["filename"]] != r["content_md5"]]
    assert len(differing) == 1
