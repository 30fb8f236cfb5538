import numpy as np
import pytest
from pyspark.sql import functions as F

from semdrift.config import CleanSettings
from semdrift.operators import drift
from semdrift.plans.manifest import Store
from semdrift.streaming import changes, stream


def test_stream_equals_batch_over_arriving_files(spark, sf_dir, tmp_path):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        (F.lit(1994) + F.col("vec_id") % 5).cast("string").alias("year"), "embedding", "vec_id")
    landing, parts, progress = (str(tmp_path / n) for n in ("landing", "parts", "progress"))
    for low, high in ((0, 200), (200, 350), (350, 10**9)):
        vectors.filter(F.col("vec_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(landing)
        stream.run_centroids(stream.landed_stream(spark, landing, vectors.schema, 1), parts, progress)
    want = drift.consecutive_drift(drift.yearly_centroids(vectors)).orderBy("to_year").collect()
    got = stream.merged_drift(spark, parts).orderBy("to_year").collect()
    assert [r["to_year"] for r in got] == [r["to_year"] for r in want]
    np.testing.assert_allclose([r["drift"] for r in got], [r["drift"] for r in want], atol=1e-9)
    stream.compact_partials(spark, parts, str(tmp_path / "compact"))
    again = stream.merged_drift(spark, str(tmp_path / "compact")).orderBy("to_year").collect()
    np.testing.assert_allclose([r["drift"] for r in again], [r["drift"] for r in want], atol=1e-9)


def test_clean_stream_equals_batch(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    settings = CleanSettings(use_lemmas=False)
    arriving = stream.landed_stream(spark, str(tmp_path / "in"), docs.schema, 1)
    stream.run_to_table(stream.clean_and_embed(arriving, "doc_id", 16, settings), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = stream.clean_and_embed(docs, "doc_id", 16, settings)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_copies_are_dropped_within_the_bound(spark, tmp_path):
    rows = [("f", "h", "2024-01-01 00:00:00"), ("f", "h", "2024-01-01 01:00:00"), ("f", "h2", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "filename string, content_md5 string, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    arriving = stream.landed_stream(spark, str(tmp_path / "in"), df.schema)
    stream.run_to_table(stream.first_copies(arriving, ["filename", "content_md5"], "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_changed_and_removed_documents_leave_the_centroids(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(0)
    feed = [(f"d{i}", 1, str(1994 + i % 6), rng.normal(size=4).tolist(), False) for i in range(60)]
    feed += [(f"d{i}", 2, str(1994 + (i + 1) % 6), rng.normal(size=4).tolist(), False) for i in range(0, 60, 3)]
    feed += [(f"d{i}", 3, None, None, True) for i in range(0, 60, 6)] + [("x", 1, "Unknown", [1.0] * 4, False), ("y", 1, "2015", [1.0] * 4, False), ("y", 2, "2015", None, True)]
    feed += feed[5:9]  # the same versions again
    order = rng.permutation(len(feed))
    final = {}
    for row in feed:
        final[row[0]] = max(final.get(row[0], row), row, key=lambda r: r[1])
    landing, root, progress = (str(tmp_path / n) for n in ("landing", "store", "progress"))
    monkeypatch.setattr("semdrift.plans.manifest.MOST_PARTS", 3)
    for part in np.array_split(order, 6):  # versions arrive in any order
        spark.createDataFrame([feed[i] for i in part], changes.FEED).coalesce(1).write.mode("append").parquet(landing)
        changes.run_changes(stream.landed_stream(spark, landing, spark.read.parquet(landing).schema, 1), root, progress)
    rows = [(r[2], r[3]) for r in final.values() if not r[4]]
    alive = spark.createDataFrame(rows, "year string, embedding array<float>")
    want = {r["year"]: (r["n"], r["centroid"]) for r in drift.yearly_centroids(alive).collect()}
    got = {r["year"]: (r["n"], r["centroid"]) for r in changes.current_centroids(spark, root).collect()}
    assert {int(y): n for y, (n, _) in want.items()} == {y: n for y, (n, _) in got.items()} and 2015 not in got
    for year, (_, centroid) in want.items():
        np.testing.assert_allclose(got[int(year)][1], centroid, atol=1e-6)
    store = Store(spark, root)
    assert len(store.manifest("sums").parts) <= 3 and store.read("versions").groupBy("key").count().filter("count > 1").count() == 0


def test_a_repeated_step_adds_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1, "2000", [1.0, 2.0], False), ("b", 1, "2000", [3.0, 4.0], False)], changes.FEED)
    later = spark.createDataFrame([("a", 2, "2001", [5.0, 6.0], False)], changes.FEED)
    changes.apply_changes(store, rows, "1")
    changes.apply_changes(store, rows, "1")
    append = Store.append

    def dies(self, stage, *args, **kwargs):
        if stage == "versions":
            raise KeyboardInterrupt
        return append(self, stage, *args, **kwargs)

    monkeypatch.setattr(Store, "append", dies)  # between the two tables
    with pytest.raises(KeyboardInterrupt):
        changes.apply_changes(store, later, "2")
    monkeypatch.undo()
    changes.apply_changes(store, later, "2")
    got = sorted((r["year"], r["n"], r["centroid"]) for r in changes.current_centroids(spark, str(tmp_path)).collect())
    assert got == [(2000, 1, [3.0, 4.0]), (2001, 1, [5.0, 6.0])]
