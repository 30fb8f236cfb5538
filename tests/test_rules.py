"""Rules that hold on every path: empty numbers, null texts and vectors, large labels, far points, changed settings."""

import numpy as np
import pyarrow as pa
import pytest

from semdrift.config import CleanSettings, EmbedSettings, Settings
from semdrift.functions.arrow import distances, to_matrix
from semdrift.functions.vectors import split_vectors
from semdrift.operators import clean, cluster, skew
from semdrift.operators.meta import override_president
from semdrift.operators.similar import knn
from semdrift.plans import stages


def test_an_empty_number_matches_nothing(spark):
    fields = "filename string, eo_number string, president string"
    documents = spark.createDataFrame([("a", "", "Clinton"), ("b", "7", "Bush"), ("c", None, "Obama")], fields)
    stats = spark.createDataFrame([("x", "", "Unknown"), ("y", "7", "Reagan"), ("z", None, "Unknown")], fields)
    got = {r.filename: r.president for r in override_president(documents, stats).collect()}
    assert got == {"a": "Clinton", "b": "Reagan", "c": "Obama"}


def test_null_texts_stay_null_on_both_paths(spark, monkeypatch):
    documents = spark.createDataFrame([(1, None), (2, "went home"), (3, "")], "id long, text string")
    lemmas = spark.createDataFrame([("went", "go"), ("is", "be")], "form string, lemma string")
    want = {1: None, 2: "go home", 3: ""}
    assert {r.id: r.text for r in clean.lemmatise(documents, lemmas, "id").collect()} == want
    monkeypatch.setattr(clean, "MAX_SHIPPED_FORMS", 1)
    assert {r.id: r.text for r in clean.lemmatise(documents, lemmas, "id").collect()} == want


POINTS = [(i, [float(i % 3) * 9 + 0.01 * i, float(i % 3) * 4]) for i in range(30)]
BROKEN = [(90, None), (91, [1.0, None]), (92, [float("nan"), 2.0])]
FIELDS = "id long, v array<double>"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_points_without_a_vector_shift_no_others(spark):
    whole, broken = spark.createDataFrame(POINTS, FIELDS), spark.createDataFrame(POINTS + BROKEN, FIELDS)
    assert rows(knn(broken, "id", "v", 4, group=8)) == rows(knn(whole, "id", "v", 4, group=8))
    assert rows(cluster.dbscan(broken, "id", "v", 1.0, 3, block_rows=8)) == rows(cluster.dbscan(whole, "id", "v", 1.0, 3, block_rows=8))
    fit = cluster.kmeans_fits(broken, "id", "v", [3], restarts=3)[3]
    assert fit.inertia == pytest.approx(cluster.kmeans_fits(whole, "id", "v", [3], restarts=3)[3].inertia)
    assert fit.converged and 1 <= fit.iterations < 300
    labels = {r.id: r.cluster for r in cluster.assign(broken, "v", fit.centers).collect()}
    assert [labels[i] for i, _ in BROKEN] == [None] * 3 and {labels[i] for i, _ in POINTS} == {0, 1, 2}
    good, rejects = split_vectors(spark.createDataFrame([*POINTS, *BROKEN, (93, [1.0])], FIELDS), "v", 2)
    assert good.count() == 30 and {r.id for r in rejects.collect()} == {90, 91, 92, 93}


def test_a_matrix_needs_whole_rows():
    for bad in ([[1.0, 2.0, 3.0, 4.0], None], [[1.0], [2.0, 3.0, 4.0]]):
        with pytest.raises(ValueError):
            to_matrix(pa.array(bad, pa.list_(pa.float64())))


def test_a_fit_cut_short_says_so(spark):
    points = spark.createDataFrame([(i, [float(i * i % 101), float(i * 7 % 53)]) for i in range(200)], FIELDS)
    assert not cluster.kmeans_fits(points, "id", "v", [6], restarts=1, max_iter=1)[6].converged


def test_labels_beyond_doubles_stay_apart(spark):
    big = 1 << 53
    near = spark.createDataFrame([(i, v, big + i % 2, i % 2 if i else None) for i, (_, v) in enumerate(POINTS)],
                                 FIELDS + ", large long, small long")
    small = near.selectExpr("id", "v", "id % 2 AS large", "small")
    want, got = (
        [(c, round(score, 9), *rest) for c, score, *rest in rows(cluster.silhouettes(p, "id", "v", ["large", "small"], block_rows=8))]
        for p in (small, near)
    )
    assert got == want and [row[2:] for row in got] == [(30, 2), (29, 2)]


def test_distances_far_from_the_origin():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16)) * 1e-3
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = distances(x + 1000.0, x + 1000.0, True)
    exact = np.sqrt((((x + 1000.0)[:, None] - (x + 1000.0)[None]) ** 2).sum(2))
    assert np.abs(got - exact).max() < 1e-12 and np.abs(got - want).max() < 1e-11
    assert (np.argsort(got, 1)[:, :16] == np.argsort(exact, 1)[:, :16]).all()
    tiny = np.array([[0.0, 1.0], [0.0, 1.0 + 1e-9], [5.0, 5.0]])
    assert distances(tiny, tiny)[0, 1] == pytest.approx(1e-9, rel=1e-6)


def test_changed_settings_are_not_reused(spark, tmp_path):
    places = stages.Places(str(tmp_path))
    documents = spark.createDataFrame([("a", "The order and the agencies"), ("b", "This went on")], "filename string, text string")
    lemmas = spark.createDataFrame([("went", "go")], "form string, lemma string")

    def run(lemma_table=None, **change):
        settings = Settings(clean=CleanSettings(**change), embed=EmbedSettings(dim=8 if change else 4, min_chars=1))
        cleaned = stages.clean_stage(spark, documents, places, settings, lemma_table)
        sizes = {len(r.embedding) for r in stages.embed_stage(spark, cleaned, places, settings).collect()}
        return {r.filename: r.text for r in cleaned.collect()}, sizes

    short, four = run(use_lemmas=False), run()
    assert four[1] == {4} and short[1] == {8}
    full = run(remove_stopwords=False, min_word_length=1, use_lemmas=False)
    assert full[0]["a"] == "the order and the agencies" and full[1] == {8} and short[0]["a"] != full[0]["a"]
    before = run(lemmas, remove_stopwords=False, min_word_length=1)[0]["b"]
    after = run(spark.createDataFrame([("went", "leave")], "form string, lemma string"), remove_stopwords=False, min_word_length=1)
    assert before == "this go on" and after[0]["b"] == "this leave on"


def test_the_last_metadata_row_of_a_file_holds(spark):
    stats = spark.createDataFrame([("a", 1), ("b", 2)], "filename string, n int")
    rows = [("a", "Zed", "2000-01-01", "9"), ("a", "Able", "1999-01-01", "1"), ("c", "X", "", "")]
    metadata = spark.createDataFrame(rows, "filename string, president string, date string, eo_number string").coalesce(1)
    got = {r.filename: (r.president, r.date, r.eo_number) for r in clean.with_metadata(stats, metadata).collect()}
    assert got == {"a": ("Able", "1999-01-01", "1"), "b": ("Unknown", "", "")}


def test_lemmas_by_words_of_a_batch(spark):
    texts = ["went  home", "", None, "ran went went", "é went", " ", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    lemmas = spark.createDataFrame([("went", "go"), ("ran", "run"), ("home", None)], "form string, lemma string")
    got = [r.text for r in clean.lemmatise(df, lemmas, "id").orderBy("id").collect()]
    assert got == ["go  home", "", None, "run go go", "é go", " ", "x"]


def test_joins_with_and_without_hot_keys_agree(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("none", 3)], "k string, v int")
    for how in ("left", "inner"):
        want = rows(left.join(right, "k", how).select("id", "v"))
        for hot in (10, 1_000_000):
            assert rows(skew.lookup_join(left, right, "k", "id", how, hot_rows=hot, salts=4).select("id", "v")) == want
