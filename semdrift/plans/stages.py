"""A whole corpus run: stage tables in, stage tables out.

Each stage is a DataFrame function; only the cleaned corpus, the vectors, the
coordinates, the labels and the small result tables are kept, each committed
by a manifest. A stage whose input did not change does no work again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.config import Settings
from semdrift.functions import stopwords
from semdrift.operators import clean, cluster, drift, embed, layout, meta, reduce
from semdrift.operators.skew import number_rows
from semdrift.plans import report
from semdrift.plans.manifest import Store, digest, fingerprint
from semdrift.session import scratch_tables, write_and_read
from semdrift.sources import sinks


@dataclass(frozen=True)
class Places:
    """Folder of every stage table."""

    root: str

    def __getattr__(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Table at ``path``, or None where nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def fresh(current: DataFrame, previous: DataFrame | None, key: str = "filename", md5: str = "raw_md5") -> DataFrame:
    """Rows of ``current`` that the previous stage table does not hold in this form."""
    return current if previous is None else current.join(previous.select(key, md5), [key, md5], "left_anti")


def made_by(*settings: object, table: DataFrame | None = None) -> str:
    """A name for what a stage was run with: its settings, and the rows of a table it read in any order."""
    parts = [repr(s) for s in settings]
    if table is not None:
        row = F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")
        parts.append(repr(tuple(table.agg(F.sum(row), F.count(F.lit(1))).first())))
    return hashlib.md5("|".join(parts).encode()).hexdigest()


def _inputs(*tables: DataFrame | None) -> str:
    """What tables hold: from the listing of their files, or from their rows where they read none."""
    return digest(*[None if t is None else fingerprint(t) or made_by(table=t) for t in tables])


def clean_stage(spark: SparkSession, documents: DataFrame, places: Places, settings: Settings,
                lemmas: DataFrame | None = None) -> DataFrame:
    """Cleaned texts with their measures; unchanged documents keep the stored row while settings and lemmas are the same."""
    store = Store(spark, places.root)
    made_from = _inputs(documents)
    used = lemmas if settings.clean.use_lemmas else None
    how = made_by(settings.clean, stopwords.DEFAULT, _inputs(used))

    def current() -> DataFrame:
        usable, rejects = clean.split_rejects(documents, "filename")
        sinks.write_table(rejects, places.rejects)
        return usable.withColumn("raw_md5", F.md5("text"))

    def make(todo: DataFrame) -> DataFrame:
        done = clean.clean_and_measure(todo.select("filename", "text"), "filename", settings.clean, lemmas)
        return done.join(todo.select("filename", "raw_md5"), "filename")

    return store.keyed("cleaned", made_from, how, current, "filename", "raw_md5", make)


def embed_stage(spark: SparkSession, cleaned: DataFrame, places: Places, settings: Settings, encode=None,
                force: bool = False) -> DataFrame:
    """Vector store; only new and changed texts are encoded, and all of them after a change of settings.

    The settings do not tell one ``encode`` from another: ``force`` after a change of encoder.
    """
    store = Store(spark, places.root)
    if encode is None:
        def encode(docs: DataFrame) -> DataFrame:
            return embed.embed_documents(docs, "filename", settings.embed.dim, min_chars=settings.embed.min_chars,
                                         max_chars=settings.embed.max_chars)

    def current() -> DataFrame:
        gate = cleaned.filter(embed.long_enough(F.col("text"), settings.embed.min_chars))
        return gate.select("filename", "text", F.md5("text").alias("content_md5"))

    before = store.manifest("embeddings")
    how = made_by(settings.embed, before.version if force and before else None)
    if before is not None and not force and before.settings.split(":")[0] == how:
        how = before.settings  # forced before, with these settings
    elif force:
        how = f"{made_by(settings.embed, None)}:{how}"
    done = store.keyed("embeddings", _inputs(cleaned), how, current, "filename", "content_md5", encode)
    return done.select("filename", "content_md5", "embedding")


def run(spark: SparkSession, documents: DataFrame, root: str, settings: Settings = Settings(),
        lemmas: DataFrame | None = None, raw_metadata: DataFrame | None = None, encode=None,
        methods: tuple[str, ...] = ("pca", "tsne", "umap"), force: bool = False,
        title: str = "Corpus Analysis Summary Report", generated: str = "") -> dict[str, DataFrame]:
    """From keyed documents to all result tables below ``root``.

    Tables whose inputs and settings did not change are taken as they are stored, reductions, layouts and clusters too;
    a run over unchanged files starts no job. Scratch tables are removed at the end.
    """
    with scratch_tables(spark):
        return _run(spark, documents, root, settings, lemmas, raw_metadata, encode, methods, force, title, generated)


def _run(spark, documents, root, settings, lemmas, raw_metadata, encode, methods, force, title, generated) -> dict[str, DataFrame]:
    places, store = Places(root), Store(spark, root)
    out: dict[str, DataFrame] = {}

    def keep(name: str, made_from: str, build: Callable[[], DataFrame]) -> DataFrame:
        out[name] = store.derived(name, made_from, build)
        return out[name]

    out["cleaned"] = cleaned = clean_stage(spark, documents, places, settings, lemmas)
    vectors = embed_stage(spark, cleaned, places, settings, encode, force)
    out["embeddings"] = vectors
    texts, vecs = store.manifest("cleaned").name, store.manifest("embeddings").name
    with_stats = digest(texts, vecs, None if raw_metadata is None else _inputs(raw_metadata))
    measures = cleaned.drop("text", "raw_md5")
    stats = None if raw_metadata is None else clean.with_metadata(measures, raw_metadata)
    metadata = keep("metadata", with_stats, lambda: meta.metadata_frame(vectors, stats))

    # Numbered vectors: written once, and only if a reduction or a clustering has to be made.
    numbered: list[tuple[DataFrame, DataFrame]] = []

    def points() -> tuple[DataFrame, DataFrame]:
        if not numbered:
            keys = number_rows(vectors.select("filename"), [F.col("filename")], "id")
            numbered.append((keys, write_and_read(vectors.join(keys, "filename"), "points")))
        return numbered[0]

    def named(table: DataFrame) -> DataFrame:
        return points()[0].join(table, "id").drop("id")

    analysed = digest(vecs, settings.analysis)
    reduced: dict[str, DataFrame] = {}

    def reduction(method: str) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            if method not in reduced:  # all that are missing are made together
                missing = tuple(m for m in methods if not _made(store, f"{m}_coordinates", analysed))
                reduced.update(layout.reduce_all(points()[1], "id", "embedding", settings.analysis, methods=missing))
            return named(reduce.xy(reduced[method], "id"))

        return build

    for method in methods:
        keep(f"{method}_coordinates", analysed, reduction(method))

    swept: list[cluster.KMeansSweep] = []

    def sweep() -> cluster.KMeansSweep:
        if not swept:
            swept.append(cluster.kmeans_select(points()[1], "id", "embedding", settings.analysis))
        return swept[0]

    def scores() -> DataFrame:
        rows = [(k, s, k == sweep().best.k) for k, s in sweep().scores.items()] or [(sweep().best.k, None, True)]
        return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")

    def kmeans() -> DataFrame:
        labelled = cluster.assign(points()[1].select("filename", "embedding"), "embedding", sweep().best.centers)
        return labelled.select("filename", "cluster")

    labels = keep("kmeans_labels", analysed, kmeans)
    keep("kmeans_scores", analysed, scores)
    swept_density: list[cluster.DensitySweep] = []

    def density() -> cluster.DensitySweep:
        if not swept_density:
            swept_density.append(cluster.dbscan_sweep(points()[1], "id", "embedding", settings.analysis))
        return swept_density[0]

    keep("dbscan_labels", analysed, lambda: named(density().labels))
    keep("dbscan_sweep", analysed, lambda: density().sweep)

    both = digest(with_stats, analysed)
    labelled = keep("cluster_export", both, lambda: report.cluster_export(labels, metadata))
    keep("cluster_composition", both, lambda: drift.cluster_by_group(labelled))
    found = keep("cluster_stats", both, lambda: report.cluster_stats(labelled))
    centroids = keep("yearly_centroids", both, lambda: drift.yearly_centroids(
        meta.align(vectors.select("filename", "embedding"), metadata)))
    moves = keep("semantic_drift", both, lambda: drift.consecutive_drift(centroids))
    keep("drift_summary", both, lambda: report.drift_summary(moves))
    keep("overview", both, lambda: report.overview(metadata))
    keep("metadata_with_stats", both, lambda: report.metadata_with_stats(metadata, measures))
    if "pca" in methods:
        keep("coordinate_export", both, lambda: report.coordinate_export(out["pca_coordinates"], metadata))
    keep("report", digest(both, title), lambda: report.summary_report(metadata, moves, found, title, generated))
    return out


def _made(store: Store, stage: str, made_from: str) -> bool:
    found = store.manifest(stage)
    return found is not None and found.made_from == made_from
