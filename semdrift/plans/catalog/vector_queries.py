"""Embedding, reduction, neighbour and clustering queries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.config import AnalysisSettings, CleanSettings, EmbedSettings, eps_grid
from semdrift.functions import text as X
from semdrift.functions.vectors import norm
from semdrift.operators import clean, cluster, descent, embed, layout, reduce, similar
from semdrift.plans import stages
from semdrift.plans.catalog.base import CORPUS, LABELLED, content_list, normalised, query
from semdrift.session import scratch_path, write_and_read
from semdrift.sources import landed, sinks
from semdrift.sources.corpus import corpus, table, texts

#: Dimensions of the given vectors, and of those hashed from texts.
DIM, HASHED = 64, EmbedSettings().dim


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def cleaned_texts(spark, sf_dir, name: str = "documents", key: str = "doc_id") -> DataFrame:
    source = texts(spark, sf_dir) if name == "documents" else table(spark, sf_dir, name)
    done = clean.clean_corpus(source.select(key, "text"), key, CleanSettings(use_lemmas=False))
    return done.select(key, F.col("processed").alias("text"))


def embedded(spark, sf_dir, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return embed.embed_documents(cleaned_texts(spark, sf_dir, name, key), key, HASHED)


def long_rounded(df: DataFrame, key: str, vec: str, digits: int = 6) -> DataFrame:
    long = reduce.long_form(df, key, vec)
    return long.select(key, F.col("pos").cast("bigint").alias("pos"),
                       F.round(F.col("value").cast("double"), digits).alias("value"))


def hash_vectors(name: str, key: str, prefix: str) -> str:
    """SQL of (key, pos, value) for the non-zero elements of the hashed vectors."""
    return f"""{prefix}_words AS (
  SELECT {key}, array_to_string({content_list(normalised('text'))}, ' ') AS text FROM {name}),
{prefix}_tokens AS (
  SELECT {key}, md5(unnest(string_split(text, ' '))) AS m FROM {prefix}_words WHERE length(text) > 50),
{prefix}_sums AS (
  SELECT {key}, CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % {HASHED} + 1 AS pos,
         sum(CASE WHEN CAST(('0x' || substr(m, 9, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s
  FROM {prefix}_tokens GROUP BY ALL),
{prefix}_vectors AS (
  SELECT {key}, pos, CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS value
  FROM {prefix}_sums WHERE s <> 0)"""


def register() -> None:
    docs = hash_vectors("documents", "doc_id", "d")

    @query("e01_length_gate", "SELECT doc_id FROM documents WHERE length(text) > 50")
    def e01(spark, sf_dir):
        return table(spark, sf_dir, "documents").filter(embed.long_enough(F.col("text"))).select("doc_id")

    @query("e02_char_cut", "SELECT doc_id, md5(substring(text, 1, 2048)) AS cut_md5 FROM documents")
    def e02(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.truncate(F.col("text"), 2048)).alias("cut_md5"))

    @query("e03_batch_encode", f"""SELECT doc_id, CAST({HASHED} AS BIGINT) AS dim, 1.0::DOUBLE AS length FROM documents
WHERE length(text) > 50""")
    def e03(spark, sf_dir):
        docs = texts(spark, sf_dir).filter(embed.long_enough(F.col("text")))
        done = embed.encode_with_model(docs, "doc_id", embed.ngram_model(HASHED))
        return done.select("doc_id", F.size("embedding").cast("bigint").alias("dim"),
                           F.round(norm(F.col("embedding")), 3).alias("length"))

    @query("e03_encoded_words", f"WITH {docs} SELECT doc_id, pos, round(value, 6) AS value FROM d_vectors")
    def e03_words(spark, sf_dir):
        """Whole vectors of a plug-in encoder that SQL can follow."""
        kept = cleaned_texts(spark, sf_dir).filter(embed.long_enough(F.col("text")))
        done = embed.encode_with_model(kept, "doc_id", embed.word_model(HASHED))
        return long_rounded(done, "doc_id", "embedding").filter("value <> 0")

    @query("e04_hash_embedding", f"WITH {docs} SELECT doc_id, pos, round(value, 6) AS value FROM d_vectors")
    def e04(spark, sf_dir):
        return long_rounded(embedded(spark, sf_dir), "doc_id", "embedding").filter("value <> 0")

    @query("e04_weighted_hash_embedding", f"""WITH {docs},
n AS (SELECT count(*) AS n FROM d_words WHERE length(text) > 50),
seen AS (SELECT CAST(('0x' || substr(m, 1, 8)) AS BIGINT) % {HASHED} + 1 AS pos, count(DISTINCT doc_id) AS df FROM d_tokens GROUP BY ALL),
w AS (SELECT doc_id, pos, s * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS s FROM d_sums JOIN seen USING (pos), n),
v AS (SELECT doc_id, pos, CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS value FROM w WHERE s <> 0)
SELECT doc_id, pos, round(value, 5) AS value FROM v""")
    def e04_weighted(spark, sf_dir):
        kept = write_and_read(cleaned_texts(spark, sf_dir).filter(embed.long_enough(F.col("text"))).select("doc_id", "text"), "kept-texts")
        weights = embed.bucket_weights(kept, HASHED)
        done = embed.embed_documents(kept, "doc_id", HASHED, weights=weights)
        return long_rounded(done, "doc_id", "embedding", 5).filter("value <> 0")

    @query("e05_learned_embedding")
    def e05(spark, sf_dir):
        kept = cleaned_texts(spark, sf_dir).filter(embed.long_enough(F.col("text")))
        done = embed.learned_embedding(kept, "doc_id", X.tokens(F.col("text")), HASHED)
        return done.select("doc_id", F.size("embedding").alias("dim"), F.round(norm(F.col("embedding")), 3).alias("length"))

    @query("s13_vector_store", f"""WITH {CORPUS.strip()}, {docs}
SELECT filename, md5(w.text) AS content_md5, CAST({HASHED} AS BIGINT) AS dim
FROM d_words w JOIN corpus USING (doc_id) WHERE length(w.text) > 50""")
    def s13(spark, sf_dir):
        path = scratch_path(spark, "store")
        sinks.write_table(_store(spark, sf_dir), path)
        return _stored(spark, path)

    @query("s16_load_vectors", f"""WITH {CORPUS.strip()}, {docs}
SELECT filename, md5(w.text) AS content_md5, CAST({HASHED} AS BIGINT) AS dim, c.president
FROM d_words w JOIN corpus c USING (doc_id) WHERE length(w.text) > 50""")
    def s16(spark, sf_dir):
        from semdrift.operators.meta import align, metadata_frame

        path, meta_path = scratch_path(spark, "store"), scratch_path(spark, "metadata")
        sinks.write_table(_store(spark, sf_dir), path)
        sinks.write_table(metadata_frame(spark.read.parquet(path)), meta_path)
        return align(_stored(spark, path), spark.read.parquet(meta_path).select("filename", "president"))

    def _store(spark, sf_dir):
        keys = corpus(spark, sf_dir).select("doc_id", "filename")
        return embedded(spark, sf_dir).join(keys, "doc_id").select("filename", "content_md5", "embedding")

    def _stored(spark, path):
        return landed.read_embeddings(spark, path).select(
            "filename", "content_md5", F.size("embedding").cast("bigint").alias("dim"))

    both = f"{docs}, {hash_vectors('benchmark', 'item_id', 'q')}"

    @query("e11_top_k_similar", f"""WITH {both},
pairs AS (SELECT q.item_id AS query, d.doc_id AS id, sum(q.value * d.value) AS dot
          FROM q_vectors q JOIN d_vectors d USING (pos) GROUP BY ALL),
lengths AS (SELECT doc_id AS id, sqrt(sum(value * value)) AS dl FROM d_vectors GROUP BY ALL),
qlengths AS (SELECT item_id AS query, sqrt(sum(value * value)) AS ql FROM q_vectors GROUP BY ALL),
ranked AS (SELECT query, id, round(1 - dot / (dl * ql), 9) AS distance,
           row_number() OVER (PARTITION BY query ORDER BY round(1 - dot / (dl * ql), 9), id) AS rank
           FROM pairs JOIN lengths USING (id) JOIN qlengths USING (query))
SELECT query, id, round(1 - distance, 6) AS cosine, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5""")
    def e11(spark, sf_dir):
        found = similar.top_k_similar(embedded(spark, sf_dir), embedded(spark, sf_dir, "benchmark", "item_id"), 5,
                                      "doc_id", "item_id")
        return found.select("query", "id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


# -------------------------------------------------------- content hashes and reruns

# The stored snapshot: keys moved on by 37, German texts in an older wording.
SNAPSHOT = """now AS (SELECT doc_id, md5(text) AS content_md5 FROM documents),
stored AS (SELECT doc_id + 37 AS doc_id, md5(CASE WHEN lang = 'de' THEN text || ' draft' ELSE text END) AS m FROM documents),
shifted AS (SELECT s.doc_id, CASE WHEN d.lang IS NULL OR d.lang = 'de' THEN s.m ELSE md5(d.text) END AS content_md5
            FROM stored s LEFT JOIN documents d ON d.doc_id = s.doc_id),
states AS (SELECT coalesce(n.doc_id, s.doc_id) AS doc_id,
           CASE WHEN s.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'removed'
                WHEN n.content_md5 <> s.content_md5 THEN 'changed' ELSE 'same' END AS state
           FROM now n FULL JOIN shifted s ON n.doc_id = s.doc_id)"""


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    now = docs.select("doc_id", embed.content_hash(F.col("text")).alias("content_md5"))
    old_text = F.when(F.col("lang") == "de", F.concat("text", F.lit(" draft"))).otherwise(F.col("text"))
    moved = docs.select((F.col("doc_id") + 37).alias("doc_id"), F.md5(old_text).alias("m"))
    here = docs.select("doc_id", "lang", F.md5("text").alias("h"))
    other = F.col("lang").isNull() | (F.col("lang") == "de")
    stored = moved.join(here, "doc_id", "left").select("doc_id", F.when(other, F.col("m")).otherwise(F.col("h")).alias("content_md5"))
    return now, stored


@query("e07_content_hash", "SELECT doc_id, md5(text) AS content_md5 FROM documents")
def e07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embed.content_hash(F.col("text")).alias("content_md5"))


@query("e08_store_valid", f"""WITH {SNAPSHOT}
SELECT count(*) FILTER (state = 'same') AS same, count(*) FILTER (state = 'new') AS new,
       count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed,
       count(*) FILTER (state <> 'same') = 0 AS valid FROM states""")
def e08(spark, sf_dir):
    return embed.store_is_valid(*snapshots(spark, sf_dir), key="doc_id")


@query("e09_changed_documents", f"WITH {SNAPSHOT} SELECT doc_id, state FROM states")
def e09_states(spark, sf_dir):
    return embed.store_diff(*snapshots(spark, sf_dir), key="doc_id")


@query("e09_refreshed_store", f"""WITH {SNAPSHOT}
SELECT doc_id, content_md5, CASE WHEN state = 'same' THEN 'stored' ELSE 'encoded' END AS origin
FROM now JOIN states USING (doc_id)""")
def e09(spark, sf_dir):
    now, stored = snapshots(spark, sf_dir)
    stored = stored.withColumn("origin", F.lit("stored"))
    return embed.refresh_store(now, stored, lambda docs: docs.withColumn("origin", F.lit("encoded")), "doc_id")


@query("s19_unchanged_stage", f"""WITH {SNAPSHOT}
SELECT 'first run' AS run, count(*) AS documents FROM states WHERE state IN ('new', 'changed')
UNION ALL SELECT 'second run', 0""")
def s19(spark, sf_dir):
    """A stage works on what is new or changed; run again, it has nothing to do."""
    now, stored = snapshots(spark, sf_dir)
    todo = stages.fresh(now, stored, "doc_id", "content_md5")
    path = scratch_path(spark, "stage")
    sinks.write_table(embed.survivors(now, stored, "doc_id").unionByName(todo), path)
    again = stages.fresh(now, stages.stored(spark, path), "doc_id", "content_md5")
    counts = [df.agg(F.lit(name).alias("run"), F.count(F.lit(1)).alias("documents"))
              for name, df in (("first run", todo), ("second run", again))]
    return counts[0].unionByName(counts[1])


# ------------------------------------------------------------------ vector arithmetic

LONG = "long AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query("e06_mean_pooling", f"""WITH {LONG},
masks AS (SELECT vec_id, CASE WHEN embedding[1] > 0 THEN 1.0 ELSE 0.0 END AS w FROM embeddings),
pooled AS (SELECT label, pos, sum(v * w) / greatest(sum(w), 1e-9) AS v FROM long JOIN masks USING (vec_id) GROUP BY label, pos)
SELECT CAST(label AS BIGINT) AS label, CAST(pos AS BIGINT) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM pooled""")
def e06(spark, sf_dir):
    """The vectors of a label as the token vectors of one text; a negative first element is masked out."""
    mask = F.when(F.get("embedding", F.lit(0)) > 0, 1.0).otherwise(0.0)
    rows = vectors(spark, sf_dir).select(F.col("label").cast("bigint").alias("label"), "embedding", mask.alias("mask"))
    return long_rounded(embed.mean_pool(rows, "label"), "label", "embedding")


@query("e10_cosine_pairs", """SELECT a.vec_id AS a_id, b.vec_id AS b_id,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def e10(spark, sf_dir):
    v = vectors(spark, sf_dir)
    a = v.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = v.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    pairs = a.join(b, F.col("b_id") == F.col("a_id") + 1)
    return similar.cosine_of_pairs(pairs).select("a_id", "b_id", F.round("cosine", 6).alias("cosine"))


@query("r01_standardise", f"""WITH {LONG},
s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END, 6) AS value FROM long JOIN s USING (pos)""")
def r01(spark, sf_dir):
    scaled, _ = reduce.standardise(vectors(spark, sf_dir), "embedding")
    return long_rounded(scaled, "vec_id", "scaled")


def _pca(spark, sf_dir, k: int = 50):
    return reduce.pca_coordinates(vectors(spark, sf_dir), "vec_id", "embedding", k)


@query("r02_pca_components")
def r02(spark, sf_dir):
    _, fit = _pca(spark, sf_dir)
    rows = [(i + 1, j + 1, float(v)) for i, axis in enumerate(fit.components) for j, v in enumerate(axis)]
    return spark.createDataFrame(rows, "component int, pos int, loading double")


@query("r03_explained_variance")
def r03(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return reduce.variance_table(v, _pca(spark, sf_dir)[1]).select("component", "explained_variance")


@query("r04_cumulative_variance")
def r04(spark, sf_dir):
    return reduce.variance_table(vectors(spark, sf_dir), _pca(spark, sf_dir)[1])


@query("r05_components_needed")
def r05(spark, sf_dir):
    return reduce.components_needed(reduce.variance_table(vectors(spark, sf_dir), _pca(spark, sf_dir)[1]))


@query("r06_projection")
def r06(spark, sf_dir):
    return _pca(spark, sf_dir)[0]


# Scores of whole sets of axes do not depend on how axes are signed or mixed: with
# all axes kept, squared lengths of the scores are those of the standardised vectors.
@query("r06_projection_lengths", f"""WITH {LONG},
s AS (SELECT pos, avg(v) AS m, stddev_pop(v) AS sd FROM long GROUP BY pos)
SELECT vec_id, round(sum(((v - m) / sd) * ((v - m) / sd)), 4) AS squared_length FROM long JOIN s USING (pos) GROUP BY vec_id""")
def r06_lengths(spark, sf_dir):
    coords, _ = _pca(spark, sf_dir, 64)
    return coords.select("vec_id", F.round(F.pow(norm(F.col("pos")), F.lit(2)), 4).alias("squared_length"))


KNN = """pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS neighbor,
         round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbor) AS rank FROM pairs)"""


@query("r07_nearest_neighbours", f"""WITH {KNN}
SELECT id, neighbor, round(distance, 6) AS distance, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 15""")
def r07(spark, sf_dir):
    near = similar.knn(vectors(spark, sf_dir), "vec_id", "embedding", 15)
    return near.select("id", "neighbor", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("r07_approximate_neighbours", f"""WITH {KNN}
SELECT CAST(rank AS BIGINT) AS rank, true AS enough, count(*) AS places FROM ranked WHERE rank <= 15 GROUP BY rank""")
def r07_approximate(spark, sf_dir):
    """Places of the approximate lists by rank, and whether at least 0.9 of the exact neighbours up to that rank are in them."""
    exact = similar.knn(vectors(spark, sf_dir), "vec_id", "embedding", 15)
    found = similar.knn(vectors(spark, sf_dir), "vec_id", "embedding", 15, exact=False)
    places = found.groupBy("rank").agg(F.count(F.lit(1)).alias("places"))
    return descent.recall(found, exact).join(places, "rank").select(
        F.col("rank").cast("bigint").alias("rank"), (F.col("recall") >= 0.9).alias("enough"), "places")


def _weights_sql(k: int, prepared: str, value: str, goal: str, weight: str, combined: str) -> str:
    """Bisection of every point's scale over lists of distances, then both directions combined."""
    return f"""WITH RECURSIVE {KNN},
lists AS (SELECT id, list(neighbor ORDER BY rank) AS nb, list(distance ORDER BY rank) AS d FROM ranked WHERE rank <= {k} GROUP BY id),
ready AS (SELECT id, nb, d, {prepared} AS b FROM lists),
solve(id, low, high, scale, step) AS (
  SELECT id, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE, 0 FROM ready
  UNION ALL
  SELECT id, CASE WHEN above THEN low ELSE scale END, CASE WHEN above THEN scale ELSE high END,
         CASE WHEN above THEN (low + scale) / 2 WHEN isinf(high) THEN scale * 2 ELSE (scale + high) / 2 END, step + 1
  FROM (SELECT s.*, {value} > {goal} AS above FROM solve s JOIN ready USING (id)) WHERE step < 64),
scaled AS (SELECT r.*, scale FROM ready r JOIN solve USING (id) WHERE step = 64),
weights AS (SELECT id, unnest(nb) AS neighbor, unnest({weight}) AS w FROM scaled),
sides AS (SELECT id AS u, neighbor AS v, w AS a, 0::DOUBLE AS b FROM weights UNION ALL SELECT neighbor, id, 0::DOUBLE, w FROM weights)
SELECT u, v, round({combined}, 6) AS w FROM (SELECT u, v, max(a) AS a, max(b) AS b FROM sides GROUP BY u, v)"""


MEMBERSHIP = _weights_sql(
    15, "list_transform(d, lambda x: greatest(x - coalesce(list_min(list_filter(d, lambda y: y > 0)), 0), 0))",
    "list_sum(list_transform(b, lambda x: exp(-x / scale)))", "log2(15)",
    "list_transform(b, lambda x: exp(-x / greatest(scale, 0.001 * list_avg(d))))", "a + b - a * b")
_P = "list_transform(b, lambda x: exp(-x / scale) / list_sum(list_transform(b, lambda y: exp(-y / scale))))"
AFFINITY = _weights_sql(
    90, "list_transform(d, lambda x: x * x - list_min(d) * list_min(d))",
    f"-list_sum(list_transform({_P}, lambda p: p * ln(greatest(p, 1e-300))))", "ln(30)", _P,
    "(a + b) / (2.0 * (SELECT count(DISTINCT id) FROM weights)) * 1000")


@query("r08_membership_weights", MEMBERSHIP)
def r08_umap(spark, sf_dir):
    near = similar.knn(vectors(spark, sf_dir), "vec_id", "embedding", 15)
    both = layout.symmetrise(layout.neighbor_weights(near, "umap"), "umap")
    return both.select("u", "v", F.round("w", 6).alias("w"))


@query("r08_affinity_weights", AFFINITY)
def r08_tsne(spark, sf_dir):
    """Affinities in thousandths: they sum to one over all pairs."""
    near = similar.knn(vectors(spark, sf_dir), "vec_id", "embedding", 90)
    both = layout.symmetrise(layout.neighbor_weights(near, "tsne"), "tsne")
    return both.select("u", "v", F.round(F.col("w") * 1000, 6).alias("w"))


@query("r09_umap_layout")
def r09_umap(spark, sf_dir):
    return reduce.xy(layout.reduce_all(vectors(spark, sf_dir), "vec_id", "embedding", methods=("umap",))["umap"], "id")


@query("r09_tsne_layout")
def r09_tsne(spark, sf_dir):
    return reduce.xy(layout.reduce_all(vectors(spark, sf_dir), "vec_id", "embedding", methods=("tsne",))["tsne"], "id")


@query("r10_reduce_all")
def r10(spark, sf_dir):
    found = layout.reduce_all(vectors(spark, sf_dir), "vec_id", "embedding")
    out = [reduce.xy(t, "id").withColumn("method", F.lit(m)) for m, t in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("r10_layout_quality", """SELECT method, (SELECT count(*) FROM embeddings) AS n, true AS keeps_more_than_axes
FROM (SELECT unnest(['tsne', 'umap']) AS method)""")
def r10_quality(spark, sf_dir):
    """Whether the finished layouts keep more of each point's 15 nearest others than the first two principal axes do."""
    v = vectors(spark, sf_dir)
    found = layout.reduce_all(v, "vec_id", "embedding")
    flat = {"pca": found["pca"].select("id", F.slice("pos", 1, 2).alias("pos")), "tsne": found["tsne"], "umap": found["umap"]}
    true = similar.knn(reduce.standardise(v, "embedding")[0], "vec_id", "scaled", 15).select("id", "neighbor")
    shares = {m: similar.knn(t, "id", "pos", 15).join(true, ["id", "neighbor"]).count() for m, t in flat.items()}
    n = v.count()
    return spark.createDataFrame([(m, n, shares[m] > shares["pca"]) for m in ("tsne", "umap")], "method string, n bigint, keeps_more_than_axes boolean")


# ------------------------------------------------------------------------ clustering


@query("c01_kmeans_labels")
def c01(spark, sf_dir):
    v = vectors(spark, sf_dir)
    fit = cluster.kmeans_fits(v, "vec_id", "embedding", [5])[5]
    return cluster.assign(v, "embedding", fit.centers).select("vec_id", "cluster")


@query("c02_kmeans_centres")
def c02(spark, sf_dir):
    fit = cluster.kmeans_fits(vectors(spark, sf_dir), "vec_id", "embedding", [5])[5]
    rows = [(fit.k, i, [float(x) for x in c], fit.inertia) for i, c in enumerate(fit.centers)]
    return spark.createDataFrame(rows, "k int, cluster int, center array<double>, inertia double")


def _lloyd_sql(steps: int) -> str:
    """CTEs of plain steps from the means of the labels: c<i> centres, n<i> the nearest centre of each vector and its squared distance."""
    parts = [f"WITH {LONG}, c0 AS (SELECT label AS cluster, pos, avg(v) AS v FROM long GROUP BY ALL)"]
    for i in range(1, steps + 1):
        parts.append(f"""d{i} AS (
  SELECT vec_id, cluster, sum((l.v - c.v) * (l.v - c.v)) AS d FROM long l JOIN c{i - 1} c USING (pos) GROUP BY ALL),
n{i} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d{i} GROUP BY vec_id),
c{i} AS (SELECT n.cluster, pos, avg(v) AS v, count(*) AS n FROM long JOIN n{i} n USING (vec_id) GROUP BY ALL)""")
    return ",\n".join(parts)


def _lloyd(spark, sf_dir, steps: int):
    """(centres before the last step, and what it gave), from the means of the labels, which are numbered from 0."""
    v = vectors(spark, sf_dir)
    means = v.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(DIM)]).alias("c")).orderBy("label")
    centers = np.array([r["c"] for r in means.collect()])  # one row per label
    for _ in range(steps - 1):
        centers, _, _ = cluster.lloyd_step(v, "vec_id", "embedding", centers)
    return centers, cluster.lloyd_step(v, "vec_id", "embedding", centers)


@query("c01_lloyd_labels", f"{_lloyd_sql(3)}\nSELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM n3")
def c01_lloyd(spark, sf_dir):
    """Nearest centres in the third step of k-means from the means of the labels."""
    centers, _ = _lloyd(spark, sf_dir, 3)
    return cluster.assign(vectors(spark, sf_dir), "embedding", centers).select("vec_id", "cluster")


@query("c02_lloyd_centres", f"""{_lloyd_sql(2)}
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(pos AS BIGINT) AS pos, round(v, 6) AS value, n,
       round((SELECT sum(d) FROM n2), 4) AS inertia FROM c2""")
def c02_lloyd(spark, sf_dir):
    """Centres, their points and the inertia of the second step."""
    _, (centers, n, inertia) = _lloyd(spark, sf_dir, 2)
    rows = [(i, j + 1, round(float(x), 6), int(n[i]), round(inertia, 4)) for i, c in enumerate(centers) for j, x in enumerate(c)]
    return spark.createDataFrame(rows, "cluster bigint, pos bigint, value double, n bigint, inertia double")


SILHOUETTE = f"""{LABELLED},
d AS (SELECT a.vec_id, a.c AS own, b.c AS other, a.vec_id <> b.vec_id AS apart,
             list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist
      FROM (SELECT *, {{c}} AS c FROM labelled) a, (SELECT *, {{c}} AS c FROM labelled) b),
means AS (SELECT vec_id, own, other, sum(dist) AS t, count(*) AS n FROM d GROUP BY ALL),
ab AS (SELECT vec_id, own, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a,
              min(CASE WHEN own <> other THEN t / n END) AS b FROM means GROUP BY ALL),
score AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s, own FROM ab)
SELECT {{i}} AS candidate, round(avg(s), 6) AS score, count(*) AS n_points, count(DISTINCT own) AS n_clusters FROM score"""


@query("c03_silhouette",
       f"SELECT * FROM (WITH {SILHOUETTE.format(c='cluster', i=0)}) UNION ALL SELECT * FROM (WITH {SILHOUETTE.format(c='(year - 1990) // 8', i=1)})")
def c03(spark, sf_dir):
    """Two labellings of all vectors in one pass: the ready label, and spans of eight years."""
    v = vectors(spark, sf_dir).withColumn("span", F.floor((1994 + F.col("vec_id") % 32 - 1990) / 8))
    found = cluster.silhouettes(v, "vec_id", "embedding", ["label", "span"])
    return found.select("candidate", F.round("score", 6).alias("score"), "n_points", "n_clusters")


@query("c04_kmeans_sweep")
def c04(spark, sf_dir):
    sweep = cluster.kmeans_select(vectors(spark, sf_dir), "vec_id", "embedding")
    rows = [(k, s, k == sweep.best.k) for k, s in sorted(sweep.scores.items())]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen boolean")


_FOLDS = " UNION ALL ".join(f"SELECT {k} AS k, score FROM (WITH {SILHOUETTE.format(c=f'cluster % {k}', i=0)})" for k in range(2, 6))


@query("c04_choose_k", f"""WITH found AS ({_FOLDS})
SELECT k, score AS silhouette, row_number() OVER (ORDER BY score DESC, k) = 1 AS chosen FROM found""")
def c04_choose(spark, sf_dir):
    """The choice among labellings by their exact silhouettes: the ready label modulo k."""
    ks = list(range(2, 6))
    labelled = vectors(spark, sf_dir).select("vec_id", "embedding", *[(F.col("label") % k).alias(f"k{k}") for k in ks])
    rows = cluster.silhouettes(labelled, "vec_id", "embedding", [f"k{k}" for k in ks]).collect()  # one row per k
    scores = {ks[r["candidate"]]: round(r["score"], 6) for r in rows}
    return spark.createDataFrame([(k, s, k == cluster.best_k(scores)) for k, s in scores.items()], "k int, silhouette double, chosen boolean")


EPS = eps_grid()[5]


@query("c05_dbscan_labels", f"""WITH RECURSIVE near AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a, embeddings b
  WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= {EPS!r}),
cores AS (SELECT u AS id FROM near GROUP BY u HAVING count(*) >= 5),
links AS (SELECT u, v FROM near WHERE u IN (SELECT id FROM cores) AND v IN (SELECT id FROM cores)),
reach(id, root) AS (SELECT id, id FROM cores UNION SELECT r.id, l.v FROM reach r JOIN links l ON l.u = r.root),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots),
border AS (SELECT u AS id, min(cluster) AS cluster FROM near JOIN numbered ON numbered.id = v GROUP BY u)
SELECT vec_id AS id, CAST(coalesce(n.cluster, b.cluster, -1) AS BIGINT) AS cluster
FROM embeddings LEFT JOIN numbered n ON n.id = vec_id LEFT JOIN border b ON b.id = vec_id""")
def c05(spark, sf_dir):
    return cluster.dbscan(vectors(spark, sf_dir), "vec_id", "embedding", EPS)


@query("c06_eps_sweep")
def c06(spark, sf_dir):
    return cluster.dbscan_sweep(vectors(spark, sf_dir), "vec_id", "embedding").sweep


ROUNDS = 40  # more than any chain of neighbouring core points needs, in steps from the smallest id


def _sweep_sql(radii) -> str:
    """Every radius by itself: core points, the smallest core id that each reaches, border points, noise-free silhouettes."""
    steps = [f"""l{i} AS MATERIALIZED (SELECT k.i, k.u AS id, min(l.root) AS root FROM links k JOIN l{i - 1} l ON l.i = k.i AND l.id = k.v GROUP BY ALL)"""
             for i in range(1, ROUNDS + 1)]
    return f"""WITH pairs AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v,
  list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b),
radii AS (SELECT unnest(range(1, {len(radii) + 1})) AS i, unnest([{', '.join(repr(float(e)) for e in radii)}]::DOUBLE[]) AS eps),
near AS MATERIALIZED (SELECT i, u, v FROM pairs, radii WHERE d <= eps),
cores AS MATERIALIZED (SELECT i, u AS id FROM near GROUP BY ALL HAVING count(*) >= 5),
links AS MATERIALIZED (SELECT n.i, u, v FROM near n JOIN cores a ON a.i = n.i AND a.id = u JOIN cores b ON b.i = n.i AND b.id = v),
l0 AS (SELECT i, id, id AS root FROM cores),
{(',' + chr(10)).join(steps)},
border AS (SELECT n.i, u AS id, min(root) AS root FROM near n JOIN l{ROUNDS} l ON l.i = n.i AND l.id = v
  WHERE NOT EXISTS (SELECT 1 FROM cores c WHERE c.i = n.i AND c.id = u) GROUP BY ALL),
lab AS MATERIALIZED (SELECT * FROM l{ROUNDS} UNION ALL SELECT * FROM border),
counts AS (SELECT i, count(DISTINCT root) AS k, count(*) AS n FROM lab GROUP BY i),
means AS (SELECT a.i, a.id, a.root AS own, b.root AS other, sum(d) AS t, count(*) AS n
  FROM lab a JOIN lab b ON a.i = b.i JOIN pairs p ON p.u = a.id AND p.v = b.id WHERE a.i IN (SELECT i FROM counts WHERE k >= 2) GROUP BY ALL),
ab AS (SELECT i, id, max(CASE WHEN own = other AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM means GROUP BY ALL),
scores AS (SELECT i, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS score FROM ab GROUP BY i)
SELECT round(eps, 6) AS eps, coalesce(k, 0) AS n_clusters, (SELECT count(*) FROM embeddings) - coalesce(n, 0) AS n_noise, round(score, 6) AS score
FROM radii LEFT JOIN counts USING (i) LEFT JOIN scores USING (i)"""


@query("c06_radius_sweep", _sweep_sql(eps_grid()))
def c06_radii(spark, sf_dir):
    """All ten radii with their noise-free scores."""
    found = cluster.dbscan_sweep(vectors(spark, sf_dir), "vec_id", "embedding").sweep
    return found.select(F.round("eps", 6).alias("eps"), "n_clusters", "n_noise", F.round("score", 6).alias("score"))


@query("c07_fallback_record", """SELECT CAST(NULL AS DOUBLE) AS eps, CAST(-1.0 AS DOUBLE) AS score, CAST(0 AS BIGINT) AS n_clusters,
  CAST(0 AS BIGINT) AS n_noise, count(*) AS labelled, CAST(1 AS BIGINT) AS labels FROM embeddings""")
def c07_record(spark, sf_dir):
    """What the sweep says where no radius is valid, and how many labels it gives."""
    found = cluster.dbscan_sweep(vectors(spark, sf_dir), "vec_id", "embedding", AnalysisSettings(eps_values=eps_grid(0.01, 0.05, 3)))
    counts = found.labels.agg(F.count(F.lit(1)).alias("labelled"), F.count_distinct("cluster").alias("labels"))
    return counts.select(F.lit(found.eps).cast("double").alias("eps"), F.lit(found.score).cast("double").alias("score"),
                         F.lit(found.n_clusters).cast("bigint").alias("n_clusters"), F.lit(found.n_noise).cast("bigint").alias("n_noise"),
                         "labelled", "labels")


@query("c07_sweep_fallback", "SELECT vec_id AS id, CAST(0 AS BIGINT) AS cluster FROM embeddings")
def c07(spark, sf_dir):
    """Radii too small for any core point: one label for all."""
    settings = AnalysisSettings(eps_values=eps_grid(0.01, 0.05, 3))
    return cluster.dbscan_sweep(vectors(spark, sf_dir), "vec_id", "embedding", settings).labels


@query("c08_label_counts", """SELECT count(DISTINCT CASE WHEN label >= 1 THEN label END) AS n_clusters,
  count(*) FILTER (label = 0) AS n_noise FROM embeddings""")
def c08(spark, sf_dir):
    """Label 0 plays the noise."""
    return cluster.label_counts(vectors(spark, sf_dir).select((F.col("label") - 1).alias("cluster")))
