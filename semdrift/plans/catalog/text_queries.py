"""Cleaning, statistics and key queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.config import CleanSettings
from semdrift.functions import names as N
from semdrift.functions import text as X
from semdrift.functions.stopwords import DEFAULT
from semdrift.operators import clean, ingest, meta
from semdrift.plans.catalog.base import (
    CORPUS, content_list, era_case, normalised, query, quoted, safe_name, squeeze, stopword_list, sub,
)
from semdrift.sources import landed, sinks
from semdrift.sources.corpus import corpus, spread, table, texts
from semdrift.session import scratch_path


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with an order number, a numeric date, a citation and a URL behind it."""
    d = texts(spark, sf_dir)
    tail = F.concat(F.lit(" Executive  Order "), F.col("doc_id").cast("string"),
                    F.lit(" of 1/27/2017 [82 FR 8977] see https://example.org/x?id="), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.concat("text", tail).alias("text"))


NOISY = """noisy AS (SELECT doc_id, text || ' Executive  Order ' || doc_id
  || ' of 1/27/2017 [82 FR 8977] see https://example.org/x?id=' || doc_id AS text FROM documents)"""


def _text_query(key: str, fn, sql_expr: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return noisy(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("text"))

    query(key, f"WITH {NOISY} SELECT doc_id, {sql_expr} AS text FROM noisy")(run)


NORMAL = normalised("text")
_text_query("t01_remove_order_number", X.remove_order_number, sub("text", X.ORDER_NO))
_text_query("t02_remove_numeric_dates", X.remove_numeric_dates, sub("text", X.NUMERIC_DATE))
_text_query("t03_remove_citations", X.remove_citations, sub("text", X.CITATION))
_text_query("t04_remove_urls", X.remove_urls, sub("text", X.URL))
_text_query("t05_lower_case", F.lower, "lower(text)")
_text_query("t06_keep_letters", lambda c: X.keep_letters(F.lower(c)), sub("lower(text)", X.NON_ALPHA))
_text_query("t07_collapse_space", X.collapse_space, squeeze("text"))
_text_query("t12_truncate", lambda c: X.truncate(X.normalise(c), 5000), f"substring({NORMAL}, 1, 5000)")


@query("t08_tokenise", f"""WITH {NOISY}
SELECT doc_id, CAST(len(list_filter(string_split({NORMAL}, ' '), lambda w: w <> '')) AS BIGINT) AS n_tokens,
       md5(array_to_string(list_filter(string_split({NORMAL}, ' '), lambda w: w <> ''), '|')) AS tokens_md5
FROM noisy""")
def t08(spark, sf_dir):
    words = noisy(spark, sf_dir).select("doc_id", X.tokens(X.normalise(F.col("text"))).alias("w"))
    return words.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"),
                        F.md5(F.array_join("w", "|")).alias("tokens_md5"))


@query("t09_keep_long_words", f"""WITH {NOISY}
SELECT doc_id, array_to_string(list_filter(string_split({NORMAL}, ' '), lambda w: length(w) >= 3), ' ') AS text
FROM noisy""")
def t09(spark, sf_dir):
    words = X.keep_long(X.tokens(X.normalise(F.col("text"))), 3)
    return noisy(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("text"))


def _t10_sql() -> str:
    return f"""WITH {NOISY}
SELECT doc_id, array_to_string(list_filter(string_split({NORMAL}, ' '),
       lambda w: w <> '' AND w NOT IN ({stopword_list()})), ' ') AS text FROM noisy"""


def _cleaned_cte() -> str:
    return f"cleaned AS (SELECT doc_id, text, array_to_string({content_list(NORMAL)}, ' ') AS processed FROM noisy)"


# A plural whose singular is a word of the corpus as well: a dictionary that grows with the vocabulary.
def corpus_lemmas(cleaned: DataFrame) -> DataFrame:
    words = cleaned.select(F.explode(X.tokens(F.col("processed"))).alias("w")).distinct()
    plural = words.filter(F.col("w").endswith("s") & (F.length("w") > 3)).select(
        F.col("w").alias("form"), F.expr("substring(w, 1, length(w) - 1)").alias("lemma"))
    return plural.join(words.select(F.col("w").alias("lemma")), "lemma", "left_semi")


def _lemma_ctes() -> str:
    return f"""{NOISY}, {_cleaned_cte()},
words AS (SELECT DISTINCT unnest(string_split(processed, ' ')) AS w FROM cleaned),
lemmas AS (SELECT w AS form, substring(w, 1, length(w) - 1) AS lemma FROM words
           WHERE w LIKE '%s' AND length(w) > 3 AND substring(w, 1, length(w) - 1) IN (SELECT w FROM words)),
split AS (SELECT doc_id, generate_subscripts(string_split(processed, ' '), 1) AS pos,
                 unnest(string_split(processed, ' ')) AS w FROM cleaned),
lemmatised AS (SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY pos) AS processed
               FROM split LEFT JOIN lemmas ON w = form GROUP BY doc_id)"""


def _cleaned(spark, sf_dir) -> DataFrame:
    settings = CleanSettings(use_lemmas=False)
    return clean.clean_corpus(noisy(spark, sf_dir), "doc_id", settings)


def register() -> None:
    """Queries over cleaned texts; their twins share long fragments of SQL."""

    @query("t10_drop_stopwords", _t10_sql())
    def t10(spark, sf_dir):
        words = X.drop_stopwords(X.tokens(X.normalise(F.col("text"))), DEFAULT)
        return noisy(spark, sf_dir).select("doc_id", F.array_join(words, " ").alias("text"))

    @query("t11_lemmatise", f"WITH {_lemma_ctes()} SELECT doc_id, processed AS text FROM lemmatised")
    def t11(spark, sf_dir):
        cleaned = _cleaned(spark, sf_dir)
        return clean.lemmatise(cleaned, corpus_lemmas(cleaned), "doc_id", "processed").select(
            "doc_id", F.col("processed").alias("text"))

    @query("t11_lemmatise_by_join", f"WITH {_lemma_ctes()} SELECT doc_id, processed AS text FROM lemmatised")
    def t11j(spark, sf_dir):
        cleaned = _cleaned(spark, sf_dir)
        forms = corpus_lemmas(cleaned).groupBy("form").agg(F.min("lemma").alias("lemma"))
        return clean._lemmatise_by_join(cleaned, forms, "doc_id", "processed").select(
            "doc_id", F.col("processed").alias("text"))

    @query("t13_clean_text", f"WITH {NOISY}, {_cleaned_cte()} SELECT doc_id, processed AS text FROM cleaned")
    def t13(spark, sf_dir):
        return _cleaned(spark, sf_dir).select("doc_id", F.col("processed").alias("text"))

    @query("t14_clean_with_rejects", f"""WITH {NOISY},
judged AS (SELECT doc_id, n.text, CASE WHEN l.toxic = 1 THEN 'no text' END AS reason
           FROM noisy n LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce(reason, 'cleaned') AS state,
       CASE WHEN reason IS NULL THEN array_to_string({content_list(NORMAL)}, ' ') ELSE '' END AS text FROM judged""")
    def t14(spark, sf_dir):
        """Documents flagged toxic lose their text, as an unreadable file would."""
        flags = table(spark, sf_dir, "labels").select("doc_id", "toxic")
        docs = noisy(spark, sf_dir).join(flags, "doc_id", "left").select(
            "doc_id", F.when(F.coalesce("toxic", F.lit(0)) != 1, F.col("text")).alias("text"))
        good, bad = clean.split_rejects(docs, "doc_id")
        done = clean.clean_corpus(good, "doc_id", CleanSettings(use_lemmas=False))
        return done.select("doc_id", F.lit("cleaned").alias("state"), F.col("processed").alias("text")).unionByName(
            bad.select("doc_id", F.col("reason").alias("state"), F.lit("").alias("text")))

    processed_words = "len(list_filter(string_split(processed, ' '), lambda w: w <> ''))"
    stats_sql = f"""{NOISY}, {_cleaned_cte()},
parts AS (
  SELECT doc_id, text, processed, CAST({processed_words} AS BIGINT) AS processed_words,
         CAST(len(regexp_extract_all(text, '{X.NON_SPACE}+')) AS BIGINT) AS original_words,
         CAST(len(list_filter(regexp_split_to_array(text, '{quoted(X.SENTENCE_END)}'),
              lambda s: regexp_matches(s, '{X.NON_SPACE}'))) AS BIGINT) AS sentence_count,
         CAST(list_sum(list_transform(regexp_extract_all(lower(text), '{X.NON_SPACE}+'),
              lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+'))))) AS BIGINT) AS syllables
  FROM cleaned),
ratios AS (
  SELECT *, CASE WHEN original_words > 0 THEN processed_words / original_words ELSE 0.0 END AS compression_ratio,
         CASE WHEN sentence_count > 0 THEN original_words / sentence_count ELSE 0.0 END AS wps,
         CASE WHEN original_words > 0 THEN coalesce(syllables, 0) / original_words ELSE 0.0 END AS spw,
         CASE WHEN processed_words > 0 THEN length(replace(processed, ' ', '')) / processed_words ELSE 0.0 END AS awl
  FROM parts),
measured AS (
  SELECT doc_id, original_words, processed_words, round(compression_ratio, 6) AS compression_ratio, sentence_count,
         round(awl, 6) AS avg_word_length, round(206.835 - 1.015 * wps - 84.6 * spw, 6) AS flesch_reading_ease,
         round(0.39 * wps + 11.8 * spw - 15.59, 6) AS flesch_kincaid_grade,
         CAST(len(list_distinct(list_filter(string_split(processed, ' '), lambda w: w <> ''))) AS BIGINT) AS unique_words
  FROM ratios)"""

    def measured(spark, sf_dir) -> DataFrame:
        stats = clean.clean_and_measure(noisy(spark, sf_dir), "doc_id", CleanSettings(use_lemmas=False)).drop("text")
        kinds = {f.name: f.dataType.simpleString() for f in stats.schema}
        return stats.select("doc_id", *[
            F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c).cast("bigint").alias(c)
            for c in stats.columns if c != "doc_id"])

    def part(key: str, *columns: str) -> None:
        def run(spark, sf_dir):
            return measured(spark, sf_dir).select("doc_id", *columns)

        query(key, f"WITH {stats_sql} SELECT doc_id, {', '.join(columns)} FROM measured")(run)

    part("m01_original_words", "original_words")
    part("m02_processed_words", "processed_words")
    part("m03_compression_ratio", "compression_ratio")
    part("m04_sentence_count", "sentence_count")
    part("m05_avg_word_length", "avg_word_length")
    part("m06_reading_ease", "flesch_reading_ease")
    part("m07_grade_level", "flesch_kincaid_grade")
    part("m08_unique_words", "unique_words")
    part("m_text_stats", "original_words", "processed_words", "compression_ratio", "sentence_count", "avg_word_length",
         "flesch_reading_ease", "flesch_kincaid_grade", "unique_words")

    # Metadata exists for labelled documents only, so the defaults show as well.
    known = f"""{stats_sql}, {CORPUS.strip()},
meta AS (SELECT c.doc_id, c.filename, c.president, c.date, c.eo_number FROM corpus c JOIN labels l USING (doc_id))"""

    def raw_metadata(spark, sf_dir) -> DataFrame:
        docs = corpus(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
        return docs.select("filename", "president", "date", "eo_number")

    def stats_by_filename(spark, sf_dir) -> DataFrame:
        keys = corpus(spark, sf_dir).select("doc_id", "filename")
        return measured(spark, sf_dir).join(keys, "doc_id").drop("doc_id")

    @query("m09_stats_with_metadata", f"""WITH {known}
SELECT c.filename, original_words, processed_words, unique_words, coalesce(meta.president, 'Unknown') AS president,
       coalesce(meta.date, '') AS date, coalesce(meta.eo_number, '') AS eo_number
FROM measured JOIN corpus c USING (doc_id) LEFT JOIN meta ON meta.filename = c.filename""")
    def m09(spark, sf_dir):
        stats = stats_by_filename(spark, sf_dir).select("filename", "original_words", "processed_words", "unique_words")
        return clean.with_metadata(stats, raw_metadata(spark, sf_dir))

    @query("s12_stats_table", f"""WITH {stats_sql}, {CORPUS.strip()}
SELECT filename, original_words, processed_words, compression_ratio, sentence_count, avg_word_length,
       flesch_reading_ease, flesch_kincaid_grade, unique_words FROM measured JOIN corpus USING (doc_id)""")
    def s12(spark, sf_dir):
        path = scratch_path(spark, "stats")
        sinks.write_table(stats_by_filename(spark, sf_dir), path)
        return spark.read.parquet(path)

    @query("x01_metadata_export", f"""WITH {stats_sql}, {CORPUS.strip()}
SELECT c.filename, eo_number, date, CAST(year AS VARCHAR) AS year, president, original_words, processed_words,
       compression_ratio, sentence_count, avg_word_length, flesch_reading_ease, flesch_kincaid_grade, unique_words
FROM corpus c JOIN measured USING (doc_id)""")
    def x01(spark, sf_dir):
        from semdrift.plans.report import metadata_with_stats

        metadata = meta.metadata_frame(corpus(spark, sf_dir))
        return metadata_with_stats(metadata, stats_by_filename(spark, sf_dir))


# ----------------------------------------------------------------- ingest and keys


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API records of the corpus: landed pages give the urls, some fields are absent."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = corpus(spark, sf_dir).join(pages, "doc_id", "left")
    return docs.select(
        "doc_id",
        F.when(F.col("lang") != "de", F.col("eo_number")).alias("executive_order_number"),
        F.when(F.col("lang") != "fr", F.col("title")).alias("title"),
        F.col("date").alias("publication_date"),
        F.when(F.col("lang") != "es", F.col("president")).alias("president"),
        F.col("url").alias("html_url"),
        F.when(F.col("lang") == "en", F.concat(F.lit("https://example.org/pdf/"), "eo_number")).alias("pdf_url"),
    )


LISTING = f"""{CORPUS.strip()},
listing AS (
  SELECT c.doc_id, CASE WHEN lang <> 'de' THEN eo_number END AS executive_order_number,
         CASE WHEN lang <> 'fr' THEN title END AS title, date AS publication_date,
         CASE WHEN lang <> 'es' THEN president END AS president, url AS html_url,
         CASE WHEN lang = 'en' THEN 'https://example.org/pdf/' || eo_number END AS pdf_url
  FROM corpus c LEFT JOIN pages ON page_id = c.doc_id),
filled AS (
  SELECT doc_id, coalesce(executive_order_number, 'NA') AS eo_number, coalesce(title, 'Untitled') AS title,
         coalesce(publication_date, '') AS date, coalesce(president, 'Unknown') AS president,
         coalesce(html_url, '') AS html_url, coalesce(pdf_url, '') AS pdf_url FROM listing),
records AS (
  SELECT *, 'EO_' || eo_number || '_' || date || '_' || substring({safe_name('title')}, 1, 50) || '.txt' AS filename
  FROM filled)"""
RECORD = ["executive_order_number", "title", "publication_date", "president", "html_url", "pdf_url"]


@query("s01_listing_ingest", f"WITH {LISTING} SELECT {', '.join(RECORD)} FROM listing")
def s01(spark, sf_dir):
    """Landed API pages of up to a thousand records each, read back with the explicit schema."""
    path = scratch_path(spark, "listing")
    records = listing(spark, sf_dir)
    pages = records.groupBy(F.floor(F.col("doc_id") / 1000).alias("page")).agg(
        F.collect_list(F.struct(*RECORD)).alias("results"))
    pages.select("results").write.json(path)
    return landed.read_listing(spark, path, multiline=False)


@query("s02_type_and_dates", """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'""")
def s02(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "publication_date")
    return ingest.select_orders(orders, 1994, 1996, "F", "o_orderstatus").select("o_orderkey", "o_totalprice")


@query("s03_newest_first_pages", """SELECT o_orderkey, position, CAST(ceil(position / 1000.0) AS BIGINT) AS page FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders)""")
def s03(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ingest.paged(orders, 1000, "o_orderdate", "o_orderkey").select("o_orderkey", "position", "page")


@query("s03_one_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000 OFFSET 1000")
def s03_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ingest.page(orders, 2, 1000, "o_orderdate", "o_orderkey").select("o_orderkey")


FIELDS = "eo_number, title, date, president, html_url, pdf_url"


@query("s04_normalise_records", f"WITH {LISTING} SELECT doc_id, {FIELDS} FROM records")
def s04(spark, sf_dir):
    return ingest.normalise_records(listing(spark, sf_dir)).select("doc_id", *FIELDS.split(", "))


@query("s06_safe_file_name", f"WITH {CORPUS} SELECT doc_id, substring({safe_name('title')}, 1, 50) AS safe_title FROM corpus")
def s06(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", N.safe_name(F.col("title"), 50).alias("safe_title"))


@query("s07_document_key", f"WITH {LISTING} SELECT doc_id, filename FROM records")
def s07(spark, sf_dir):
    return ingest.normalise_records(listing(spark, sf_dir)).select("doc_id", "filename")


# Equal texts share title, and with a date from the text's length also the key.
@query("s08_last_write_wins", f"""WITH {CORPUS.strip()},
keyed AS (SELECT doc_id, text, 'EO_NA_' || (1994 + length(text) % 32) || '_' || substring({safe_name('title')}, 1, 50) || '.txt' AS filename FROM corpus),
ranked AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id DESC) AS n FROM keyed)
SELECT filename, doc_id, md5(text) AS text_md5 FROM ranked WHERE n = 1""")
def s08(spark, sf_dir):
    year = (1994 + F.length("text") % 32).cast("string")
    keyed = corpus(spark, sf_dir).select(
        "doc_id", "text", N.document_key(F.lit("NA"), year, F.col("title")).alias("filename"))
    return ingest.last_write_wins(keyed, ["doc_id"]).select("filename", "doc_id", F.md5("text").alias("text_md5"))


@query("s09_raw_metadata_csv", f"WITH {LISTING} SELECT eo_number, president, date, title, filename, html_url, pdf_url FROM records")
def s09(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    records = ingest.normalise_records(listing(spark, sf_dir))
    sinks.write_csv(records.select("eo_number", "president", "date", "title", "filename", "html_url", "pdf_url"), path)
    return landed.read_raw_metadata(spark, path)


@query("s10_document_files", """SELECT CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5, true AS named
FROM documents""")
def s10(spark, sf_dir):
    """One landed file per document, read whole with its file name; the writer ends each with a line feed."""
    path = scratch_path(spark, "documents")
    sinks.write_document_files(table(spark, sf_dir, "documents").select("text"), path)
    text = F.regexp_replace("text", r"\n\z", "")
    return landed.read_documents(spark, path).select(
        F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"),
        F.col("filename").endswith(".txt").alias("named"))


@query("s10_keyed_documents", "SELECT 'item ' || item_id || '.txt' AS filename, length(text) AS n_chars, md5(text) AS text_md5 FROM benchmark")
def s10_keyed(spark, sf_dir):
    """Files below folders that carry the key, read back with it."""
    path = scratch_path(spark, "keyed")
    name = F.concat(F.lit("item "), F.col("item_id"), F.lit(".txt"))
    sinks.write_keyed_documents(table(spark, sf_dir, "benchmark").select(name.alias("filename"), "text"), path)
    return landed.read_keyed_documents(spark, path).select(
        "filename", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("s10_packed_documents", f"WITH {CORPUS} SELECT filename, length(text) AS n_chars, md5(text) AS text_md5 FROM corpus")
def s10_packed(spark, sf_dir):
    """Many documents to a file, each with its name."""
    path = scratch_path(spark, "packed")
    sinks.write_packed_documents(corpus(spark, sf_dir), path)
    return landed.read_packed_documents(spark, path).select(
        "filename", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("s11_metadata_lookup", f"""WITH {CORPUS.strip()}, meta AS (SELECT c.* FROM corpus c JOIN labels USING (doc_id))
SELECT c.filename, coalesce(m.president, 'Unknown') AS president, coalesce(m.date, '') AS date,
       coalesce(m.eo_number, '') AS eo_number FROM corpus c LEFT JOIN meta m ON m.filename = c.filename""")
def s11(spark, sf_dir):
    path = scratch_path(spark, "metadata")
    docs = corpus(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    blank = [F.lit("").alias(c) for c in ("html_url", "pdf_url")]
    sinks.write_csv(labelled.select("eo_number", "president", "date", "title", "filename", *blank), path)
    return clean.with_metadata(docs.select("filename"), landed.read_raw_metadata(spark, path))


# ------------------------------------------------------------------------- metadata


@query("g01_parse_document_key", f"""WITH {CORPUS}
SELECT filename, string_split(replace(replace(filename, 'EO_', ''), '.txt', ''), '_')[1] AS eo_number,
       string_split(replace(replace(filename, 'EO_', ''), '.txt', ''), '_')[2] AS date FROM corpus""")
def g01(spark, sf_dir):
    return meta.parse_keys(corpus(spark, sf_dir).select("filename")).select("filename", "eo_number", "date")


# Dates lose characters with the language, so short ones occur.
DATES = "CASE lang WHEN 'de' THEN substring(date, 1, 3) WHEN 'fr' THEN '' WHEN 'es' THEN substring(date, 1, 4) ELSE date END"


@query("g02_year_of_date", f"""WITH {CORPUS}
SELECT doc_id, CASE WHEN length({DATES}) >= 4 THEN substring({DATES}, 1, 4) ELSE 'Unknown' END AS year FROM corpus""")
def g02(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", N.year_text(F.expr(DATES)).alias("year"))


# Years before, between and after the eras, and texts that are no year.
YEARS = "CASE WHEN lang = 'de' THEN 'Unknown' WHEN lang = 'es' THEN '20x4' ELSE CAST(1985 + doc_id % 50 AS STRING) END"


@query("g03_era_lookup", f"""WITH y AS (SELECT doc_id, {YEARS} AS year FROM documents)
SELECT doc_id, year, {era_case('TRY_CAST(year AS INTEGER)')} AS president FROM y""")
def g03(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(YEARS).alias("year"))
    return meta.era_lookup(docs, meta.era_table(spark)).select("doc_id", "year", "president")


@query("g03_era_expression", f"""WITH y AS (SELECT doc_id, {YEARS} AS year FROM documents)
SELECT doc_id, year, {era_case('TRY_CAST(year AS INTEGER)')} AS president FROM y""")
def g03_fast(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(YEARS).alias("year"))
    return docs.select("doc_id", "year", N.era_of(F.col("year")).alias("president"))


OVERRIDES = f"""{CORPUS.strip()},
stats AS (SELECT c.eo_number, c.filename, c.source AS president FROM corpus c JOIN labels USING (doc_id)
          UNION ALL SELECT c.eo_number, c.filename || '~', c.lang FROM corpus c JOIN labels USING (doc_id)),
firsts AS (SELECT eo_number, arg_min(president, filename) AS president FROM stats GROUP BY eo_number)"""


def _stats_rows(spark, sf_dir) -> DataFrame:
    known = corpus(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return known.select("eo_number", "filename", F.col("source").alias("president")).unionByName(
        known.select("eo_number", F.concat("filename", F.lit("~")).alias("filename"), F.col("lang").alias("president")))


@query("g04_override_president", f"""WITH {OVERRIDES}
SELECT c.filename, coalesce(f.president, c.president) AS president FROM corpus c LEFT JOIN firsts f USING (eo_number)""")
def g04(spark, sf_dir):
    docs = corpus(spark, sf_dir).select("filename", "eo_number", "president")
    return meta.override_president(docs, _stats_rows(spark, sf_dir)).select("filename", "president")


@query("g05_metadata_frame", f"""WITH {OVERRIDES}
SELECT c.filename, c.eo_number, c.date, CAST(c.year AS VARCHAR) AS year, coalesce(f.president, c.president) AS president
FROM corpus c LEFT JOIN firsts f USING (eo_number)""")
def g05(spark, sf_dir):
    return meta.metadata_frame(corpus(spark, sf_dir), _stats_rows(spark, sf_dir))


@query("g06_align_vectors", f"""WITH {CORPUS}
SELECT filename, president, vec_id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings JOIN corpus ON vec_id = doc_id""")
def g06(spark, sf_dir):
    keys = corpus(spark, sf_dir).select("doc_id", "filename")
    vectors = table(spark, sf_dir, "embeddings").join(keys, F.col("vec_id") == F.col("doc_id")).select(
        "filename", "vec_id", F.size("embedding").cast("bigint").alias("dim"))
    metadata = meta.metadata_frame(corpus(spark, sf_dir)).select("filename", "president")
    return meta.align(vectors, metadata).select("filename", "president", "vec_id", "dim")


@query("g07_valid_years", f"""WITH y AS (SELECT doc_id, {YEARS} AS year FROM documents)
SELECT doc_id, TRY_CAST(year AS INTEGER) AS year FROM y WHERE TRY_CAST(year AS INTEGER) IS NOT NULL""")
def g07(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(YEARS).alias("year"))
    return meta.with_valid_year(docs).select("doc_id", "year")


# ----------------------------------------------------------------------------- pages

_TAGLESS = "html"
for _tag in ("script", "style"):
    _TAGLESS = sub(_TAGLESS, rf"(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>")
_TAGLESS = sub(_TAGLESS, r"(?s)<!--.*?-->")
for _tag in ("nav", "header", "footer"):
    _TAGLESS = sub(_TAGLESS, rf"(?is)<{_tag}\b[^>]*>.*?</{_tag}\s*>")


def _inner(tag: str, greedy: str = "?") -> str:
    return f"nullif(regexp_extract(bare, '(?is)<{tag}\\b[^>]*>(.*{greedy})</{tag}\\s*>', 1), '')"


def _decoded(expr: str) -> str:
    from semdrift.functions.html import ENTITIES

    for name, char in ENTITIES:
        expr = f"replace({expr}, '{name}', '{quoted(char)}')"
    return expr


PAGE_TEXT = f"""bared AS (SELECT page_id, url, {_TAGLESS} AS bare FROM pages),
mains AS (SELECT page_id, url, coalesce({_inner('main')}, {_inner('article')}, {_inner('body', '')}) AS inner_html FROM bared),
texts AS (SELECT page_id, url, {squeeze(_decoded(sub('inner_html', '(?s)<[^>]*>')))} AS text FROM mains)"""


@query("h01_strip_boilerplate", f"SELECT page_id, {squeeze(_TAGLESS)} AS html FROM pages")
def h01(spark, sf_dir):
    from semdrift.functions.html import strip_boilerplate

    return table(spark, sf_dir, "pages").select("page_id", X.collapse_space(strip_boilerplate(F.col("html"))).alias("html"))


@query("h02_main_content", f"WITH {PAGE_TEXT} SELECT page_id, inner_html FROM mains")
def h02(spark, sf_dir):
    from semdrift.functions.html import main_content, strip_boilerplate

    return table(spark, sf_dir, "pages").select("page_id", main_content(strip_boilerplate(F.col("html"))).alias("inner_html"))


@query("h03_visible_text", f"WITH {PAGE_TEXT} SELECT url, text FROM texts")
def h03(spark, sf_dir):
    return ingest.page_texts(spread(table(spark, sf_dir, "pages"), "page_id")).select("url", "text")


@query("h03_visible_text_by_columns", f"WITH {PAGE_TEXT} SELECT page_id, text FROM texts")
def h03_columns(spark, sf_dir):
    from semdrift.functions.html import page_text_by_columns

    pages = spread(table(spark, sf_dir, "pages"), "page_id")
    return pages.select("page_id", page_text_by_columns(F.col("html")).alias("text"))


@query("h04_tolerate_failures", f"""WITH {PAGE_TEXT},
hurt AS (SELECT t.page_id, CASE WHEN l.doc_id IS NULL THEN t.text END AS text FROM texts t LEFT JOIN labels l ON l.doc_id = t.page_id)
SELECT page_id, text, text IS NULL AS failed FROM hurt""")
def h04(spark, sf_dir):
    """Pages of labelled documents arrive empty-handed; the job goes on with NULL text."""
    pages = table(spark, sf_dir, "pages")
    lost = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.lit(True).alias("lost"))
    hurt = pages.join(lost, "page_id", "left").select(
        "page_id", F.col("page_id").cast("string").alias("url"), F.when(F.col("lost").isNull(), F.col("html")).alias("html"))
    texts = ingest.page_texts(hurt)
    return texts.select(F.col("url").cast("bigint").alias("page_id"), "text", F.col("text").isNull().alias("failed"))


def _divided(spark, sf_dir) -> DataFrame:
    """Pages whose article is a division of class content."""
    html = F.regexp_replace(F.col("html"), r"(?i)<article\b[^>]*>", '<div id="a" class="wide content">')
    html = F.regexp_replace(html, r"(?i)</article\s*>", "</div>")
    return table(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query("h02_content_division", f"WITH {PAGE_TEXT} SELECT page_id, text FROM texts")
def h02_division(spark, sf_dir):
    from semdrift.functions.html import page_text_by_columns

    return _divided(spark, sf_dir).select("page_id", page_text_by_columns(F.col("html")).alias("text"))


@query("h02_content_division_by_walk", f"WITH {PAGE_TEXT} SELECT page_id, text FROM texts")
def h02_division_walk(spark, sf_dir):
    from semdrift.functions.html import page_text_by_walk

    return _divided(spark, sf_dir).select("page_id", page_text_by_walk(F.col("html"))["text"].alias("text"))


@query("h04_broken_markup", f"""WITH {PAGE_TEXT}
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN text END AS text, page_id % 5 = 0 AS failed FROM texts""")
def h04_broken(spark, sf_dir):
    """Every fifth page holds a declaration that the parser gives up on: its text is NULL with an error, the others are read."""
    from semdrift.functions.html import page_text_by_walk

    html = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<![x[y]]>"), F.col("html"))).otherwise(F.col("html"))
    read = table(spark, sf_dir, "pages").select("page_id", page_text_by_walk(html).alias("r"))
    return read.select("page_id", F.col("r.text").alias("text"), F.col("r.error").isNotNull().alias("failed"))


@query("s05_content_fallback", f"""WITH {LISTING}, {PAGE_TEXT},
per_url AS (SELECT url, max(text) AS text FROM texts GROUP BY url)
SELECT doc_id, filename, coalesce(t.text, CASE WHEN pdf_url <> '' THEN 'PDF_CONTENT_NOT_EXTRACTED' END, 'CONTENT_NOT_AVAILABLE') AS text
FROM records LEFT JOIN per_url t ON t.url = html_url AND html_url <> ''""")
def s05(spark, sf_dir):
    records = ingest.normalise_records(listing(spark, sf_dir))
    texts = ingest.page_texts(spread(table(spark, sf_dir, "pages"), "page_id"))
    return ingest.resolve_content(records, texts).select("doc_id", "filename", "text")
