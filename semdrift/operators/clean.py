"""Cleaning a corpus and measuring its texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.config import CleanSettings
from semdrift.functions import text as T
from semdrift.functions.stopwords import DEFAULT
from semdrift.operators.skew import lookup_join

# A dictionary up to this many forms (a few MB) travels with the tasks; a
# larger one is joined.
MAX_SHIPPED_FORMS = 200_000


def content_text(text: Column, settings: CleanSettings, stopwords: Sequence[str] | None = None) -> Column:
    """Normalised text, without short words and stopwords unless those are kept."""
    cleaned = T.normalise(text)
    if not settings.remove_stopwords:
        return cleaned
    return F.array_join(T.content_words(cleaned, settings.min_word_length, stopwords or DEFAULT), " ")


def lemmatise(documents: DataFrame, lemmas: DataFrame, key: str, text: str = "text",
              max_chars: int | None = None) -> DataFrame:
    """Replace every word that is a ``form`` by its ``lemma``; other words stay.

    ``text`` holds words joined by single spaces. The dictionary's size is
    checked: small ones are shipped and no text is shuffled.
    """
    documents = documents.withColumn(text, T.truncate(F.col(text), max_chars))
    forms = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    shipped = forms.limit(MAX_SHIPPED_FORMS + 1).toPandas()
    if len(shipped) <= MAX_SHIPPED_FORMS:
        return documents.withColumn(text, _ship(shipped)(F.col(text)))
    return _lemmatise_by_join(documents, forms, key, text)


def _ship(forms: pd.DataFrame):
    """Column function: the words of all texts of a batch as one Arrow array, each looked up by its place among the forms."""
    known, lemma = pa.array(forms["form"], pa.string()), pa.array(forms["lemma"], pa.string())

    @F.arrow_udf("string")
    def replace_forms(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        replaced = pc.coalesce(lemma.take(pc.index_in(words, value_set=known)), words)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, replaced), " ")
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.string()), joined)

    return replace_forms


def _lemmatise_by_join(documents: DataFrame, forms: DataFrame, key: str, text: str) -> DataFrame:
    words = documents.select(key, F.posexplode(T.tokens(F.col(text))).alias("_pos", "form"))
    words = words.withColumn("_row", F.struct(key, "_pos"))
    named = lookup_join(words, forms, "form", "_row").select(
        key, "_pos", F.coalesce("lemma", "form").alias("_word")
    )
    texts = named.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("_pos", "_word")))["_word"], " ").alias("_text")
    )
    # a null text stays null, as where the dictionary is shipped
    return (
        documents.withColumnRenamed(text, "_before").join(texts, key, "left")
        .withColumn(text, F.when(F.col("_before").isNotNull(), F.coalesce("_text", F.lit(""))))
        .drop("_text", "_before").select(*documents.columns)
    )


def clean_corpus(documents: DataFrame, key: str, settings: CleanSettings = CleanSettings(),
                 lemmas: DataFrame | None = None, stopwords: Sequence[str] | None = None) -> DataFrame:
    """Adds ``processed``: the cleaned text before the final cut."""
    cleaned = documents.withColumn("processed", content_text(F.col("text"), settings, stopwords))
    if settings.use_lemmas and lemmas is not None:
        cleaned = lemmatise(cleaned, lemmas, key, "processed", settings.lemma_chars)
    return cleaned


def measure(texts: DataFrame, original: str, processed: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the eight measures of every document.

    Counts are worked out once in an inner projection; the ratios only read them.
    """
    flat = texts.select(*keep, T.collapse_space(F.col(original)).alias("_flat"), T.tokens(F.col(processed)).alias("_kept"))
    marked = flat.withColumn("_marked", T.mark_vowels(F.col("_flat")))
    counted = marked.select(
        *keep,
        T.word_count(F.col("_flat")).alias("original_words"),
        T.sentence_count(F.col("_flat")).alias("sentence_count"),
        T.syllable_count(F.col("_marked")).alias("_syllables"),
        "_kept",
    )
    words, sentences, syllables = F.col("original_words"), F.col("sentence_count"), F.col("_syllables")
    kept = F.col("_kept")
    return counted.select(
        *keep,
        words,
        F.size(kept).alias("processed_words"),
        T.compression_ratio(F.size(kept), words).alias("compression_ratio"),
        sentences,
        T.avg_word_length(kept).alias("avg_word_length"),
        T.reading_ease(words, sentences, syllables).alias("flesch_reading_ease"),
        T.grade_level(words, sentences, syllables).alias("flesch_kincaid_grade"),
        T.unique_words(kept).alias("unique_words"),
    )


def clean_and_measure(documents: DataFrame, key: str, settings: CleanSettings = CleanSettings(),
                      lemmas: DataFrame | None = None, stopwords: Sequence[str] | None = None) -> DataFrame:
    """(key, text, eight measures): the measures see the text before the final cut."""
    cleaned = clean_corpus(documents, key, settings, lemmas, stopwords)
    cut_text = T.truncate(F.col("processed"), settings.max_text_length).alias("_out")
    measured = measure(cleaned.select(key, "text", "processed", cut_text), "text", "processed", [key, "_out"])
    return measured.withColumnRenamed("_out", "text")


def split_rejects(documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects): a document without key, without text or with broken characters is set aside."""
    reason = F.when(F.col(key).isNull(), "no key").when(F.col("text").isNull(), "no text").when(
        F.col("text").contains("�"), "undecodable text"
    )
    judged = documents.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def with_metadata(stats: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """Measures with president, date and number; absent ones get their defaults. Of several rows of a file name the last one holds."""
    rows = metadata.select(key, F.struct("president", "date", "eo_number").alias("_m"), F.monotonically_increasing_id().alias("_at"))
    known = rows.groupBy(key).agg(F.max_by("_m", "_at").alias("_m"))
    return lookup_join(stats, known, key, key).select(
        *stats.columns,
        F.coalesce("_m.president", F.lit("Unknown")).alias("president"),
        F.coalesce("_m.date", F.lit("")).alias("date"),
        F.coalesce("_m.eo_number", F.lit("")).alias("eo_number"),
    )
