"""Cleaning and statistics against Python's own regular expressions, and the classic cases."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semdrift.config import CleanSettings
from semdrift.functions import text as X
from semdrift.operators import clean

PIECES = ["Executive Order 13769", "executive  ORDER\n12", "1/27/2017", "2024-01-01", "[82 FR 8977]", "[a\nb]", "[ x\rb ]",
          "https://example.org/x?y=1", "http://a b", "Café", "naïve", " ", "\t", " ", "\x1c", "the", "shall", "don't", "İ", "K",
          "٣/٤/٢٠١٧", "ſection", "Ünited", ".", "!", "?", "Mr.", "rhythm", "sky", "a", "policy", "[", "]", "-", "\x85"]


def by_python(text: str) -> str:
    for pattern, flags in ((r"executive\s+order\s+\d+", re.I), (r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", 0),
                           (r"\[\s*.*?\s*\]", 0), (r"https?://\S+", 0)):
        text = re.sub(pattern, " ", text, flags=flags)
    text = re.sub(r"[^a-z\s]", " ", text.lower())
    return re.sub(r"\s+", " ", text).strip()


def apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r["out"] for r in rows.select("id", column(F.col("text")).alias("out")).orderBy("id").collect()]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), min_size=40, max_size=60))
def test_normalise_equals_python(spark, texts):
    values = [sep.join(t) for t, sep in zip(texts, ["", " ", "  "] * 20)]
    assert apply(spark, values, X.normalise) == [by_python(v) for v in values]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), min_size=40, max_size=60))
def test_word_counts_equal_python(spark, texts):
    values = [" ".join(t) for t in texts]
    got = apply(spark, values, lambda c: X.word_count(X.collapse_space(c)))
    assert got == [len(v.split()) for v in values]


def test_syllables_per_word(spark):
    values = ["rhythm and blues", "tsk tsk", "", "Queue!", "a b c", "x\x01y sky"]
    got = apply(spark, values, lambda c: X.syllable_count(X.mark_vowels(X.collapse_space(c))))
    want = [sum(max(1, len(re.findall("[aeiouy]+", w.lower()))) for w in v.split()) for v in values]
    assert got == want


def run(spark, text, **kw):
    docs = spark.createDataFrame([("d", text)], "filename string, text string")
    return clean.clean_and_measure(docs, "filename", CleanSettings(**kw)).head()


def test_basic_case(spark):
    row = run(spark, "EXECUTIVE ORDER 13769 — Protecting the Nation From Foreign Terrorist Entry")
    assert "13769" not in row["text"] and row["text"] == row["text"].lower()
    assert row["text"] == "protecting nation foreign terrorist entry"
    assert row["original_words"] == 11 and row["processed_words"] == 5


def test_stopwords_case(spark):
    words = run(spark, "The president shall hereby order that the policy is effective")["text"].split()
    assert words == ["president", "policy", "effective"]


def test_empty_case(spark):
    row = run(spark, "")
    assert row["text"] == "" and row["original_words"] == 0 and row["compression_ratio"] == 0.0
    assert row["flesch_reading_ease"] == pytest.approx(206.835)


def test_sentence_case(spark):
    row = run(spark, "This is a test sentence. This is another sentence.")
    assert row["sentence_count"] == 2 and row["flesch_reading_ease"] > 0


def test_caps_are_optional(spark):
    text = "policy " * 3000
    assert len(run(spark, text)["text"]) == 7 * 3000 - 1
    capped = clean.clean_and_measure(
        spark.createDataFrame([("d", text)], "filename string, text string"), "filename",
        CleanSettings().capped(), spark.createDataFrame([("x", "y")], "form string, lemma string")).head()
    assert len(capped["text"]) == 5000 and capped["processed_words"] == 1429


def test_lemmas_shipped_and_joined_agree(spark):
    docs = spark.createDataFrame([(1, "orders order was policies"), (2, ""), (3, "orders " * 50 + "end")], "id int, text string")
    lemmas = spark.createDataFrame([("orders", "order"), ("was", "be"), ("policies", "policy")], "form string, lemma string")
    shipped = clean.lemmatise(docs, lemmas, "id").orderBy("id").collect()
    joined = clean._lemmatise_by_join(docs, lemmas, "id", "text").orderBy("id").collect()
    assert shipped == joined and shipped[0]["text"] == "order order be policy"


def test_rejects(spark):
    docs = spark.createDataFrame([("a", "fine"), ("b", None), (None, "x"), ("c", "bad �")], "filename string, text string")
    good, bad = clean.split_rejects(docs, "filename")
    assert [r["filename"] for r in good.collect()] == ["a"]
    assert {(r["filename"], r["reason"]) for r in bad.collect()} == {("b", "no text"), (None, "no key"), ("c", "undecodable text")}


def test_stopwords_are_sparks_english_list_and_the_domain_words(spark):
    from pyspark.ml.feature import StopWordsRemover

    from semdrift.functions.stopwords import DEFAULT, DOMAIN, ENGLISH

    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")
    assert len(DOMAIN) == 15 and set(DEFAULT) == {*ENGLISH, *DOMAIN}
