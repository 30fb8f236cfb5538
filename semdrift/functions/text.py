"""Cleaning and text statistics as column expressions.

Character classes are spelled out so that they mean the same in every regex
dialect: white space, decimal digits and letters are Unicode-wide.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
SPACE = f"[{WS}]"
NON_SPACE = f"[^{WS}]"
DIGIT = r"\p{Nd}"

ORDER_NO = rf"(?i)executive{SPACE}+order{SPACE}+{DIGIT}+"
NUMERIC_DATE = rf"{DIGIT}{{1,2}}[/-]{DIGIT}{{1,2}}[/-]{DIGIT}{{2,4}}"
CITATION = rf"\[{SPACE}*[^\n]*?{SPACE}*\]"
URL = f"https?://{NON_SPACE}+"
NON_ALPHA = f"[^a-z{WS}]"
SENTENCE_END = rf"[.!?]+(?:{SPACE}+|\z)"

def remove_order_number(text: Column) -> Column:
    return F.regexp_replace(text, ORDER_NO, " ")


def remove_numeric_dates(text: Column) -> Column:
    return F.regexp_replace(text, NUMERIC_DATE, " ")


def remove_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def remove_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def keep_letters(text: Column) -> Column:
    return F.regexp_replace(text, NON_ALPHA, " ")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalise(text: Column) -> Column:
    """Lower-case words of a-z joined by one space, without order numbers, dates, citations, URLs.

    Replacing other characters and collapsing white space is one pattern here:
    whatever is not a-z ends up as a single space.
    """
    for step in (remove_order_number, remove_numeric_dates, remove_citations, remove_urls):
        text = step(text)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def tokens(text: Column) -> Column:
    """Words of a text whose white space is already collapsed; no token for the empty text."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def keep_long(words: Column, min_length: int) -> Column:
    return F.filter(words, lambda t: F.length(t) >= min_length)


def drop_stopwords(words: Column, stopwords: Iterable[str]) -> Column:
    listed = list(stopwords)  # becomes one hash set inside the lambda
    return F.filter(words, lambda t: ~t.isin(listed))


def content_words(text: Column, min_length: int, stopwords: Sequence[str]) -> Column:
    listed = list(stopwords)
    return F.filter(F.split(text, " "), lambda t: (F.length(t) >= min_length) & ~t.isin(listed))


def truncate(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


# Counts of a text whose white space is collapsed. Lengths before and after a
# replacement count its matches without building them.
MARK = "\x01"


def _occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def word_count(collapsed: Column) -> Column:
    return F.when(collapsed != "", _occurrences(collapsed, " ") + 1).otherwise(F.when(collapsed == "", F.lit(0)))


def sentence_count(collapsed: Column) -> Column:
    return F.size(F.filter(F.split(collapsed, r"[.!?]+(?: |\z)"), lambda s: s != ""))


def mark_vowels(collapsed: Column) -> Column:
    """Every vowel group becomes one mark."""
    return F.regexp_replace(F.lower(F.replace(collapsed, F.lit(MARK), F.lit("#"))), "[aeiouy]+", MARK)


def syllable_count(marked: Column) -> Column:
    """Vowel groups, and one for every word without a vowel."""
    bare = F.regexp_count(marked, F.lit(f"(?<![^ ])[^{MARK} ]++(?![^ ])"))
    return _occurrences(marked, MARK) + bare


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def compression_ratio(processed_words: Column, original_words: Column) -> Column:
    return _ratio(processed_words, original_words)


def avg_word_length(words: Column) -> Column:
    letters = F.length(F.array_join(words, ""))
    return _ratio(letters, F.size(words))


def reading_ease(words: Column, sentences: Column, syllables: Column) -> Column:
    return 206.835 - 1.015 * _ratio(words, sentences) - 84.6 * _ratio(syllables, words)


def grade_level(words: Column, sentences: Column, syllables: Column) -> Column:
    return 0.39 * _ratio(words, sentences) + 11.8 * _ratio(syllables, words) - 15.59


def unique_words(words: Column) -> Column:
    return F.size(F.array_distinct(words))
