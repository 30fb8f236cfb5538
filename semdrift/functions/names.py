"""Document keys and what can be read back from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semdrift.config import ERAS
from semdrift.functions.text import WS

UNSAFE = rf"[^\p{{L}}\p{{N}}_{WS}-]"
GAPS = f"[{WS}-]+"


def safe_name(title: Column, max_chars: int | None = None) -> Column:
    """Letters, digits and single underscores."""
    joined = F.regexp_replace(F.regexp_replace(title, UNSAFE, "_"), GAPS, "_")
    stripped = F.regexp_replace(joined, r"^_+|_+\z", "")
    return stripped if max_chars is None else F.substring(stripped, 1, max_chars)


def document_key(number: Column, date: Column, title: Column) -> Column:
    return F.concat(F.lit("EO_"), number, F.lit("_"), date, F.lit("_"), safe_name(title, 50), F.lit(".txt"))


def _key_parts(filename: Column) -> Column:
    bare = F.replace(F.replace(filename, F.lit("EO_"), F.lit("")), F.lit(".txt"), F.lit(""))
    return F.split(bare, "_")


def key_number(filename: Column) -> Column:
    return F.coalesce(F.get(_key_parts(filename), F.lit(0)), F.lit(""))


def key_date(filename: Column) -> Column:
    return F.coalesce(F.get(_key_parts(filename), F.lit(1)), F.lit(""))


def year_text(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4)).otherwise(F.lit("Unknown"))


def year_number(year: Column) -> Column:
    """Integer year, NULL where the text is no number."""
    return year.try_cast("int")


def era_of(year: Column) -> Column:
    """Era of a year text; only all-digit years have one."""
    number = F.when(year.rlike(r"^\p{Nd}+\z"), year.try_cast("int"))
    rule = F.lit(None).cast("string")
    for low, high, name in reversed(ERAS):
        rule = F.when(number.between(low, high), F.lit(name)).otherwise(rule)
    return F.coalesce(rule, F.lit("Unknown"))
