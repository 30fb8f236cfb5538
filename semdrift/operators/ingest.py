"""From landed listing records and pages to keyed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semdrift.functions import html as H
from semdrift.functions.names import document_key
from semdrift.operators.skew import latest_per_key, lookup_join, number_rows

# What stands in for absent fields and contents.
DEFAULTS = {
    "executive_order_number": "NA",
    "title": "Untitled",
    "publication_date": "",
    "president": "Unknown",
    "html_url": "",
    "pdf_url": "",
}
PDF_ONLY = "PDF_CONTENT_NOT_EXTRACTED"
NO_CONTENT = "CONTENT_NOT_AVAILABLE"


def in_years(date: Column, start_year: int, end_year: int) -> Column:
    """Inclusive range predicate that reaches the scan; works on dates and ISO texts."""
    return date.between(F.lit(f"{start_year}-01-01"), F.lit(f"{end_year}-12-31"))


def select_orders(
    listing: DataFrame, start_year: int, end_year: int, kind: str | None = None, kind_col: str = "type"
) -> DataFrame:
    chosen = listing.filter(in_years(F.col("publication_date"), start_year, end_year))
    return chosen if kind is None else chosen.filter(F.col(kind_col) == kind)


def paged(listing: DataFrame, per_page: int, date: str = "publication_date", tie: str = "executive_order_number"):
    """Newest first, with the 1-based page of every record."""
    numbered = number_rows(listing, [F.col(date).desc(), F.col(tie).asc()], "position")
    return numbered.withColumn("page", F.ceil(F.col("position") / per_page).cast("bigint"))


def page(listing: DataFrame, number: int, per_page: int, date: str = "publication_date",
         tie: str = "executive_order_number") -> DataFrame:
    """One page of the listing."""
    ordered = listing.orderBy(F.col(date).desc(), F.col(tie).asc())
    return ordered.offset((number - 1) * per_page).limit(per_page)


def normalise_records(listing: DataFrame) -> DataFrame:
    """Defaults for absent or null fields, and the document key."""
    filled = listing.select(
        *[F.coalesce(F.col(name), F.lit(default)).alias(name) for name, default in DEFAULTS.items()],
        *[c for c in listing.columns if c not in DEFAULTS],
    )
    return filled.withColumnsRenamed({"executive_order_number": "eo_number", "publication_date": "date"}).withColumn(
        "filename", document_key(F.col("eo_number"), F.col("date"), F.col("title"))
    )


def page_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, text, error); a page that fails has no text, and the job goes on."""
    return pages.select(url, H.page_text_by_walk(F.col(html)).alias("_w")).select(url, "_w.text", "_w.error")


def resolve_content(records: DataFrame, texts: DataFrame, spread: str = "filename") -> DataFrame:
    """Page text; else the marker of a PDF-only record; else the marker of a missing one.

    One landed copy per url is used, the greatest text when copies differ.
    """
    landed = texts.groupBy(F.col("url").alias("html_url")).agg(F.max("text").alias("_text"))
    landed = landed.filter(F.col("html_url") != "")
    joined = lookup_join(records, landed, "html_url", spread)
    return joined.withColumn(
        "text",
        F.coalesce(F.col("_text"), F.when(F.col("pdf_url") != "", F.lit(PDF_ONLY)), F.lit(NO_CONTENT)),
    ).drop("_text")


def last_write_wins(documents: DataFrame, order: list[str], key: str = "filename") -> DataFrame:
    return latest_per_key(documents, key, order)
