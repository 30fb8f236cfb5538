"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir), calls one operator of
``semdrift.llm`` and returns a table that the next stage reads. All stages but
the last return the columns of ``documents`` (and any others that came in).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semdrift.llm import decontaminate, lines, packing, quality, simhash
from semdrift.llm.common import crc_mod, fresh, read_table
from semdrift.session import write_and_read

#: The quality classifier and the packing have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Learned from the labels that ``op6_quality`` learns from."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return quality.good_documents(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; ``n_chars``, where there is one, follows the text."""
    cleaned = lines.drop_boilerplate(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for every row, written once so that a task that runs again has the same ones."""
    row = fresh(docs, "row")
    return write_and_read(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: the one with the smallest id, of equal ids or none the first.

    Rows are told apart by numbers of their own: rows that share an id but not
    their text all stay, and rows without id have near copies like any other.
    """
    rows, row = _numbered(docs, "near-rows")
    classes = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    named = classes.select(F.col("doc_id").alias("nth"), F.col("component_id").alias("group")).join(
        rows.select(F.col(row).alias("nth"), F.col("doc_id").alias("id")), "nth")
    firsts = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "nth")).alias("first"))
    return rows.join(firsts.select(F.col("first.nth").alias(row)), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a benchmark window occurs, whatever their id, and no others."""
    rows, row = _numbered(docs, "checked-rows")
    checked = decontaminate.contamination(rows.select(F.col(row).alias("doc_id"), "text"), read_table(spark, sf_dir, "benchmark"))
    # Contaminated rows are those that quote the benchmark.
    hit = write_and_read(checked.filter("contaminated").select(F.col("doc_id").alias(row)), "contaminated")
    return rows.join(hit, row, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece of a document."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_and_read(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
