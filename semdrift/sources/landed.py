"""Readers with explicit schemas."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "executive_order_number STRING, title STRING, publication_date STRING, "
    "president STRING, html_url STRING, pdf_url STRING"
)
LISTING = f"results ARRAY<STRUCT<{RECORD.replace(' STRING', ': STRING')}>>"
RAW_METADATA = (
    "eo_number STRING, president STRING, date STRING, title STRING, "
    "filename STRING, html_url STRING, pdf_url STRING"
)
STATS = (
    "filename STRING, original_words INT, processed_words INT, compression_ratio DOUBLE, "
    "sentence_count INT, avg_word_length DOUBLE, flesch_reading_ease DOUBLE, "
    "flesch_kincaid_grade DOUBLE, unique_words INT, president STRING, date STRING, eo_number STRING"
)
EMBEDDINGS = "filename STRING, content_md5 STRING, embedding ARRAY<FLOAT>"
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}


def read_listing(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per element of ``results``; an empty page gives none."""
    pages = spark.read.schema(LISTING).option("multiLine", multiline).json(path)
    return pages.select(F.explode("results").alias("r")).select("r.*")


#: Texts that a task hands on at a time: files and bytes.
FILES_HELD, BYTES_HELD = 1024, 4 << 20
#: Tasks that read files, for each that runs at a time.
READERS = 4


def _arrow_folder(spark: SparkSession, path: str) -> tuple[pfs.FileSystem, str] | None:
    """The store and the folder that ``path`` names, if Arrow opens what Spark would."""
    if "://" not in path and not path.startswith("file:") and not (spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        return None
    try:
        store, root = pfs.FileSystem.from_uri(path)
        return (store, root) if store.get_file_info(root).type == pfs.FileType.Directory else None
    except (OSError, pa.ArrowException):
        return None


def _as_spark(name: str) -> str:
    """The name as Spark's file metadata spell it, as part of a URI."""
    return re.sub(r"[^\w!.~'()*:@&=+$,;-]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), name)


def _seen(name: str) -> bool:
    """Whether Spark's readers see a file of this name, and it is a text."""
    return name.endswith(".txt") and not name.startswith(".") and (not name.startswith("_") or "=" in name)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): one row per text file of a folder.

    One task lists the folder and hands the names on as it goes, others read the files: Spark's own
    readers keep an entry for each file on the driver. They are used for paths that Arrow's file systems do not open as a folder.
    """
    if _arrow_folder(spark, path) is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
        return files.select(F.col("_metadata.file_name").alias("filename"), F.col("content").cast("string").alias("text"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pfs.FileSystem.from_uri(path)
        for b in batches:
            if not b.num_rows:
                continue
            if isinstance(store, pfs.LocalFileSystem):
                found = (e.name for e in os.scandir(root) if _seen(e.name) and e.is_file())
            else:
                found = (i.base_name for i in store.get_file_info(pfs.FileSelector(root)) if _seen(i.base_name) and i.type == pfs.FileType.File)
            while some := list(islice(found, 1 << 14)):
                yield pa.RecordBatch.from_pydict({"filename": pa.array(some, pa.string())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pfs.FileSystem.from_uri(path)
        held, size = [], 0
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as file:
                    text = file.read()
                if not text:  # nor do Spark's readers see empty files
                    continue
                held.append((_as_spark(name), text))
                size += len(text)
                if len(held) >= FILES_HELD or size >= BYTES_HELD:
                    yield _files(held)
                    held, size = [], 0
        if held:
            yield _files(held)

    listed = spark.range(1).repartition(1).mapInArrow(names, "filename string")
    dealt = listed.repartition(READERS * spark.sparkContext.defaultParallelism, "filename")
    return dealt.mapInArrow(texts, "filename string, content binary").select("filename", F.col("content").cast("string").alias("text"))


def _files(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"filename": pa.array([n for n, _ in held], pa.string()), "content": pa.array([t for _, t in held], pa.binary())})


def read_keyed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): files below ``filename=…`` folders, the layout Spark writes."""
    files = spark.read.schema("value STRING, filename STRING").text(path, wholetext=True)
    return files.select("filename", F.regexp_replace("value", r"\n\z", "").alias("text"))


def read_packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text): a document per JSON line."""
    return spark.read.schema("filename STRING, text STRING").json(path)


def read_raw_metadata(spark: SparkSession, path: str) -> DataFrame:
    """All columns stay text, so numbers keep their form; an empty field is an empty text."""
    return spark.read.schema(RAW_METADATA).options(**CSV_OPTIONS).csv(path).fillna("")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors and their keys; a missing table is an error."""
    return spark.read.schema(EMBEDDINGS).parquet(path)


def read_training_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """(dataset, line): gzip files cannot be split, so lines are spread after the read."""
    lines = spark.read.text(path)
    named = lines.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*\z", 1).alias("folder"),
        F.col("_metadata.file_name").alias("file"),
        F.col("value").alias("line"),
    )
    return named if partitions is None else named.repartition(partitions)
