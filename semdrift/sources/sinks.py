"""Writers of stage tables and exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.sources.landed import CSV_OPTIONS


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def write_csv(df: DataFrame, path: str) -> bool:
    """CSV with header; nothing is written for an empty table."""
    if df.isEmpty():
        return False
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}
    df.write.mode("overwrite").options(**options).csv(path)
    return True


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet stage table, optionally in one folder per value of ``by`` (years, clusters)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_document_files(documents: DataFrame, path: str) -> None:
    """One text file per document in one folder, each ended with a line feed; what was in the folder is replaced.

    Tasks write and move the files through Arrow's file systems. A task that
    runs again writes to another work folder; only files of the attempt that counts are moved into place.
    """
    store, root = pfs.FileSystem.from_uri(path)
    if store.get_file_info(root).type != pfs.FileType.NotFound:
        store.delete_dir(root)
    store.create_dir(root, recursive=True)
    work = f"{root}/_work-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pfs.FileSystem.from_uri(path)
        name, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0
        store.create_dir(f"{work}/{name}", recursive=True)
        for b in batches:
            for text in b.column(0):
                with store.open_output_stream(f"{work}/{name}/{n:09d}.txt") as out:
                    out.write((text.as_py() or b"") + b"\n")
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pfs.FileSystem.from_uri(path)
        for b in batches:
            for row in b.to_pylist():
                for k in range(row["n"]):
                    to = f"{root}/{row['name']}-{k:09d}.txt"
                    try:
                        store.move(f"{work}/{row['name']}/{k:09d}.txt", to)
                    except OSError:  # moved by an earlier attempt
                        if store.get_file_info(to).type != pfs.FileType.File:
                            raise
            yield b

    spark = documents.sparkSession
    done = documents.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(write, "name string, n long").collect()
    if done:  # a row per task
        found = spark.createDataFrame([(r["name"], r["n"]) for r in done], "name string, n long").repartition(len(done))
        found.mapInArrow(move, "name string, n long").count()
        store.delete_dir(work)
    with store.open_output_stream(f"{root}/_SUCCESS"):
        pass


def write_keyed_documents(documents: DataFrame, path: str) -> None:
    """One text file per document below ``filename=…`` folders."""
    documents.select("filename", F.col("text").alias("value")).write.mode("overwrite").partitionBy("filename").text(path)


def write_packed_documents(documents: DataFrame, path: str) -> None:
    """(filename, text) as JSON lines, many documents to a file."""
    documents.select("filename", "text").write.mode("overwrite").json(path)


def export(df: DataFrame, folder: str, name: str, stamp: str) -> dict[str, str]:
    """CSV and JSON records under a stamped name."""
    base = f"{folder.rstrip('/')}/{name}_{stamp}"
    write_csv(df, f"{base}.csv")
    df.write.mode("overwrite").json(f"{base}.json")
    return {"csv": f"{base}.csv", "json": f"{base}.json"}


def export_lines(lines: DataFrame, path: str) -> None:
    """A report's ordered lines as one text file; reports hold a line per group, not per row."""
    lines.orderBy("seq").select("line").coalesce(1).write.mode("overwrite").text(path)


def read_json_records(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).json(path)


def read_csv_records(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).options(**CSV_OPTIONS).csv(path)
