"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "semdrift") -> SparkSession:
    """Session for tests and local benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, wherever the session was started."""
    sc = spark.sparkContext
    if getattr(sc, "_semdrift_shipped", False):
        return
    home = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="semdrift-")) / "semdrift.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(home.rglob("*.py")):
            out.write(source, source.relative_to(home.parent))
    sc.addPyFile(str(bundle))
    sc._semdrift_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can read.

    The folder named by ``spark.checkpoint.dir`` wins. Only a local master
    without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="semdrift-"))
    return sc.getCheckpointDir()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for the jobs of a block; those before come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Paths handed out inside each open ``scratch_tables`` block.
_open_blocks: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables written inside when the block ends; nothing that reads them may leave it."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for path in _open_blocks.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as a Parquet table: columnar, prunable, with size statistics."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
