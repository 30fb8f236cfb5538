"""Stage tables that are committed whole: folders of rows, and a small file that says which of them count.

Every write goes to a folder of its own. A stage's state is a manifest, one JSON file of a new
number, written beside its place and moved there by one rename; readers take the highest
number, so a run that is killed in between leaves the former table as it was. A manifest names what the
table was made from; a stage whose inputs and settings are the same is not run again,
and as the manifest holds the schema too, finding that out starts no job.

A keyed table grows by its changes: a version adds a folder with new and changed
rows and one with the keys that rows of earlier folders no longer stand for.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a keyed table that are read together before they are written as one.
MOST_PARTS = 8


def digest(*parts: object) -> str:
    return hashlib.md5("|".join(repr(p) for p in parts).encode()).hexdigest()


def _files(spark: SparkSession, path: str):
    """(file system, path) of the store that holds ``path``."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def fingerprint(df: DataFrame) -> str | None:
    """A name for what ``df`` reads and does, from its plan and the listing of its files; None where it reads none.

    No job is started: each folder is listed once.
    """
    spark, paths = df.sparkSession, sorted(df.inputFiles())
    if not paths:
        return None
    seen = []
    for folder in sorted({p.rsplit("/", 1)[0] for p in paths}):
        store, place = _files(spark, folder)
        for status in store.listStatus(place):
            seen.append((status.getPath().toUri().getPath(), status.getLen(), status.getModificationTime()))
    read = {spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in paths}
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return digest(plan, sorted(s for s in seen if s[0] in read))


@dataclass(frozen=True)
class Manifest:
    """One version of a stage table."""

    version: int
    made_from: str
    settings: str
    schema: str
    key: str | None = None
    parts: list[dict[str, str | None]] = field(default_factory=list)  # rows; gone: keys that earlier rows no longer stand for

    @property
    def name(self) -> str:
        """Changes with the content; what later stages are made from."""
        return digest(self.parts)


class Store:
    """The stage tables below one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self, stage: str) -> Manifest | None:
        store, place = _files(self.spark, f"{self.root}/{stage}/manifests")
        if not store.exists(place):
            return None
        names = [s.getPath().getName() for s in store.listStatus(place)]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        stream = store.open(self.spark._jvm.org.apache.hadoop.fs.Path(place, f"{max(numbers)}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, stage: str) -> DataFrame | None:
        """The table as last committed, or None where there is none."""
        found = self.manifest(stage)
        return None if found is None else self._table(found)

    def _table(self, manifest: Manifest) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema))
        read = self.spark.read.schema(schema)
        whole, gone = None, None
        for part in reversed(manifest.parts):
            rows = read.parquet(part["rows"])
            if gone is not None:
                rows = rows.join(gone, manifest.key, "left_anti")
            whole = rows if whole is None else rows.unionByName(whole)
            if part["gone"]:
                keys = self.spark.read.schema(T.StructType([schema[manifest.key]])).parquet(part["gone"])
                gone = keys if gone is None else gone.unionByName(keys)
        return whole

    def commit(self, stage: str, manifest: Manifest) -> None:
        folder = f"{self.root}/{stage}/manifests"
        store, place = _files(self.spark, f"{folder}/{manifest.version}.{uuid.uuid4().hex}.next")
        stream = store.create(place)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{manifest.version}.json")
        if store.exists(target) or not store.rename(place, target):
            raise RuntimeError(f"another run committed version {manifest.version} of {stage}")

    def _folder(self, stage: str, kind: str) -> str:
        return f"{self.root}/{stage}/{kind}-{uuid.uuid4().hex}"

    def derived(self, stage: str, made_from: str, build: Callable[[], DataFrame], settings: str = "") -> DataFrame:
        """The stored table where it was made from this, or the one that ``build`` gives, stored."""
        found = self.manifest(stage)
        if found is None or (found.made_from, found.settings) != (made_from, settings):
            found = self._whole(stage, found, made_from, settings, build(), None)
        return self._table(found)

    def _whole(self, stage: str, before: Manifest | None, made_from: str, settings: str, rows: DataFrame, key: str | None) -> Manifest:
        folder = self._folder(stage, "rows")
        rows.write.parquet(folder)
        version = 1 if before is None else before.version + 1
        manifest = Manifest(version, made_from, settings, _open(rows.schema).json(), key, [{"rows": folder, "gone": None}])
        self.commit(stage, manifest)
        return manifest

    def append(
        self, stage: str, made_from: str, rows: DataFrame, gone: DataFrame | None = None, key: str | None = None,
        merge: Callable[[DataFrame], DataFrame] = lambda table: table,
    ) -> None:
        """Commit ``rows`` as one more folder, and ``gone`` as keys that earlier folders no longer stand for.

        The step is named by ``made_from``: one that was committed last is not added again, so a caller that repeats a
        step after a failure does no harm. Many folders become one through ``merge``.
        """
        found = self.manifest(stage)
        if found is not None and found.made_from == made_from:
            return
        folders = {"rows": self._folder(stage, "rows"), "gone": None}
        rows.write.parquet(folders["rows"])
        if gone is not None:
            folders["gone"] = self._folder(stage, "gone")
            gone.write.parquet(folders["gone"])
        parts = [] if found is None else found.parts
        version, schema = (1, _open(rows.schema).json()) if found is None else (found.version + 1, found.schema)
        manifest = Manifest(version, made_from, "", schema, key, [*parts, folders])
        if len(manifest.parts) > MOST_PARTS:
            self._whole(stage, found, made_from, "", merge(self._table(manifest)), key)
        else:
            self.commit(stage, manifest)

    def keyed(
        self, stage: str, made_from: str, settings: str, current: Callable[[], DataFrame], key: str, version: str,
        make: Callable[[DataFrame], DataFrame],
    ) -> DataFrame:
        """A table with a row for each key, made by ``make`` from rows of ``current()`` (key, version, ...).

        Rows are made for keys that are new or whose ``version`` changed; with other ``settings`` all are. Rows of
        keys that are gone are left out.
        """
        found = self.manifest(stage)
        if found is not None and (found.made_from, found.settings) == (made_from, settings):
            return self._table(found)
        rows = current()
        if found is None or found.settings != settings:
            return self._table(self._whole(stage, found, made_from, settings, make(rows), key))
        before = self._table(found)
        todo = rows.join(before.select(key, version), [key, version], "left_anti")
        stale = before.select(key, version).join(rows.select(key, version), [key, version], "left_anti").select(key)
        folders = {"rows": self._folder(stage, "rows"), "gone": self._folder(stage, "gone")}
        stale.write.parquet(folders["gone"])
        make(todo).select(*before.columns).write.parquet(folders["rows"])
        manifest = Manifest(found.version + 1, made_from, settings, found.schema, key, [*found.parts, folders])
        if len(manifest.parts) > MOST_PARTS:
            return self._table(self._whole(stage, found, made_from, settings, self._table(manifest), key))
        self.commit(stage, manifest)
        return self._table(manifest)


def _open(schema: T.StructType) -> T.StructType:
    """The schema as a reader has it: every column may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
