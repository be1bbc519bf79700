"""Publishing a table whole: staged files, a manifest with row counts, and a switch as the last step.

A target holds ``data/<version>/`` with Parquet files and ``manifests/<version>.json``. A version counts from the moment its
manifest has its final name, which is one rename; until then readers see the version before. A job that dies half way leaves
files that no manifest names. Whether a table is broken is decided by its manifest alone: a file that is missing, or
has another length or row count. An error while reading, such as denied access, is an error and never a reason to overwrite.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MISSING, UNFINISHED, COMPLETE, BROKEN = "missing", "unfinished", "complete", "broken"


class Store:
    """The few file operations needed, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names and lengths of what lies in a folder; nothing if it is missing. Other errors are raised."""
        where = self.path(folder)
        if not self.fs.exists(where):
            return []
        return [(f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(where)]

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file; an existing one is an error."""
        stream = self.fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self.path(old), self.path(new))

    def delete(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Manifest:
    """One version: its folder, its schema, and length and rows of each file."""

    version: str
    schema: str
    files: dict[str, tuple[int, int]]

    @property
    def rows(self) -> int:
        return sum(rows for _, rows in self.files.values())

    def text(self) -> str:
        listed = {name: {"bytes": size, "rows": rows} for name, (size, rows) in sorted(self.files.items())}
        return json.dumps({"version": self.version, "schema": json.loads(self.schema), "files": listed})

    @staticmethod
    def parse(text: str) -> Manifest:
        found = json.loads(text)
        files = {name: (x["bytes"], x["rows"]) for name, x in found["files"].items()}
        return Manifest(found["version"], json.dumps(found["schema"]), files)


def manifest(spark: SparkSession, target: str) -> Manifest | None:
    """The newest version, or None if none was finished."""
    if any(c in target for c in "*?[{"):
        return None
    store = Store(spark, target)
    names = sorted(n for n, _ in store.names(f"{target}/manifests") if n.endswith(".json") and not n.startswith("_"))
    return Manifest.parse(store.read(f"{target}/manifests/{names[-1]}")) if names else None


def _rows_per_file(spark: SparkSession, folder: str, schema) -> dict[str, int]:
    """From the files' footers, in one distributed job."""
    counts = spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_name").alias("name")).count()
    return {r["name"]: r["count"] for r in counts.collect()}  # one small row per file


def publish(df: DataFrame, target: str, partitions: tuple[str, ...] = ()) -> Manifest:
    """Write ``df`` as the target's new version and switch to it. Files of other versions stay; see ``sweep``."""
    spark = df.sparkSession
    store = Store(spark, target)
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    folder = f"{target}/data/{version}"
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(folder)
    schema = df.schema
    listed = _below(store, folder)
    counts = _rows_per_file(spark, folder, schema)
    made = Manifest(version, schema.json(), {n: (size, counts.get(n.rsplit("/", 1)[-1], 0)) for n, size in listed})
    draft = f"{target}/manifests/_{version}.json"
    store.write(draft, made.text())
    if not store.rename(draft, f"{target}/manifests/{version}.json"):
        raise OSError(f"{target}: the switch to version {version} failed")
    return made


def _below(store: Store, folder: str, inner: str = "") -> list[tuple[str, int]]:
    """Data files of a partitioned folder, by their path in it."""
    out = []
    for status in store.fs.listStatus(store.path(f"{folder}/{inner}")):
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        out += _below(store, folder, f"{inner}{name}/") if status.isDirectory() else [(f"{inner}{name}", status.getLen())]
    return out


def state(spark: SparkSession, target: str, count_rows: bool = True) -> str:
    """``missing``, ``unfinished`` (files, but no version was finished), ``complete`` or ``broken`` (not what its manifest says).

    Row counts are compared from footers; a file whose footer cannot be read is broken too, any other error is raised.
    """
    store = Store(spark, target)
    found = manifest(spark, target)
    if found is None:
        return UNFINISHED if store.names(f"{target}/data") or store.names(target) else MISSING
    folder = f"{target}/data/{found.version}"
    there = dict(_below(store, folder)) if store.names(folder) else {}
    if any(there.get(name) != size for name, (size, _) in found.files.items()):
        return BROKEN
    if count_rows and found.files:
        try:
            counts = _rows_per_file(spark, folder, _schema(found))
        except Exception as error:  # only a broken file is an answer
            if _is_format_error(error):
                return BROKEN
            raise
        if any(counts.get(name.rsplit("/", 1)[-1], 0) != rows for name, (_, rows) in found.files.items()):
            return BROKEN
    return COMPLETE


def _schema(found: Manifest) -> StructType:
    return StructType.fromJson(json.loads(found.schema))


def _is_format_error(error: Exception) -> bool:
    text = " ".join(str(x) for x in (error, getattr(error, "java_exception", ""), getattr(error, "_stackTrace", ""), getattr(error, "_cause", "")))
    return any(mark in text for mark in ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "Could not read footer", "FAILED_READ_FILE.PARQUET", "corrupt"))


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """The newest finished version; files that no manifest names are not read."""
    found = manifest(spark, target)
    if found is None:
        raise FileNotFoundError(f"{target}: no finished version")
    folder = f"{target}/data/{found.version}"
    if not found.files:
        return spark.createDataFrame([], _schema(found))
    return spark.read.schema(_schema(found)).parquet(folder)


def sweep(spark: SparkSession, target: str) -> int:
    """Delete the data of versions that were never finished and of older ones; returns how many. Not while a job publishes."""
    store = Store(spark, target)
    found = manifest(spark, target)
    gone = 0
    for name, _ in store.names(f"{target}/data"):
        if found is None or name != found.version:
            gone += store.delete(f"{target}/data/{name}")
    for name, _ in store.names(f"{target}/manifests"):
        if found is None or name != f"{found.version}.json":
            store.delete(f"{target}/manifests/{name}")
    return gone
