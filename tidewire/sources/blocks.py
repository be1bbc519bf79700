"""Files read block by block in tasks, whatever their size."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.naming import file_name

BLOCK = 8 << 20
#: Stores that a task can open by itself.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs")
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
#: Bytes up to which Spark reads a file of any other store as one cell of a task; longer ones pass the driver as a stream.
WHOLE = 64 << 20


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``length`` of the files below a folder that are not empty; no content is read."""
    return _found(spark, path, pattern).select("path", "length")


def _found(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def empty_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path`` and ``length`` of the empty files below a folder, which Spark lists and does not read."""
    names = [unquote(uri).replace(":///", ":/", 1) for uri in _found(spark, path, pattern).inputFiles()]
    every = spark.createDataFrame([(n,) for n in names], "path string")
    return every.join(list_files(spark, path, pattern), "path", "left_anti").withColumn("length", F.lit(0).cast("bigint"))


def dealt_by_size(files: DataFrame, tasks: int) -> DataFrame:
    """Files spread over ``tasks`` so that each gets as many of every size class as any other: large ones do not meet."""
    size_class = F.floor(F.log2(F.col("length") + 1))
    turn = F.row_number().over(Window.partitionBy(size_class).orderBy("path")) - 1
    # classes take turns from different tasks on, as most of them have few files
    placed = files.withColumn("_task", F.pmod(turn + size_class * 7, F.lit(tasks)))
    return placed.repartitionByRange(tasks, "_task").drop("_task")


def _open(name: str):
    """The stream of a file by its name as Spark gives it, in which nothing is escaped."""
    scheme, path = ("", name) if name.startswith("/") else name.split(":", 1)
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_stream("/" + path.lstrip("/"))
    system, path = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{quote(path, safe='/:@')}")
    return system.open_input_stream(path)


def digest_of(stream, block: int = BLOCK) -> tuple[str, int]:
    """SHA-256 and length of a stream; one block is held at a time."""
    state, size = hashlib.sha256(), 0
    while data := stream.read(block):
        state.update(data)
        size += len(data)
    return state.hexdigest(), size


def file_digests(spark: SparkSession, path: str, pattern: str = "*", tasks: int | None = None, block: int = BLOCK) -> DataFrame:
    """``file_name``, ``length``, ``sha256`` of each file below ``path``, in tasks that hold one block at a time.

    A store that only Spark opens is read by Spark: files of up to ``WHOLE`` bytes in tasks, longer ones by the driver.
    """
    files = list_files(spark, path, pattern)
    scheme = F.regexp_extract("path", SCHEME, 1)
    own = dealt_by_size(files.where(scheme.isin(*OPENED)), tasks or spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with _open(uri) as stream:
                    sha, size = digest_of(stream, block)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([sha])], ["path", "length", "sha256"])

    read = own.select("path").mapInArrow(run, "path string, length bigint, sha256 string")
    empty = empty_files(spark, path, pattern).withColumn("sha256", F.lit(hashlib.sha256().hexdigest()))
    digests = read.unionByName(empty)
    # a scan for content reads each file of these lengths, whatever its path
    if any((re.findall(SCHEME, uri) or [""])[0] not in OPENED for uri in _found(spark, path, pattern).inputFiles()):
        other, small = ~scheme.isin(*OPENED), F.col("length") <= WHOLE
        whole = _found(spark, path, pattern).where(small).where(other)
        digests = digests.unionByName(whole.select("path", "length", F.sha2("content", 256).alias("sha256")))
        large = [(r.path, r.length, _streamed(spark, r.path)) for r in files.where(other & ~small).collect()]
        digests = digests.unionByName(spark.createDataFrame(large, "path string, length bigint, sha256 string"))
    return digests.select(file_name("path").alias("file_name"), "length", "sha256")


def _streamed(spark: SparkSession, name: str) -> str:
    """SHA-256 of a file that the driver's JVM reads as a stream."""
    where = spark._jvm.org.apache.hadoop.fs.Path(name)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
