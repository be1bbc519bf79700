"""Session set-up, the shared folder and lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that are worked on at once, and rows of an Arrow batch: what a task holds of whole texts stays small.
SLICE = 1000
#: Input of a task that gathers what its rows hold, by Spark's own estimate.
GATHERED_BYTES = 8 << 20


def get_spark(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # long texts: bound the bytes, not only the rows, handed to a Python worker at once
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        # vector means: keep the running means of all days of a task in memory
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    }
    if master and master.startswith("local"):
        settings.update(
            {
                "spark.driver.host": "127.0.0.1",
                "spark.ui.enabled": "false",
                "spark.sql.shuffle.partitions": "8",
                "spark.driver.memory": "8g",
            }
        )
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster
    an unset folder is an error, since a lost executor would lose the data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidewire-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so it can be expired as one."""
    return f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the cluster has cores, or than one per ``most`` bytes; else as is.

    For heavy work per row on few files. With ``most``, what a task gathers from its rows (words of texts, say) stays the
    same size, however large the table and its splits. Pass a plain scan: the number of its splits and its size are
    known without a job.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if most is not None:
        parts = max(parts, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // most))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, *keys)


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``SLICE`` rows at most: they lie in the memory of the executor and of the Python
    worker at once."""
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(most, "10000")) <= SLICE:
        spark.conf.set(most, str(SLICE))


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and what it holds counts against the next task."""
    pa.default_memory_pool().release_unused()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own books
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Use it where one expensive frame feeds several later branches: the text is
    then cleaned once, and a lost executor re-reads the table instead of
    repeating the work.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where the package is not installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidewire-ship-")) / "tidewire"
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _shipped.add(context.applicationId)
