"""Published tables: lost files, jobs that stop half way, errors that must not overwrite; digests in blocks."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.sources import blocks, commit, files


def data_files(target):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(target) for n in names if n.endswith(".parquet") and not n.startswith("."))


def test_versions(spark, tmp_path):
    target = str(tmp_path / "t")
    assert commit.state(spark, target) == commit.MISSING
    with pytest.raises(FileNotFoundError):
        commit.read_published(spark, target)
    first = commit.publish(spark.range(100).repartition(4), target)
    assert first.rows == 100 and len(first.files) == 4 and commit.state(spark, target) == commit.COMPLETE
    held = commit.read_published(spark, target)
    commit.publish(spark.range(7), target)
    assert commit.read_published(spark, target).count() == 7 and held.count() == 100  # readers of the old version go on
    assert commit.sweep(spark, target) == 1 and commit.read_published(spark, target).count() == 7
    commit.publish(spark.range(6).withColumn("p", F.col("id") % 2), target, ("p",))
    assert commit.state(spark, target) == commit.COMPLETE and commit.read_published(spark, target).where("p = 1").count() == 3
    commit.publish(spark.range(0), target)
    assert commit.state(spark, target) == commit.COMPLETE and commit.read_published(spark, target).count() == 0


def test_a_job_stopped_half_way(spark, tmp_path):
    target = str(tmp_path / "t")
    spark.range(10).write.parquet(f"{target}/data/dead")  # no manifest names these
    assert commit.state(spark, target) == commit.UNFINISHED
    commit.publish(spark.range(3), target)
    spark.range(10).write.parquet(f"{target}/data/dead-too")
    commit.Store(spark, target).write(f"{target}/manifests/_draft.json", "{")  # died before the switch
    assert commit.state(spark, target) == commit.COMPLETE and commit.read_published(spark, target).count() == 3
    assert commit.sweep(spark, target) == 2 and commit.read_published(spark, target).count() == 3


@pytest.mark.parametrize("harm", ["lost", "shorter", "other rows"])
def test_broken_by_the_manifest(spark, tmp_path, harm):
    target = str(tmp_path / "t")
    commit.publish(spark.range(50).repartition(2), target)
    path = data_files(target)[0]
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    os.remove(crc)
    if harm == "lost":
        os.remove(path)
    elif harm == "shorter":
        with open(path, "wb") as f:
            f.write(b"PAR1")
    else:  # same length, no footer
        with open(path, "r+b") as f:
            f.seek(-4, os.SEEK_END)
            f.write(b"JUNK")
    assert commit.state(spark, target) == commit.BROKEN


def test_read_errors_do_not_overwrite(spark, tmp_path, monkeypatch):
    source, target = tmp_path / "n.csv", str(tmp_path / "t")
    source.write_text("Date,Article_title,Stock_symbol\n2020-01-01 00:00:00 UTC,a,b\n")
    assert files.csv_to_parquet(spark, str(source), target) and not files.csv_to_parquet(spark, str(source), target)
    before = data_files(target)

    def denied(*args):
        raise PermissionError("denied")

    with monkeypatch.context() as m:
        m.setattr(commit, "_rows_per_file", denied)
        with pytest.raises(PermissionError):
            files.csv_to_parquet(spark, str(source), target)
    assert data_files(target) == before


def test_plain_folders(spark, tmp_path):
    """A folder some other writer made: complete with its mark, unfinished without."""
    whole, half = str(tmp_path / "whole"), str(tmp_path / "half")
    for path in (whole, half):
        spark.range(5).write.parquet(path)
    os.remove(f"{half}/_SUCCESS")
    assert files.conversion_state(spark, whole) == commit.COMPLETE and files.conversion_state(spark, half) == commit.UNFINISHED


def test_digests_in_blocks(spark, tmp_path):
    rng = random.Random(1)
    wanted = {}
    for i, size in enumerate([1, 999, 1000, 1001, 50_000, 3_000_000]):
        content = rng.randbytes(size)
        (tmp_path / f"f{i}.bin").write_bytes(content)
        wanted[f"f{i}.bin"] = (size, hashlib.sha256(content).hexdigest())
    got = {r.file_name: (r.length, r.sha256) for r in blocks.file_digests(spark, str(tmp_path), tasks=3, block=1000).collect()}
    assert got == wanted

    class Stream:
        """Counts what one read asks for."""

        left, largest = 10_000, 0

        def read(self, n):
            Stream.largest = max(Stream.largest, n)
            taken = min(n, Stream.left)
            Stream.left -= taken
            return b"x" * taken

    assert blocks.digest_of(Stream(), 64) == (hashlib.sha256(b"x" * 10_000).hexdigest(), 10_000) and Stream.largest == 64
    dealt = blocks.dealt_by_size(spark.createDataFrame([(f"f{i}", 10**6 if i < 6 else 1) for i in range(60)], "path string, length long"), 3)
    per_task = dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()
    assert len(per_task) == 3 and max(r.bytes for r in per_task) <= 2 * 10**6 + 30
