"""CSV records across byte ranges, against the csv module."""

import csv
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.sources import records
from tidewire.sources.news import load_news, read_csv

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("s", T.StringType())])
PIECES = ["a", "b ", ",", "\n", '"', "é", "\r\n", "\n\n", "xyz"]


@pytest.fixture
def small_ranges(spark):
    """Ranges of 1 KB, so that records lie across them and some ranges begin and end inside quotes."""
    names = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def made(rng, n=300):
    return [(str(i), "".join(rng.choice(PIECES) for _ in range(3000 if i % 70 == 7 else rng.choice([0, 1, 5, 40]))), rng.choice(["", "q"])) for i in range(n)]


def put(path, rows, ending="\n", header=("id", "text", "s")):
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator=ending)
        writer.writerow(header)
        writer.writerows(rows)


def cells(rows):
    return sorted([(int(a), b or None, c or None) for a, b, c in rows], key=str)


def test_equals_csv_module(spark, small_ranges, tmp_path):
    rng = random.Random(1)
    parts = [made(rng) for _ in range(3)]
    for i, (rows, ending) in enumerate(zip(parts, ["\n", "\r\n", "\n"])):
        put(tmp_path / f"f{i}.csv", rows, ending)
    put(tmp_path / "only_header.csv", [])
    path = f"{tmp_path}/*.csv"
    got = read_csv(spark, path, SCHEMA)
    assert sorted(map(tuple, got.collect()), key=str) == cells([r for rows in parts for r in rows])
    kinds = records.quote_ranges(spark, path).groupBy("inside").count().collect()
    assert len(kinds) == 2 and records.quote_ranges(spark, path).where("not paired").count() == 0
    # sorted again after a shuffle: the way for very many ranges
    with pytest.MonkeyPatch.context() as m:
        m.setattr(records, "BROADCAST_RANGES", 0)
        again = read_csv(spark, path, SCHEMA)
        assert sorted(map(tuple, again.collect()), key=str) == cells([r for rows in parts for r in rows])


def test_one_file_is_many_tasks(spark, small_ranges, tmp_path):
    rows = made(random.Random(2), 600)
    put(tmp_path / "one.csv", rows)
    found = records.records(spark, f"{tmp_path}/one.csv")
    tasks = found.where("not first").select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= 8
    assert read_csv(spark, f"{tmp_path}/one.csv", SCHEMA).select("id").distinct().count() == 600


def test_bad_rows_unpaired_quotes_and_headers(spark, small_ranges, tmp_path):
    put(tmp_path / "good.csv", [("1", "a\nb", "x"), ("no number", "c", "y")])
    with open(tmp_path / "odd.csv", "w") as f:
        f.write('id,text,s\n3,plain,z\n4,"never closed,z\n')
    got = {r.text: r for r in read_csv(spark, f"{tmp_path}/*.csv", SCHEMA, keep_bad_rows=True).collect()}
    assert got["a\nb"].id == 1 and got["c"].id is None and "no number" in got["c"]._corrupt_record and got["plain"].id == 3
    put(tmp_path / "other.csv", [("1", "a", "x")], header=("id", "title", "s"))
    with pytest.raises((ValueError, PySparkException)):
        read_csv(spark, f"{tmp_path}/*.csv", SCHEMA).collect()


def test_news_without_line_breaks_and_with_other_columns(spark, tmp_path):
    put(tmp_path / "n.csv", [("2010-01-04 10:00:00 UTC", "t", "A")], header=("Date", "Headline", "Stock_symbol"))
    schema = T.StructType.fromDDL("Date string, Headline string, Stock_symbol string")
    for multi_line in (True, False):
        rows = load_news(spark, f"{tmp_path}/n.csv", text_col="Headline", schema=schema, multi_line=multi_line, symbol="A").collect()
        assert len(rows) == 1 and rows[0].Headline == "t"
