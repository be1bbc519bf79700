"""What legacy archives take in an executor: their bytes go from a task to a file and never through rows."""

import gzip
import hashlib

import pytest

from tidewire.llm import warc
from tidewire.llm.files import open_file


@pytest.fixture
def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 1500}</p>" * 20) for i in range(2500)]
    rows += [(7, "http://h/7", "again" * 50), (None, "http://n", "no key" * 50), (9000, None, None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)


def test_archives_are_files_and_their_rows_small(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARC_BYTES", 20_000)
    rows = warc.pages_to_arc(pages).collect()
    assert len(rows) > 20 and max(len(str(r.asDict())) for r in rows) < 1000
    got = []
    for row in rows:
        with open_file(row.file) as file:
            content = gzip.decompress(file.read())
        assert len(content) < 25_000 and content.startswith(warc.arc_header(row.version, row.name, "20000101000000"))
        got += [warc.split_http(r.body)[1].decode() for r in warc.read_arc(content)]
    assert sorted(got) == sorted(r.html or "" for r in pages.collect())


def test_files_and_cells_give_the_same_records(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "ARC_BYTES", 100_000)
    arcs = spark.createDataFrame(warc.pages_to_arc(pages).collect())
    cells = []
    for row in arcs.collect():
        with open_file(row.file) as file:
            cells.append((row.name, file.read()))
    cells = spark.createDataFrame(cells, "name string, content binary")
    in_files, in_cells = (sorted(map(str, warc.arc_records(df).collect())) for df in (warc.dealt_archives(arcs), cells))
    assert len(in_files) == pages.count() and in_files == in_cells
    assert warc.arc_errors(arcs).count() == warc.arc_errors(cells).count() == 0


def test_a_file_of_many_records_is_read_whole(spark, pages):
    written = warc.write_warc(warc.arc_records(spark.createDataFrame(warc.pages_to_arc(pages).collect()).coalesce(1)))
    assert written.count() == 1 and written.first().n_records == pages.count()
    got = warc.read_archives(written).collect()
    want = [(r.page_id, hashlib.sha256((r.html or "").encode()).hexdigest()) for r in pages.collect()]
    assert sorted(map(str, ((r.page_id, r.payload_digest) for r in got))) == sorted(map(str, want))
