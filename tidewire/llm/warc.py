"""Legacy archives to WARC: read ARC records by their version's header line and declared length, write WARC.

An ARC file begins with a version block: its first line describes the block, the second has the version, and the
third names the fields of every later record line (five in version 1, ten in version 2). Each record is such a
line, as many bytes as its last field says, and a line feed. What WARC needs and ARC lacks is made up so that the
same record always gets the same: an identifier from URI, date, row and digest, a timestamp from the 14 digits, a
type from the scheme and the payload's digest. Records are gzip members of their own.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.files import Sink, new_folder, open_file
from tidewire.llm.frames import short_batches, small, written
from tidewire.session import SLICE, give_back

# The record lines of both ARC versions and the WARC revisit profile.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are never replaced by a revisit.
LEAST_PAYLOAD = 100
#: Bytes after which a page archive is closed.
ARC_BYTES = 4 << 20
#: Archives that a task converts.
TASK_ARCS = 4
#: Rows of a batch that are Python objects at once.
ROWS = 100


# -- ARC ---------------------------------------------------------------------------------------------------------
@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    status: str | None
    body: bytes
    offset: int


def arc_header(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 converter\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain"
    if version == 2:
        line += f" 200 - - 0 {name}"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def arc_record(version: int, name: str, offset: int, url: str, date: str, status: int, body: bytes) -> bytes:
    line = f"{url} 0.0.0.0 {date} text/html"
    if version == 2:
        line += f" {status} {hashlib.md5(body).hexdigest()} - {offset} {name}"
    return f"{line} {len(body)}\n".encode() + body + b"\n"


def _arc_line(line: bytes, names: list[str]) -> dict[str, str] | None:
    """The fields of a record line, or None if it is none.

    Legacy archives hold urls in any 8-bit encoding and with blanks: bytes that are no UTF-8 are read as Latin-1, and
    what is too many belongs to the url, which comes first.
    """
    line = line.rstrip(b"\r")
    try:
        values = line.decode("utf-8").split(" ")
    except UnicodeDecodeError:
        values = line.decode("latin-1").split(" ")
    more = len(values) - len(names)
    if more < 0:
        return None
    row = dict(zip(names, [" ".join(values[: more + 1]), *values[more + 1 :]]))
    return row if row["Archive-length"].isdigit() and row["URL"] else None


def _next_record(data: bytes, at: int, names: list[str]) -> int:
    """Where the next record line behind ``at`` is whose date and declared length hold; the end if there is none."""
    while (at := data.find(b"\n", at) + 1) > 0:
        stop = data.find(b"\n", at)
        if stop < 0:
            break
        row = _arc_line(data[at:stop], names) if stop - at < 65_536 else None
        if row and re.fullmatch(r"\d{8,14}", row["Archive-date"]):
            end = stop + 1 + int(row["Archive-length"])
            if end == len(data) or data[end : end + 1] in (b"\n", b"\r"):
                return at
    return len(data)


def read_arc(data: bytes, errors: list[tuple[int, str]] | None = None) -> Iterator[ArcRecord]:
    """Records of one ARC file, version block left out.

    The version block's second line names the fields; a record line with too few fields or without a length, or a length
    beyond the file, is an error. It is raised, or, with a list in ``errors``, noted there with its byte, and reading goes on
    at the next record whose date and declared length hold. Blank lines between records are allowed.
    """
    at, fields = 0, FIELDS[1].split()
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        offset = at
        line = data[at : stop if stop >= 0 else len(data)]
        first = at == 0 and line.startswith(b"filedesc:")
        values = line.rstrip(b"\r").split(b" ")
        row = {"Archive-length": values[-1].decode("latin-1")} if first else _arc_line(line, fields)
        if stop < 0:
            wrong = "record line without an end"
        elif row is None or not row["Archive-length"].isdigit():
            wrong = f"{len(values)} fields instead of {len(fields)}, or no length"
        else:
            body = data[stop + 1 : stop + 1 + int(row["Archive-length"])]
            left = int(row["Archive-length"]) - len(body)
            wrong = f"declared length is {left} bytes beyond the end" if left else ""
        if wrong:
            if errors is None:
                raise ValueError(f"{wrong}, at byte {offset}")
            errors.append((offset, wrong))
            at = _next_record(data, offset, fields)
            continue
        at = stop + 1 + len(body)
        if first:
            lines = body.decode("utf-8", "replace").splitlines()
            if len(lines) >= 2 and "Archive-length" in lines[1].split(" "):
                fields = lines[1].split(" ")
            elif lines and lines[0].split(" ")[0] in ("1", "2"):
                fields = FIELDS[int(lines[0].split(" ")[0])].split()
            continue
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], row.get("Result-code"), body, offset)


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; a body that is no HTTP answer is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[: found.end()], body[found.end() :]) if found else (body, b"")


def head_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


# -- WARC --------------------------------------------------------------------------------------------------------
def warc_date(digits: str) -> str:
    """The 14 digits of an ARC date as a WARC date; missing digits at the end are the earliest ones."""
    digits = re.sub(r"\D", "", digits)[:14]
    padded = digits + "00000101000000"[len(digits) :]
    try:
        return datetime.strptime(padded, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*parts: object) -> str:
    """A version-4-shaped identifier that depends only on ``parts``."""
    raw = hashlib.sha256("\x00".join(map(str, parts)).encode("utf-8", "replace")).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=4)}>"


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzip or plain WARC stream."""
    head = stream.read(2)
    stream.seek(0)
    source = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if head == b"\x1f\x8b" else stream
    while True:
        line = source.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        fields: dict[str, str] = {}
        while (line := source.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = source.read(length)
        if len(block) != length:
            raise ValueError("a record is cut off")
        yield fields, block


# -- Spark jobs --------------------------------------------------------------------------------------------------
def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def pages_to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Legacy archives of a page table, written as gzip files: ``name``, ``version``, ``file``, about ``ARC_BYTES`` unpacked.

    The files are streamed to the store by the tasks: as cells of a table, hundreds would be in an executor's memory at once.
    Each page is an HTTP answer whose header ``X-Row`` has the page's key. Versions 1 and 2 alternate. Null html is
    an empty payload; in urls, blanks and control characters are percent-encoded and a null url is ``about:blank``.
    Rows are taken as they are partitioned, without a shuffle.
    """
    short_batches(pages.sparkSession)
    folder = folder or new_folder(pages.sparkSession, "arc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        sink, packer, size, name, version = None, None, 0, "", 1

        def begin() -> None:
            nonlocal sink, packer, size, name, version, number
            name, version = f"pages-{part:06d}-{number:04d}.arc", 1 + (part + number) % 2
            sink, packer = Sink(folder, f"{name}.gz"), zlib.compressobj(1, wbits=31)
            size, number = 0, number + 1
            put(arc_header(version, name, "20000101000000"))

        def put(data: bytes) -> None:
            nonlocal size
            sink.write(packer.compress(data))
            size += len(data)

        def close() -> pa.RecordBatch:
            sink.write(packer.flush())
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([sink.uri])], ["name", "version", "file"])

        for batch in _slices(batches):
            for row_key, address, text in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    begin()
                payload = (text or "").encode()
                shown = quote(address, safe="%/:?#[]@!$&'()*+,;=~-._") if address else "about:blank"
                row = "" if row_key is None else f"X-Row: {row_key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{row}Content-Length: {len(payload)}\r\n\r\n"
                day = datetime(2000, 1, 1) + timedelta(seconds=(row_key or 0) % 3_000_000_000)
                put(arc_record(version, name, size, shown, day.strftime("%Y%m%d%H%M%S"), 200, head.encode() + payload))
                if size >= ARC_BYTES:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()
        batch = None
        give_back()

    return pages.select(F.col(key).cast("bigint"), url, html).mapInArrow(run, "name string, version int, file string")


def dealt_archives(arcs: DataFrame) -> DataFrame:
    """Written archives dealt to tasks by name, ``TASK_ARCS`` each, fewer if there are idle cores."""
    count = max(1, arcs.count())
    cores = arcs.sparkSession.sparkContext.defaultParallelism
    return arcs.repartitionByRange(min(count, max(cores, -(-count // TASK_ARCS))), "name")


def _archives(batches: Iterator[pa.RecordBatch], is_file: bool) -> Iterator[tuple[str, bytes]]:
    """Name and unpacked content of one archive after the other."""
    for batch in batches:
        for name, held in zip(*batch.columns):
            if is_file:
                with open_file(held.as_py()) as file:
                    content = file.read()
            else:
                content = held.as_py() or b""
            yield name.as_py(), gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


#: What the converter knows of each ARC record before it is written.
RECORD = "uri string, date string, content_type string, http_head binary, payload binary, payload_bytes bigint, payload_digest string, row_key bigint, record_id string"


def arc_records(arcs: DataFrame) -> DataFrame:
    """The records of ARC files (``name``, ``file``; or ``content``, for instance of Spark's ``binaryFile`` reader with ``path as name``),
    with synthesised identifier, date, type of content and digest. Null or empty content gives no record; gzip members are
    unpacked first."""

    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD.split(", ")])

    held_in = "file" if "file" in arcs.columns else "content"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _archives(batches, held_in == "file"):
            rows, held = [], 0
            for r in read_arc(content, []):  # what cannot be read is in ``arc_errors``
                head, payload = split_http(r.body)
                digest = hashlib.sha256(payload).hexdigest()
                row, date = head_field(head, "X-Row"), warc_date(r.date)
                rows.append((r.url, date, r.content_type, head, payload, len(payload), digest, int(row) if row and re.fullmatch(r"-?\d{1,18}", row) else None, record_id(r.url, date, row or f"{name}@{r.offset}", digest)))
                held += len(r.body)
                if held >= ARC_BYTES or len(rows) >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
        rows = content = r = head = payload = None
        give_back()

    return arcs.select("name", held_in).mapInArrow(run, RECORD)


def arc_errors(arcs: DataFrame) -> DataFrame:
    """``name``, ``offset``, ``reason`` of every place of the archives where no record could be read."""
    schema = pa.schema([("name", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])

    held_in = "file" if "file" in arcs.columns else "content"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content in _archives(batches, held_in == "file"):
            errors: list[tuple[int, str]] = []
            for _ in read_arc(content, errors):
                pass
            yield pa.RecordBatch.from_pylist([{"name": name, "offset": at, "reason": why} for at, why in errors], schema)

    return arcs.select("name", held_in).mapInArrow(run, "name string, offset bigint, reason string")


def originals(records: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """For each payload of at least ``least`` bytes that several records have: the smallest ``row_key``, with its
    record's id, uri and date. Combined within tasks first, so a hot payload costs one row per task."""
    first = F.min(F.struct("row_key", "record_id", "uri", "date")).alias("first")
    return (
        records.where((F.col("payload_bytes") >= least) & F.col("row_key").isNotNull())
        .groupBy("payload_digest")
        .agg(first, F.count("*").alias("n"))
        .where("n > 1")
        .select("payload_digest", F.col("first.row_key").alias("first_key"), F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date"))
    )


def write_warc(records: DataFrame, folder: str | None = None, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write converted records as WARC files, one per task, and return the written list (``file``, ``n_records``).

    A record whose payload another record with a smaller ``row_key`` has is a revisit of that one, without the
    payload; payloads under ``least`` bytes are always written. Records with the smallest key itself (also repeated
    rows) and records without a key are responses.
    """
    spark = records.sparkSession
    short_batches(spark)
    folder = folder or new_folder(spark, "warc")
    firsts = written(originals(records, least), "warc-originals")
    joined = records.join(small(firsts), "payload_digest", "left")
    columns = [f.split()[0] for f in RECORD.split(", ")]
    joined = joined.select(*columns, "first_key", "first_id", "first_uri", "first_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, count = None, 0
        part = TaskContext.get().partitionId()
        for batch in _slices(batches):
            for row in batch.to_pylist():
                if sink is None:
                    sink = Sink(folder, f"pages-{part:06d}.warc.gz")
                    info = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
                    sink.write(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(sink.uri)), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info))
                revisit = row["first_key"] is not None and row["row_key"] is not None and row["row_key"] != row["first_key"]
                http = bool(row["http_head"])
                kind = "revisit" if revisit else "response" if http else "resource"
                fields = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", row["record_id"]),
                    ("WARC-Date", row["date"]),
                    ("WARC-Target-URI", row["uri"]),
                    ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
                    ("Content-Type", "application/http; msgtype=response" if http else row["content_type"]),
                    ("X-Row", row["row_key"]),
                    ("X-Payload-Length", row["payload_bytes"]),
                ]
                if revisit:
                    fields += [
                        ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To", row["first_id"]),
                        ("WARC-Refers-To-Target-URI", row["first_uri"]),
                        ("WARC-Refers-To-Date", row["first_date"]),
                        ("X-Refers-To-Row", row["first_key"]),
                    ]
                sink.write(warc_record(fields, row["http_head"] + (b"" if revisit else row["payload"])))
                count += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([sink.uri]), pa.array([count], pa.int64())], ["file", "n_records"])
        batch = row = None
        give_back()

    return written(joined.mapInArrow(run, "file string, n_records bigint"), "warc-files")


def read_archives(files: DataFrame) -> DataFrame:
    """Content records of WARC files (column ``file``), one row each, with the payload checked against its digest.

    A revisit has no payload; its length and digest are those its header declares.
    """
    count = max(1, files.count())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "target_uri", "date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with open_file(uri) as file:
                    for fields, block in read_warc(file):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        length = int(fields["x-payload-length"])
                        if kind != "revisit":
                            payload = split_http(block)[1] if kind == "response" else block
                            length = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{uri}: payload of {fields['warc-record-id']} does not match its digest")
                        rows.append((_int(fields.get("x-row")), length, digest, kind, _int(fields.get("x-refers-to-row")), fields["warc-record-id"], unquote(fields["warc-target-uri"]), fields["warc-date"]))
                        if len(rows) >= SLICE:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    shown = ["bigint" if k == pa.int64() else "string" for k in kinds]
    spread = files.select("file").repartitionByRange(count, "file")
    return spread.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, shown)))


def _int(value: str | None) -> int | None:
    return None if value is None else int(value)


def convert_pages(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, ARC to WARC files, and the WARC records read back: one row per page."""
    arcs = written(pages_to_arc(pages), "arc")
    return read_archives(write_warc(arc_records(dealt_archives(arcs))))
