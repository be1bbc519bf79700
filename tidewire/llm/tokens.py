"""Token files: independent zstandard frames, a document index and a trailing seek table.

A file is a row of zstandard frames, each with the ids of whole documents, so every frame can be read alone; then
a skippable frame with the documents (id, frame, tokens); then the seek table in the public seekable format: a
skippable frame with the compressed size, size and checksum (low half of XXH64) of each frame, and a footer. A
plain zstandard reader still decompresses the whole file. A reader takes the footer, the table and the index, and
fetches only the frames of the documents it wants.
"""

from __future__ import annotations

import os
import string
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.files import Sink, new_folder, open_file
from tidewire.llm.frames import written

# Fixed values of the seekable format and of this file's document index.
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A51
HAS_CHECKSUM = 0x80

#: Ids after which a frame is closed at the end of a document.
FRAME_TOKENS = 1 << 16
#: Pieces of text whose ids one worker remembers.
MEMORY = 1_200_000
#: Texts whose new pieces are encoded at once.
TEXTS = 200
#: Letters whose lower case is one letter, as which the tokenizer's patterns see them too.
LETTERS = frozenset(string.ascii_letters + "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)))

#: One document in a file's index: its id, whether it has one, its frame, its tokens.
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "<u1"), ("frame", "<u4"), ("n_tokens", "<u8")])


class PieceEncoder:
    """The library's ids for a tokenizer that drops white space, each blank-free piece encoded once.

    Such a tokenizer never forms a token across a space or line feed, so the ids of a text are those of its
    pieces in turn; nor across the end of a word, so a piece's final punctuation is encoded apart, and where
    the tokenizer lower-cases, ASCII pieces are looked up in lower case. That is checked on the tokenizer's own settings;
    any other tokenizer encodes whole texts, as does a text that may hold a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_pieces = drops_blanks(spec)
        norms = spec["normalizer"] or {}
        self.lowers = any(step["type"] == "Lowercase" for step in norms.get("normalizers", [norms]) if step)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.memory: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian integers of ``width``."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new pieces of all of them are encoded together."""
        cut = [None if not self.by_pieces or any(s in t for s in self.specials) else t.replace("\n", " ").split(" ") for t in texts]
        pieces = set().union(*(parts for parts in cut if parts is not None))
        new = pieces.difference(self.memory)
        if len(self.memory) + 2 * len(new) > MEMORY:
            self.memory = {"": b""}
            new = pieces
        self._learn(new)
        return [self.whole(t) if parts is None else b"".join(map(self.memory.__getitem__, parts)) for t, parts in zip(texts, cut)]

    def _learn(self, pieces: set[str]) -> None:
        """Remembers the ids of pieces; words without their punctuation are remembered too."""
        made, need = [], set()
        for piece in pieces:
            word = piece.rstrip(string.punctuation)
            if word != piece and (not word or word[-1] not in LETTERS):
                word = piece
            end = piece[len(word) :]
            if self.lowers and word.isascii():
                word = word.lower()
            need.add(word)
            if end or word != piece:
                need.add(end)
                made.append((piece, word, end))
        asked = list(need.difference(self.memory))
        code, swap = "H" if self.width.itemsize == 2 else "I", sys.byteorder == "big"
        for piece, found in zip(asked, self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)):  # no offsets
            ids = array(code, found.ids)
            if swap:
                ids.byteswap()
            self.memory[piece] = ids.tobytes()
        for piece, word, end in made:
            self.memory[piece] = self.memory[word] + self.memory[end]


def drops_blanks(spec: dict) -> bool:
    """Whether a tokenizer's settings are: normalisers that act on single characters or runs of blanks, and a first
    split that drops everything its pattern, made of classes without blanks, does not match."""
    norms = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    steps = norms.get("normalizers", [norms])
    for step in steps:
        replace = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if not replace and step["type"] not in ("NFC", "Lowercase"):
            return False
    pre = spec["pre_tokenizer"] or {}
    first = pre.get("pretokenizers", [pre])[0]
    if first.get("type") != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        return False
    parts = first["pattern"].get("Regex", " ").split("|")
    allowed = {r"[\p{L}]+", r"[\p{N}]", r"[\p{N}]+", r"[^\s\p{L}\p{N}]+"}
    return all(p in allowed or p.startswith("'") and p[1:].isalpha() for p in parts)


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


class TokenWriter:
    """Writes one token file to anything with ``write``; documents come in their final order."""

    def __init__(self, out, width: np.dtype, frame_tokens: int = FRAME_TOKENS):
        self.out, self.width, self.frame_tokens = out, np.dtype(width), frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.entries: list[tuple] = []
        self.open: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // self.width.itemsize
        self.entries.append((doc_id or 0, doc_id is not None, len(self.frames), count))
        self.open.append(ids)
        self.held += count
        if self.held >= self.frame_tokens:
            self._close_frame()

    def _close_frame(self) -> None:
        raw = b"".join(self.open)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.open, self.held = [], 0

    def close(self) -> None:
        if self.open:
            self._close_frame()
        index = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(np.array(self.entries, ENTRY).tobytes())
        head = struct.pack("<BQ", self.width.itemsize, len(self.entries))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(head) + len(index)) + head + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        # the index is a frame of the file too: its size lets a reader find it, and it decompresses to nothing
        size = 8 + len(head) + len(index)
        table += struct.pack("<III", size, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        footer = struct.pack("<IBI", len(self.frames) + 1, HAS_CHECKSUM, SEEK_FOOTER)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class TokenReader:
    """Reads chosen documents of a token file; ``file`` has ``seek``, ``read`` and ``size``."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_FOOTER or not flags & HAS_CHECKSUM:
            raise ValueError("no seek table with checksums at the end of the file")
        start = end - 9 - 12 * count
        file.seek(start - 8)
        head, length = struct.unpack("<II", file.read(8))
        if head != SEEK_MAGIC or length != 12 * count + 9:
            raise ValueError("the seek table does not fit its frame")
        table = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.sums, self.sizes = table[:, 2], table[:, 1]
        file.seek(int(self.places[-2]))
        index = file.read(int(table[-1, 0]))
        if struct.unpack("<I", index[:4])[0] != INDEX_MAGIC:
            raise ValueError("no document index")
        width, documents = struct.unpack("<BQ", index[8:17])
        self.width = np.dtype(f"<u{width}")
        self.documents = np.frombuffer(zstandard.ZstdDecompressor().decompress(index[17:], max_output_size=max(1, documents * ENTRY.itemsize)), ENTRY)
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        """One frame's content, checked against the seek table."""
        self.file.seek(int(self.places[number]))
        raw = self.decompressor.decompress(self.file.read(int(self.places[number + 1] - self.places[number])), max_output_size=max(1, int(self.sizes[number])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[number]:
            raise ValueError(f"checksum of frame {number} does not match")
        return raw

    def read(self, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Row number in the index and ids of the documents asked for (all by default), each frame read once."""
        at = self.documents["n_tokens"].astype(np.int64)
        frames = self.documents["frame"]
        before = np.cumsum(at) - at
        first = np.searchsorted(frames, frames)
        begin = before - before[first] if len(at) else before
        held, content = -1, None
        for row in np.arange(len(at)) if rows is None else np.sort(rows):
            if frames[row] != held:
                held = int(frames[row])
                content = np.frombuffer(self.frame(held), self.width)
            yield int(row), content[begin[row] : begin[row] + at[row]]


def write_tokens(docs: DataFrame, path: str, end_id: int | None = None, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) and write token files in ascending ``doc_id`` order.

    Returns the written list of files: ``part`` (their order), ``file``, ``n_docs``, ``n_tokens``. Texts are sorted
    by a range shuffle before they are encoded, so the encoder runs once. Rows with equal ``doc_id`` follow the
    order of their texts; a null ``doc_id`` comes first; a null text is empty and has only ``end_id``. An empty
    table gives no files. Other columns are not read. A very long text is a frame of its own.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(path), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], code.width).tobytes()
        sink = writer = None
        tokens = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                rows = batch.slice(at, TEXTS)
                if writer is None:
                    sink = Sink(folder, f"tokens-{part:06d}.zst")
                    writer = TokenWriter(sink, code.width)
                found = code.encode_all([t or "" for t in rows.column(1).to_pylist()])
                for doc_id, ids in zip(rows.column(0).to_pylist(), found):
                    tokens += len(ids + end) // code.width.itemsize
                    writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": sink.uri, "n_docs": len(writer.entries), "n_tokens": tokens}],
                pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return written(rows.mapInArrow(run, "part bigint, file string, n_docs bigint, n_tokens bigint"), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """The file list with ``start``: ids in all files before. One row per file, so one task orders them."""
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_tokens(files: DataFrame, doc_ids: set[int] | None = None, digests: bool = False) -> DataFrame:
    """Documents from a list of token files: ``doc_id``, ``start``, ``n_tokens`` and ``ids`` (little-endian unsigned
    32-bit), or their crc32 ``ids_crc32`` with ``digests``. With ``doc_ids`` only their frames are fetched.
    """
    count = max(1, files.count())
    spread = with_starts(files).repartitionByRange(count, "part")
    last = "ids_crc32 bigint" if digests else "ids binary"
    kind = pa.int64() if digests else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["file"]) as file:
                    reader = TokenReader(file)
                    index = reader.documents
                    counts = index["n_tokens"].astype(np.int64)
                    starts = row["start"] + np.cumsum(counts) - counts
                    wanted = None if doc_ids is None else np.flatnonzero(np.isin(index["doc_id"], list(doc_ids)) & (index["has_id"] == 1))
                    out: list[tuple] = []
                    for at, ids in reader.read(wanted):
                        raw = ids.astype("<u4").tobytes()
                        entry = index[at]
                        out.append((int(entry["doc_id"]) if entry["has_id"] else None, int(starts[at]), int(counts[at]), zlib.crc32(raw) if digests else raw))
                        if len(out) >= 2000:
                            yield _batch(out, last.split()[0], kind)
                            out = []
                    if out:
                        yield _batch(out, last.split()[0], kind)

    return spread.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def _batch(rows: list[tuple], name: str, kind: pa.DataType) -> pa.RecordBatch:
    doc_id, start, count, value = zip(*rows)
    arrays = [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(count, pa.int64()), pa.array(value, kind)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", name])


def token_file_digests(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write the token files, read them back, and give ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    return read_tokens(write_tokens(docs, path, end_id), digests=True)
