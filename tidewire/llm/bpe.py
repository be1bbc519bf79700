"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

A sequence of tokens is the one that merging gives exactly if every two neighbours are *compatible*: merging
the bytes of both together gives those two tokens again. The encoder takes the longest vocabulary match at each
place (from the longest that begins with the two bytes there, downwards), steps back to the next shorter match
when the pair is not compatible, and never tries a place twice, so time is linear in the length.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidewire.llm.frames import arrow_map

# The published split pattern of byte-level BPE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts between spaces whose ids a task remembers and pieces of those that hold several (all are forgotten when there are
#: more), and places for pairs of tokens, a power of two: together about 75 MB at most.
MEMORY, PIECES, PAIRS = 400_000, 1 << 14, 1 << 19


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BacktrackingBpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library.

    The file must hold a byte-level split without added prefix space and no normaliser, as the encoder
    otherwise would not give the library's ids; anything else is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = byte_letters()
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        # tables by id are lists: every Python worker of an executor holds its own
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.single = {b[0]: i for b, i in self.id_of.items() if len(b) == 1}
        # merge rank of each pair (left * size + right), and for each token the pair that makes it
        self.rank: dict[int, int] = {}
        self.left: list[int | None] = [None] * self.size
        self.right: list[int | None] = [None] * self.size
        self.made_at = [-1] * self.size
        made: list[int] = []
        for at, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.rank[a * self.size + b] = at
            made.append(ab)
            if self.left[ab] is None:
                self.left[ab], self.right[ab], self.made_at[ab] = a, b, at
        # a token the merges never leave as one piece cannot be in an encoding
        self.whole = bytearray(self.size)
        for b, i in self.id_of.items():
            self.whole[i] = self._merged(b, made) == [i]
        # longest proper prefix that is a token: the next match to try after stepping back
        self.shorter: list[int | None] = [None] * self.size
        # length of the longest token that begins with two bytes
        self.reach = array("H", [1]) * (1 << 16)
        for b, i in self.id_of.items():
            if not self.whole[i]:
                continue
            if len(b) > 1:
                head = b[0] << 8 | b[1]
                self.reach[head] = max(self.reach[head], len(b))
            for n in range(len(b) - 1, 0, -1):
                if (p := self.id_of.get(b[:n])) is not None and self.whole[p]:
                    self.shorter[i] = p
                    break
        self.id_of = {b: i for b, i in self.id_of.items() if self.whole[i]}
        self.split = regex.compile(SPLIT)
        self.special_cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.cut = re.compile(r" (?=\S)")
        self.odd_space = re.compile(r" (?:\s|$)")
        # a place holds the last pair of those that share it, and its answer in the lowest bit
        self.pairs = array("q", [-1]) * PAIRS
        self.memory: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # decoding: all tokens' bytes after one another, and where each begins
        texts = list(self.bytes_of)
        for s, i in self.specials.items():
            texts[i] = s.encode()
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def forget(self) -> None:
        """Gives back what was remembered of texts; the tables and the places for pairs stay."""
        self.memory.clear()
        self.pieces.clear()

    def _merged(self, piece: bytes, made: list[int]) -> list[int]:
        """Plain merging, for single vocabulary entries when the tables are built; ``made`` is the token of each rank."""
        ids = [self.single[b] for b in piece]
        while len(ids) > 1:
            pairs = (a * self.size + b for a, b in zip(ids, ids[1:]))
            found = min(((self.rank[p], at) for at, p in enumerate(pairs) if p in self.rank), default=None)
            if found is None:
                break
            rank, at = found
            ids[at : at + 2] = [made[rank]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens together leaves exactly these two.

        Undo both tokens merge by merge, latest first; if at any state the two pieces that touch would have been
        merged before the merge just undone, the pair cannot stand.
        """
        size, rank, made_at = self.size, self.rank, self.made_at
        key = left * size + right
        known = self.pairs[key & (PAIRS - 1)]
        if known >> 1 == key:
            return bool(known & 1)
        limit, a, b, answer = 1 << 62, left, right, True
        while True:
            found = rank.get(a * size + b)
            if found is not None and found < limit:
                answer = False
                break
            rank_a, rank_b = made_at[a], made_at[b]
            if rank_a < 0 and rank_b < 0:
                break
            # of equal ranks the left one is merged first, so the right one is undone first
            if rank_a > rank_b:
                limit, a = rank_a, self.right[a]
                # the pair met left of this merge's place: equal rank would merge the left one first
            else:
                limit, b = rank_b + 1, self.left[b]
        self.pairs[key & (PAIRS - 1)] = key << 1 | answer
        return answer

    def _longest(self, piece: bytes, at: int) -> int:
        """The longest match that begins at a place."""
        known = self.id_of
        if at + 1 < len(piece):
            for end in range(min(len(piece), at + self.reach[piece[at] << 8 | piece[at + 1]]), at + 1, -1):
                token = known.get(piece[at:end])
                if token is not None:
                    return token
        return self.single[piece[at]]

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece of the split."""
        whole = self.id_of.get(piece)
        if whole is not None:
            return [whole]
        size = len(piece)
        open_places = bytearray(b"\x01") * (size + 1)
        ids: list[int] = []
        at, token = 0, self._longest(piece, 0)
        while True:
            end = at + len(self.bytes_of[token])
            if open_places[end] and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                if end == size:
                    return ids
                at, token = end, self._longest(piece, end)
                continue
            nxt = self.shorter[token]
            if nxt is not None:
                token = nxt
                continue
            # nothing fits here: this place is closed, go back to the token before
            open_places[at] = 0
            token = ids.pop()
            at -= len(self.bytes_of[token])
            # the same token again: its end is closed now, so the next shorter one is tried

    def _packed(self, piece: str) -> bytes:
        ids = self.piece_ids(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, text: str) -> bytes:
        pieces, out = self.pieces, []
        found = self.split.findall(text)
        if len(found) == 1:  # the caller remembers it
            return self._packed(found[0])
        for piece in found:
            ids = pieces.get(piece)
            if ids is None:
                ids = self._packed(piece)
                if len(piece) <= 100:
                    if len(pieces) >= PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """Ids of text without special tokens. A space before a non-space always begins a piece, so the text is cut there."""
        if self.odd_space.search(text):
            first, *rest = self.cut.split(text)
        else:
            first, *rest = text.split(" ")
        memory = self.memory  # keys lack the space they begin with
        out = [self._chunk(first)]
        try:
            out += map(memory.__getitem__, rest)
            return b"".join(out)
        except KeyError:
            del out[1:]
        for part in rest:
            ids = memory.get(part)
            if ids is None:
                ids = self._chunk(" " + part)
                if len(part) <= 100:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special_cut is None or not self.special_cut.search(text):
            return self._plain(text) if text else b""
        out, at = [], 0
        for found in self.special_cut.finditer(text):
            out.append(self._plain(text[at : found.start()]) if found.start() > at else b"")
            out.append(np.array([self.specials[found[0]]], "<u4").tobytes())
            at = found.end()
        out.append(self._plain(text[at:]) if at < len(text) else b"")
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        """UTF-8 of the ids: every token's span of the offset table, gathered at once; broken sequences become U+FFFD."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        starts = self.offsets[tokens]
        lengths = self.offsets[tokens + 1] - starts
        total = int(lengths.sum())
        shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return self.blob[np.arange(total) + shift].tobytes().decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.array(ids, "<u4").tobytes()).decode()


_loaded: dict[str, BacktrackingBpe] = {}


def load(path: str) -> BacktrackingBpe:
    """The tables of a vocabulary file, built once per Python worker."""
    if path not in _loaded:
        _loaded[path] = BacktrackingBpe(path)
    return _loaded[path]


def forget(path: str) -> Callable[[], None]:
    """Ends a task: its worker lives on and may be needed for other work."""
    return lambda: load(path).forget()


def _over_texts(df: DataFrame, text: str, make: Callable[[], Callable[[str], dict]], schema: str, names: list[str], done: Callable[[], None]) -> DataFrame:
    others = [c for c in df.columns if c not in names]
    frame = df.select(*[f"`{c}`" for c in others])
    added = [(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64() if f.endswith("bigint") else pa.string()) for f in schema.split(", ")]

    def build():
        step = make()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [step(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in added]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(n for n, _ in added)])

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return arrow_map(frame, build, f"{kept}, {schema}", done)


def encode_texts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``.

    A null or empty text has no ids. Special tokens' strings in a text become their ids, as in the library's
    default. Every row is kept, repeated rows too; a column of ``df`` named ``ids`` or ``n_tokens`` is replaced.
    No shuffle; memory is that of one Arrow batch and the remembered pieces.
    """

    def make():
        model = load(path)

        def step(value: str) -> dict:
            ids = model.encode_bytes(value)
            return {"ids": ids, "n_tokens": len(ids) // 4}

        return step

    return _over_texts(df, text, make, "ids binary, n_tokens bigint", ["ids", "n_tokens"], forget(path))


def decode_ids(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` (string) for a binary column of ids; null ids give an empty text."""
    others = [c for c in df.columns if c != "decoded"]
    frame = df.select(*[f"`{c}`" for c in others])

    def build():
        model = load(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [model.decode_bytes(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names, "decoded"]
            )

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return arrow_map(frame, build, f"{kept}, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, SHA-256 of the ids and of the decoded text.

    Encodes and decodes in one pass, so neither the ids nor the decoded text travel. Null texts are empty; the
    digests are then those of no bytes.
    """

    def build():
        model = load(path)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, ids_sha, text_sha = [], [], []
            for value in batch.column(1).to_pylist():
                ids = model.encode_bytes(value or "")
                count.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(model.decode_bytes(ids)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return run

    return arrow_map(
        docs.selectExpr("cast(doc_id as bigint) doc_id", "text"),
        build,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        forget(path),
    )
