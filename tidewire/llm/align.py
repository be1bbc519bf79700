"""Which tokens of two tokenizers cover the same text.

Both tokenizers cut the same bytes. Where a token of each ends at the same byte, the text falls into *groups*. A stretch
of bytes is a **fragment**: the tokens before its first known common end (open head), the groups that are closed, and the
tokens after its last common end (open tail). Two neighbouring fragments compose into one, and composing is associative,
so a long text is cut into byte ranges that are encoded in different tasks and put together in a tree. Only open heads
and tails travel up the tree; closed groups stay where they were found.

Each tokenizer's range begins at a place where that tokenizer can be cut without changing its tokens, which need not be
the same place for both; what lies between the two places is what heads and tails hold.

A *link* is a pair of tokens that share bytes. Between two neighbouring token ends of either kind lies one token of each,
so there are as many links as distinct ends.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.bpe import SPLIT, byte_letters
from tidewire.llm.files import store
from tidewire.llm.frames import arrow_map, written
from tidewire.session import scratch_path

#: Texts of more bytes than this are cut; characters of a range.
LONG, RANGE = 1 << 16, 1 << 14
#: Fragments composed in one step of the tree.
FAN = 16
#: Distinct pairs of ids up to which their counts are looked up in each worker (12 bytes each); beyond, they are joined.
LOOKUP_PAIRS = 8_000_000
#: Distinct pairs a task counts before it hands them on.
HELD_PAIRS = 1_000_000
#: Bytes of text aligned in one numpy pass.
PASS_BYTES = 1 << 19

# An end is held as end * 2**20 + id.
_ID_BITS = 20
_ID_MASK = (1 << _ID_BITS) - 1


class Side:
    """One tokenizer: ids of texts, the bytes of each id, and where a text can be cut."""

    bytes_of: list[bytes]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, each with one space before it."""
        raise NotImplementedError

    def encode_range(self, text: str) -> np.ndarray:
        """Ids of a range of such a text, begun where ``cut`` says."""
        raise NotImplementedError

    def cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on where the tokens of both halves are those of the whole; else the end."""
        raise NotImplementedError

    def lengths(self) -> np.ndarray:
        return np.array([len(b) for b in self.bytes_of], np.int64)


class ByteSide(Side):
    """A byte-level BPE file of the tokenizers library; strings of special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        letters = byte_letters()
        vocab = model["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if all(c in letters for c in token)}
        ranks = {token: i for token, i in ranks.items() if i < 256 + len(model["merges"])}
        for at, pair in enumerate(model["merges"]):  # ids must stand in the order of the merges
            joined = "".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)
            if vocab[joined] != 256 + at:
                raise ValueError(f"{path}: ids do not follow the merges")
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.library = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        # the split never joins these two characters, and it begins anew there
        self.safe = regex.compile(r"(?<=[^\s'])(?=[ \t\n])|(?<=[A-Za-zÀ-ɏЀ-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-&(-/:-@\[-`{-~、。！，])")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.library.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]

    def encode_range(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=())

    def cut(self, text: str, at: int) -> int:
        found = self.safe.search(text, at)
        return found.start() if found else len(text)


class PieceSide(Side):
    """A sentencepiece BPE file that keeps the text as it is and puts a space before it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # neighbours inside some piece; merges never join any others
        self.joined = {p[k : k + 2] for i, p in enumerate(pieces) if not self.library.is_byte(i) for k in range(len(p) - 1)}
        # a line break is never joined to anything, so what follows it is encoded as it is
        self.lead = self.library.encode("\n")
        if [self.bytes_of[i] for i in self.lead] != [b" ", b"\n"]:
            raise ValueError(f"{path}: text is not kept as it is")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.library.encode(texts, num_threads=1)] if texts else []

    def encode_range(self, text: str) -> np.ndarray:
        return np.array(self.library.encode("\n" + text)[len(self.lead) :], np.uint32)

    def cut(self, text: str, at: int) -> int:
        at = max(at, 1)
        while at < len(text) and text[at - 1 : at + 1].replace(" ", "▁") in self.joined:
            at += 1
        return min(at, len(text))


class Aligner:
    """Both tokenizers, and what their tokens have in common."""

    def __init__(self, path_a: str, path_b: str):
        self.sides = (ByteSide(path_a), PieceSide(path_b))
        self.lengths = tuple(s.lengths() for s in self.sides)
        self.sizes = tuple(len(s.bytes_of) for s in self.sides)
        if max(self.sizes) > _ID_MASK or self.sizes[0] * self.sizes[1] > 1 << 32:
            raise ValueError("too many tokens for a pair of ids in 32 bits")
        # a token as it is listed: the ids of a group by commas, A's and B's by a bar, groups by a semicolon
        kinds = [(self.sizes[0], b","), (self.sizes[0], b"|"), (self.sizes[1], b","), (self.sizes[1], b";")]
        self.shown = np.array([str(i).encode() + mark for size, mark in kinds for i in range(size)], object)
        self.kind_at = np.cumsum([0] + [size for size, _ in kinds])

    def ends(self, side: int, ids: np.ndarray, start: int = 0) -> np.ndarray:
        return start + np.cumsum(self.lengths[side][ids])

    def same(self, side: int, ids: np.ndarray, data: bytes) -> bool:
        """Whether the tokens' bytes are the text's."""
        return b"".join(map(self.sides[side].bytes_of.__getitem__, ids.tolist())) == data

    def closed(self, ids: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], start: int) -> Closed:
        """Groups and links of tokens that begin together at byte ``start`` and end together."""
        if not len(ids[0]):
            return Closed.none()
        # which kinds of token end at each byte
        marks = np.zeros(int(ends[0][-1]) - start + 1, np.uint8)
        at = tuple(e - start for e in ends)
        marks[at[0]] |= 1
        marks[at[1]] |= 2
        cut = marks == 3
        places = np.flatnonzero(marks)
        kinds = marks[places]
        before = tuple(np.cumsum((kinds & k) > 0) - ((kinds & k) > 0) for k in (1, 2))
        codes = ids[0][before[0]].astype(np.int64) * self.sizes[1] + ids[1][before[1]]
        group_ends = np.flatnonzero(cut)
        last = tuple(cut[a] for a in at)
        group = tuple(np.cumsum(x) - x for x in last)  # the group of each token
        upto = tuple(np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(group_ends))))) for g in group)
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + upto[1][group[0]]] = ids[0] + np.where(last[0], self.kind_at[1], self.kind_at[0])
        order[np.arange(len(ids[1])) + upto[0][group[1] + 1]] = ids[1] + np.where(last[1], self.kind_at[3], self.kind_at[2])
        return Closed(group_ends + start, places + start, codes, order, upto)

    def show(self, order: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3`` of the groups of a listing."""
        return b"".join(self.shown[order].tolist())[:-1]


@dataclass
class Closed:
    """Closed groups: their end bytes, the end byte and the pair of each link, the tokens in listing order, and how many
    tokens of each kind stand in the groups before each."""

    group_ends: np.ndarray
    link_ends: np.ndarray
    codes: np.ndarray
    order: np.ndarray
    upto: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def none() -> Closed:
        zero = np.zeros(0, np.int64)
        return Closed(zero, zero, zero, zero, (zero, zero))


@dataclass
class Fragment:
    """Tokens of a byte range that are not in closed groups, as ``end * 2**20 + id``, each kind ascending.

    ``bound``: the range holds a common end. If not, all its tokens are in ``head``. ``ok``: the tokens' bytes are the
    text's.
    """

    ok: bool
    bound: bool
    head: tuple[np.ndarray, np.ndarray]
    tail: tuple[np.ndarray, np.ndarray]


def split_tokens(tokens: tuple[np.ndarray, np.ndarray], bound: bool) -> tuple[bool, tuple, tuple, tuple]:
    """Whether there is a common end, and the tokens up to the first one, up to the last one, and after it. With
    ``bound`` the stretch begins at a common end, so nothing is left open before it."""
    common = np.intersect1d(tokens[0] >> _ID_BITS, tokens[1] >> _ID_BITS, assume_unique=True)
    none = tuple(t[:0] for t in tokens)
    if not len(common):
        return (True, none, none, tokens) if bound else (False, tokens, none, none)
    first = [0, 0] if bound else [int(np.searchsorted(t >> _ID_BITS, common[0], "right")) for t in tokens]
    last = [int(np.searchsorted(t >> _ID_BITS, common[-1], "right")) for t in tokens]
    return (
        True,
        tuple(t[:f] for t, f in zip(tokens, first)),
        tuple(t[f:e] for t, f, e in zip(tokens, first, last)),
        tuple(t[e:] for t, e in zip(tokens, last)),
    )


def fragment(tokens: tuple[np.ndarray, np.ndarray], ok: bool, first: bool) -> tuple[Fragment, tuple]:
    """The fragment of a range's tokens, and the tokens of its closed groups. The first range begins at a common end."""
    bound, head, middle, tail = split_tokens(tokens, first)
    return Fragment(ok, bound, head, tail), middle


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple]:
    """The fragment of two neighbouring ranges, and the tokens of the groups that close where they meet."""
    open_left = left.tail if left.bound else left.head
    between = tuple(np.concatenate((a, b)) for a, b in zip(open_left, right.head))
    bound, head, middle, tail = split_tokens(between, left.bound)
    return (
        Fragment(left.ok and right.ok, bound or right.bound, left.head if left.bound else head, right.tail if right.bound else tail),
        middle,
    )


_loaded: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    """Both tokenizers, loaded once per Python worker."""
    key = (path_a, path_b)
    if key not in _loaded:
        _loaded[key] = Aligner(*key)
    return _loaded[key]


# -- tables ------------------------------------------------------------------------------------------------------
#: Counts of a row; its listing's digest or, of a part of a long text, the listing; its links as pairs and how often each
#: stands there (unsigned 32-bit, ascending by pair).
ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, listed binary, pairs binary, times binary"
_ROW = pa.schema([
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("listed", pa.binary()), ("pairs", pa.binary()), ("times", pa.binary()),
])
_ENDS = "head_a binary, head_b binary, tail_a binary, tail_b binary"


def _tallied(codes: np.ndarray) -> tuple[bytes, bytes]:
    pairs, times = np.unique(codes, return_counts=True)
    return pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes()


def align_batch(model: Aligner, texts: list[str | None], digest: bool = True) -> list[tuple]:
    """A ``ROW`` for each whole text."""
    blank = (0, 0, 0, 0, None, b"", b"")
    out: list[tuple] = [blank] * len(texts)
    rows = [i for i, t in enumerate(texts) if t]
    at = 0
    while at < len(rows):
        taken, size = [], 0
        while at < len(rows) and (not taken or size < PASS_BYTES):
            taken.append(rows[at])
            size += len(texts[rows[at]])
            at += 1
        own = [texts[i] for i in taken]
        found = tuple(side.encode(own) for side in model.sides)
        good, ids, ends = [], ([], []), []
        total = 0
        for i, text, a, b in zip(taken, own, *found):
            data = b" " + text.encode()
            if model.same(0, a, data) and model.same(1, b, data):
                good.append(i)
                ids[0].append(a)
                ids[1].append(b)
                total += len(data)
                ends.append(total)
        if not good:
            continue
        joined = tuple(np.concatenate(x).astype(np.int64) for x in ids)
        closed = model.closed(joined, tuple(model.ends(s, x) for s, x in enumerate(joined)), 0)
        groups = np.searchsorted(closed.group_ends, ends, "right")
        links = np.searchsorted(closed.link_ends, ends, "right")
        # one sort for all texts: the text's place, then the pair
        keyed, times = np.unique((np.repeat(np.arange(len(good)), np.diff(links, prepend=0)) << 32) + closed.codes, return_counts=True)
        cuts = np.searchsorted(keyed, (np.arange(len(good)) + 1) << 32)
        keyed = (keyed & 0xFFFFFFFF).astype("<u4")
        times = times.astype("<u4")
        group_at = link_at = pair_at = token_at = 0
        for k, i in enumerate(good):
            n_a, n_b = len(ids[0][k]), len(ids[1][k])
            listed = model.show(closed.order[token_at : token_at + n_a + n_b])
            if digest:
                listed = hashlib.sha256(listed).digest()
            out[i] = (
                n_a, n_b, int(groups[k]) - group_at, int(links[k]) - link_at, listed,
                keyed[pair_at : cuts[k]].tobytes(), times[pair_at : cuts[k]].tobytes(),
            )
            group_at, link_at, pair_at, token_at = int(groups[k]), int(links[k]), int(cuts[k]), token_at + n_a + n_b
    return out


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ROW.types)]


def _short(docs: DataFrame, paths: tuple[str, str], digest: bool) -> DataFrame:
    """Texts that one task aligns whole: the columns of ``docs`` but for the text, and those of ``ROW``."""

    def make():
        model = load(*paths)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            rows = align_batch(model, batch.column(at).to_pylist(), digest)
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "text"]
            return pa.RecordBatch.from_arrays([*(c for _, c in others), *_columns(rows)], [*(n for n, _ in others), *_ROW.names])

        return run

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.drop("text").schema.fields)
    return arrow_map(docs, make, kept + ROW)


def _ranges(model: Aligner, text: str) -> Iterator[tuple[int, str, int, int, int, int, int]]:
    """The ranges of a text with a space before it: number, the stretch that holds both kinds' tokens, its first byte, and
    where in it each kind begins and ends."""
    text = " " + text
    at, k, byte, known = (0, 0), 0, 0, 0
    while at != (len(text),) * 2:
        nominal = (k + 1) * RANGE
        nxt = tuple(max(a, side.cut(text, nominal)) if nominal < len(text) else len(text) for a, side in zip(at, model.sides))
        own = [(a, n) for a, n in zip(at, nxt) if a < n]  # a kind may have no tokens here, after a long one
        if own:
            low, high = min(own)[0], max(n for _, n in own)
            spans = [x - low if a < n else 0 for a, n in zip(at, nxt) for x in (a, n)]
            if low >= known:
                byte += len(text[known:low].encode())
            else:
                byte -= len(text[low:known].encode())
            known = low
            yield k, text[low:high], byte, *spans
        at, k = nxt, k + 1


def _cut(long: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """A row per range of each text."""
    schema = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("part", pa.string()), ("byte", pa.int64()), *((n, pa.int64()) for n in ("a0", "a1", "b0", "b1"))])

    def make():
        model = load(*paths)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(row, *r) for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in _ranges(model, text)]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate(schema.types)], schema=schema)

        return run

    return arrow_map(long.select("row", "text"), make, "row bigint, k bigint, part string, byte bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint")


#: A step's rows: ``piece`` rows hold closed groups, the others a fragment.
_STEP = f"row bigint, k bigint, piece boolean, start bigint, ok boolean, bound boolean, {_ENDS}, {ROW}"
_STEP_ARROW = pa.schema([
    ("row", pa.int64()), ("k", pa.int64()), ("piece", pa.bool_()), ("start", pa.int64()), ("ok", pa.bool_()), ("bound", pa.bool_()),
    *((n, pa.binary()) for n in ("head_a", "head_b", "tail_a", "tail_b")), *_ROW,
])


def _step_rows(model: Aligner, row: int, k: int, whole: Fragment, closed: list[tuple], counts: tuple[int, int]) -> list[tuple]:
    """The rows of one fragment and of the groups closed on the way to it."""
    ends = [x.astype("<i8").tobytes() for x in (*whole.head, *whole.tail)]
    out = [(row, k, False, None, whole.ok, whole.bound, *ends, *counts, 0, 0, None, None, None)]
    for tokens in closed:
        if len(tokens[0]):
            start = int(tokens[0][0] >> _ID_BITS) - int(model.lengths[0][tokens[0][0] & _ID_MASK])
            found = model.closed(tuple(t & _ID_MASK for t in tokens), tuple(t >> _ID_BITS for t in tokens), start)
            out.append((row, k, True, start, None, None, None, None, None, None, 0, 0, len(found.group_ends), len(found.codes), model.show(found.order), *_tallied(found.codes)))
    return out


def _step_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_STEP_ARROW.types)], schema=_STEP_ARROW)


def _fragments(ranges: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each range's fragment and closed groups."""

    def make():
        model = load(*paths)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for row, k, part, byte, *cuts in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, ok = [], True
                for side in (0, 1):
                    low, high = cuts[2 * side : 2 * side + 2]
                    own = part[low:high]
                    ids = model.sides[side].encode_range(own).astype(np.int64) if own else np.zeros(0, np.int64)
                    ok = ok and model.same(side, ids, own.encode())
                    tokens.append((model.ends(side, ids, byte + len(part[:low].encode())) << _ID_BITS) + ids)
                counts = (len(tokens[0]), len(tokens[1]))
                if not ok:  # the text has no tokens, so neither have its fragments
                    tokens = [t[:0] for t in tokens]
                whole, closed = fragment(tuple(tokens), ok, k == 0)
                out += _step_rows(model, row, k, whole, [closed], counts)
            return _step_batch(out)

        return run

    return arrow_map(ranges, make, _STEP)


def _composed(fragments: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One level of the tree: ``FAN`` neighbouring fragments become one."""

    def run(table: pa.Table) -> pa.Table:
        model = load(*paths)
        rows = sorted(zip(*(table.column(n).to_pylist() for n in ("k", "ok", "bound", "head_a", "head_b", "tail_a", "tail_b", "row"))))
        parts = [Fragment(ok, bound, tuple(np.frombuffer(x, "<i8") for x in ends[:2]), tuple(np.frombuffer(x, "<i8") for x in ends[2:4])) for _, ok, bound, *ends in rows]
        whole, closed = parts[0], []
        for part in parts[1:]:
            whole, middle = compose(whole, part)
            closed.append(middle)
        return pa.Table.from_batches([_step_batch(_step_rows(model, rows[0][-1], rows[0][0] // FAN, whole, closed, (0, 0)))])

    names = ["row", "k", "ok", "bound", "head_a", "head_b", "tail_a", "tail_b"]
    return fragments.select(*names).groupBy("row", F.expr(f"k div {FAN}")).applyInArrow(run, _STEP)


def _put(df: DataFrame, name: str) -> DataFrame:
    """A written table of mostly binary columns, compressed more tightly than usual."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _long(long: DataFrame, paths: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Parts of cut texts (``row``, ``start``, ``ROW``), and per text its ``row``, ``n_a`` and ``n_b`` (texts with tokens only).

    A level of the tree reads the level before from a written table, so a lost executor repeats one level only.
    """
    ranges = written(_cut(long, paths).repartition("row", "k"), "ranges")
    level = _put(_fragments(ranges, paths), "fragments")
    counts = level.where("not piece").groupBy("row").agg(F.min("ok").alias("ok"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    good = written(counts.where("ok").select("row", "n_a", "n_b"), "cut-texts")
    pieces = level.where("piece")
    while (level.where("not piece").agg(F.max("k")).first()[0] or 0) > 0:
        level = _put(_composed(level.where("not piece"), paths), "composed")
        pieces = pieces.unionByName(level.where("piece"))
    names = [f.split()[0] for f in ROW.split(", ")]
    return pieces.join(good.select("row"), "row", "left_semi").select("row", "start", *names), good


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair``, ``n``: how many links hold each pair of ids, from the columns ``pairs`` and ``times``.

    Each task adds up its rows first, so what is shuffled are distinct pairs per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def add_up() -> tuple[np.ndarray, np.ndarray]:
            pairs = np.concatenate([p for p, _ in held])
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            times = np.concatenate([t for _, t in held])[order]
            firsts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            return pairs[firsts], np.add.reduceat(times, firsts)

        def batch(pairs: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(times)], ["pair", "n"])

        for found in batches:
            pairs, times = (np.frombuffer(b"".join(x or b"" for x in c.to_pylist()), "<u4") for c in found.columns)
            if not len(pairs):
                continue
            held.append((pairs, times.astype(np.int64)))
            size += len(pairs)
            if size > HELD_PAIRS:
                summed = add_up()
                held, size = [summed], len(summed[0])
                if size > HELD_PAIRS // 2:
                    yield batch(*summed)
                    held, size = [], 0
        if held:
            yield batch(*add_up())

    return links.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


_tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _lookup(uri: str, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, their counts, and each B id's highest count, from a written table; a worker keeps the last one."""
    if uri not in _tables:
        system, path = store(uri)
        found = pq.read_table(path, filesystem=system, columns=["pair", "n"])
        pairs, n = found.column("pair").to_numpy(), found.column("n").to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        best = np.zeros(size_b, np.int64)
        np.maximum.at(best, pairs % size_b, n)
        _tables.clear()
        _tables[uri] = pairs.astype(np.uint32), n, best
    return _tables[uri]


def _scored(rows: DataFrame, counts: DataFrame, uri: str, size_b: int, lookup_pairs: int) -> DataFrame:
    """``rows`` (``place`` and further columns) without the links, but with ``n_best`` and ``count_sum``."""
    kept = [c for c in rows.columns if c not in ("pairs", "times", "listed")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    if counts.count() <= lookup_pairs:

        def make():
            pairs, n, best = _lookup(uri, size_b)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                own, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pairs", "times"))
                n_best, total = [], []
                for p, t in zip(own, times):
                    codes, t = np.frombuffer(p or b"", "<u4"), np.frombuffer(t or b"", "<u4").astype(np.int64)
                    found = n[np.searchsorted(pairs, codes)]
                    n_best.append(int(t[found == best[codes % size_b]].sum()))
                    total.append(int((t * found).sum()))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                return pa.RecordBatch.from_arrays([*columns, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], [*kept, "n_best", "count_sum"])

            return run

        return arrow_map(rows.select(*kept, "pairs", "times"), make, f"{types}, n_best bigint, count_sum bigint")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()]
            times = b"".join(x or b"" for x in batch.column(2).to_pylist())
            place = np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            pairs = np.concatenate(own) if own else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(pairs.astype(np.int64)), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], ["place", "pair", "t"])

    best = counts.groupBy(F.expr(f"pair % {size_b}").alias("b")).agg(F.max("n").alias("best"))
    known = written(counts.join(best, F.expr(f"pair % {size_b}") == F.col("b")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best")), "pair-ranks")
    links = rows.select("place", "pairs", "times").mapInArrow(spell, "place bigint, pair bigint, t bigint")
    sums = links.join(known, "pair").groupBy("place").agg(F.sum(F.when(F.col("is_best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n")).alias("count_sum"))
    return rows.select(*kept).join(sums, "place", "left").fillna(0, ["n_best", "count_sum"])


def _hashed(parts: DataFrame) -> DataFrame:
    """``row`` and the digest of its parts in order: rows stream through a task one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows, digests = [], []
            for row, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if row != now:
                    if state is not None:
                        rows.append(now)
                        digests.append(state.digest())
                    now, state = row, hashlib.sha256()
                else:
                    state.update(b";")
                state.update(listed)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(digests, pa.binary())], ["row", "listed"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.digest()], pa.binary())], ["row", "listed"])

    ordered = parts.select("row", "start", "listed").repartition("row").sortWithinPartitions("row", "start")
    return ordered.select("row", "listed").mapInArrow(run, "row bigint, listed binary")


def _parted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows aligned whole, and those that are cut, which get a ``row`` number and stand in a written table."""
    frame = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    long = F.coalesce(F.octet_length("text") > LONG, F.lit(False))
    return frame.where(~long), written(frame.where(long).withColumn("row", F.monotonically_increasing_id()), "long-texts")


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups themselves: ``doc_id``, ``start`` (byte of the text with a space before it), ``listed``, which spells ids
    as ``a1,a2|b1;a3|b2,b3``. A text up to ``LONG`` bytes has one row, a longer one several that follow each other.

    Texts without tokens (see ``align``) have no rows. Repeated ids are kept apart only by their order of rows.
    """
    paths = (path_a, path_b)
    short, long = _parted(docs)
    pieces, _ = _long(long, paths)
    whole = _short(short, paths, digest=False).where("listed is not null").selectExpr("doc_id", "0L start", "cast(listed as string) listed")
    return whole.unionByName(pieces.join(long.select("row", "doc_id"), "row").selectExpr("doc_id", "start", "cast(listed as string) listed"))


def align(docs: DataFrame, path_a: str, path_b: str, lookup_pairs: int = LOOKUP_PAIRS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``path_a`` names a byte-level BPE file, ``path_b`` a sentencepiece one. A pair's count is the number of links of
    all rows that hold it; ``n_best`` counts links whose pair is the most frequent of its B id (ties included).
    Null and empty texts, and texts that a tokenizer does not keep as they are, have zeros and an empty digest, and
    their links count nowhere. Rows with the same id or text count as often as they stand there; a null id stays null.
    Further columns are left out.

    Texts are encoded once; the links are written as sorted pairs per text. Counts of up to ``lookup_pairs`` pairs are
    read by every worker as a table, more are joined.
    """
    spark: SparkSession = docs.sparkSession
    paths = (path_a, path_b)
    size_b = len(PieceSide(path_b).bytes_of)
    short, long = _parted(docs)
    names = [f.split()[0] for f in ROW.split(", ")]
    place = F.monotonically_increasing_id()
    whole = _put(_short(short, paths, digest=True).withColumn("place", place), "alignments")
    pieces, good = _long(long, paths)
    pieces = _put(pieces.withColumn("place", place), "pieces")
    uri = scratch_path(spark, "llm-pair-counts")
    pair_counts(whole.select(*names).unionByName(pieces.select(*names))).write.parquet(uri)
    counts = spark.read.schema("pair bigint, n bigint").parquet(uri)
    scored = _scored(whole.withColumn("hex", F.coalesce(F.lower(F.hex("listed")), F.lit(""))), counts, uri, size_b, lookup_pairs)
    sums = (
        _scored(pieces.drop("start"), counts, uri, size_b, lookup_pairs)
        .groupBy("row")
        .agg(*(F.sum(c).alias(c) for c in ("n_groups", "n_links", "n_best", "count_sum")))
    )
    cut = long.select("row", "doc_id").join(good, "row", "left").join(sums, "row", "left").join(_hashed(pieces), "row", "left")
    out = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    cut = cut.fillna(0, out).withColumn("hex", F.coalesce(F.lower(F.hex("listed")), F.lit("")))
    return scored.select("doc_id", *out, F.col("hex").alias("groups_sha256")).unionByName(cut.select("doc_id", *out, F.col("hex").alias("groups_sha256")))
