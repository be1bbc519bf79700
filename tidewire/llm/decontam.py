"""Benchmark decontamination with suffix arrays over the training text.

The training documents are cut into shards (runs of one task's rows). In a shard only words of the benchmark matter:
any other word breaks a match, and a stretch of benchmark words shorter than the shortest window holds none. The
stretches that remain get a suffix array, sorted by prefix doubling as deep as the longest item. Every suffix of every
item is then searched in it by bisection, all at once: the places that begin with the suffix's window give the
hits, and the neighbours of the suffix's own place give its longest verbatim match and where it is.

The benchmark is a query set: it goes over all rows in blocks of bounded size, one block in memory at a time.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.files import new_folder, open_file, write_file
from tidewire.llm.frames import CHUNK_BYTES, arrow_map, runs, short_batches, text_chunks, written

#: Words of a window.
WINDOW = 13
#: Benchmark text in one block.
BLOCK_BYTES = 16 << 20
#: Training text in one shard.
SHARD_BYTES = 4 << 20

# Bytes that separate words, all of ASCII but digits and letters.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TABLE = words.byte_table(SEPARATORS, lower=True)


@dataclass
class Block:
    """Items of the benchmark, as numbers of their words, with every suffix and its window."""

    item_ids: np.ndarray  # of each item; -1 in ``has_id`` marks a null
    has_id: np.ndarray
    known: np.ndarray  # hashes of the words, sorted; a word's number is its place plus 1
    text: np.ndarray  # all items' words, each item followed by a 0
    starts: np.ndarray  # suffixes that begin a window: places in ``text``
    widths: np.ndarray  # words of that window
    owners: np.ndarray  # its item
    left: np.ndarray  # words from each place to the item's end
    item_of: np.ndarray  # item of each place
    shortest: int
    longest: int


def make_block(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> Block:
    column = pa.array([t for _, t in items], pa.string())
    parts: list[np.ndarray] = []
    for first, end, data, offsets in text_chunks(column):
        found = words.scan(data, offsets, TABLE)
        parts += [found.of(i) for i in range(end - first)]
    known = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    text, left, item_of, starts, widths, owners = [], [], [], [], [], []
    at = 0
    for number, part in enumerate(parts):
        n = len(part)
        text += [np.searchsorted(known, part) + 1, [0]]
        left += [np.arange(n, 0, -1), [0]]
        item_of.append(np.full(n + 1, number))
        if n:
            count = max(1, n - window + 1)
            starts.append(at + np.arange(count))
            widths.append(np.full(count, min(n, window)))
            owners.append(np.full(count, number))
        at += n + 1

    def whole(pieces: list) -> np.ndarray:
        return np.concatenate(pieces).astype(np.int64) if pieces else np.zeros(0, np.int64)

    lengths = [len(p) for p in parts if len(p)]
    ids = np.array([i or 0 for i, _ in items], np.int64)
    has = np.array([i is not None for i, _ in items], bool)
    return Block(ids, has, known, whole(text), whole(starts), whole(widths), whole(owners), whole(left), whole(item_of), min([window, *lengths]), max(lengths, default=0))


@dataclass
class SuffixArray:
    """Suffixes of a shard's stretches in order, compared up to a depth. ``text`` ends in enough zeros to read past."""

    text: np.ndarray
    order: np.ndarray
    places: np.ndarray  # word number in the shard of each place of ``text``


def suffix_array(numbers: np.ndarray, places: np.ndarray, depth: int) -> SuffixArray:
    """Prefix doubling: ranks of 1, 2, 4, ... words until all differ or the depth is reached. Zeros are not indexed."""
    n = len(numbers)
    rank = numbers.astype(np.int64)
    step = 1
    while n:
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] if step < n else 0
        if step >= n:
            break
        key = rank * (int(rank.max()) + 1) + ahead
        distinct, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        step *= 2
        if step >= depth or len(distinct) == n:
            break
    order = np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)
    order = order[numbers[order] != 0]
    padded = np.concatenate((numbers, np.zeros(max(depth, 1) + 1, numbers.dtype)))
    return SuffixArray(padded, order, places)


def _compare(index: SuffixArray, at: np.ndarray, block: Block, starts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (``widths`` words from ``starts``) and a suffix each: sign of suffix minus query, equal words."""
    sign = np.zeros(len(at), np.int8)
    same = np.zeros(len(at), np.int64)
    live = np.flatnonzero(widths > 0)
    depth = 0
    while len(live):
        a = index.text[at[live] + depth]
        b = block.text[starts[live] + depth]
        equal = a == b
        sign[live] = np.where(equal, 0, np.where(a < b, -1, 1))
        same[live] += equal
        depth += 1
        live = live[equal & (widths[live] > depth)]
    return sign, same


def bisect(index: SuffixArray, block: Block, starts: np.ndarray, widths: np.ndarray, after: bool) -> np.ndarray:
    """First place in the suffix array whose suffix is not before (or, with ``after``, is behind) each query's words."""
    low = np.zeros(len(starts), np.int64)
    high = np.full(len(starts), len(index.order), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        sign, _ = _compare(index, index.order[middle], block, starts[open_], widths[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = middle[right] + 1
        high[open_[~right]] = middle[~right]


@dataclass
class Shard:
    """A run of documents: words of each, and the suffix array over their benchmark words."""

    firsts: np.ndarray
    index: SuffixArray


def make_shard(data: np.ndarray, offsets: np.ndarray, block: Block, shortest: int | None = None) -> Shard:
    """``shortest``: words a stretch must have to be kept; those of the shortest window if it is not given.

    Words are read a short run of rows at a time: that takes far more memory than their numbers, which are kept."""
    parts, heads = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for rows in runs(offsets, CHUNK_BYTES):
        found = words.scan(data[rows[0] : rows[-1]], rows - rows[0], TABLE)
        own = np.zeros(len(found.hashes), np.int64)
        if len(block.known):
            place = np.minimum(np.searchsorted(block.known, found.hashes), len(block.known) - 1)
            hit = block.known[place] == found.hashes
            own[hit] = place[hit] + 1
        parts.append(own)
        heads.append(found.firsts[1:] + heads[-1][-1])
    numbers, firsts = np.concatenate(parts), np.concatenate(heads)
    # stretches of benchmark words inside one document, at least as long as the shortest window
    inside = numbers != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = firsts[:-1][firsts[:-1] < len(numbers)]
    begin[heads] = inside[heads]
    begins = np.flatnonzero(begin)
    if not len(begins):
        return Shard(firsts, suffix_array(np.zeros(0, np.int64), np.zeros(0, np.int64), block.longest))
    number_of = np.cumsum(begin) - 1
    lengths = np.bincount(number_of[inside], minlength=len(begins))
    long_ = lengths >= (block.shortest if shortest is None else shortest)
    begins, lengths = begins[long_], lengths[long_]
    # copied one after another with a 0 behind each
    ends = np.cumsum(lengths + 1)
    size = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(begins - (ends - lengths - 1), lengths + 1)
    places = np.arange(size) + shift
    kept = np.zeros(size, np.int64)
    body = np.ones(size, bool)
    body[ends - 1] = False
    kept[body] = numbers[places[body]]
    return Shard(firsts, suffix_array(kept, places, block.longest))


def window_hits(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, width and item of every occurrence of a window in the shard."""
    if not len(block.starts) or not len(shard.index.order):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    low = bisect(shard.index, block, block.starts, block.widths, False)
    high = bisect(shard.index, block, block.starts, block.widths, True)
    counts = high - low
    query = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = shard.index.places[shard.index.order[low[query] + inner]]
    return at, block.widths[query], block.owners[query]


def range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each range; no range is empty. Tables of ranges of 1, 2, 4, ... places, two for each answer."""
    out = np.empty(len(low), values.dtype)
    level = np.int64(np.floor(np.log2(np.maximum(high - low, 1))))
    table, k = values, 0
    while len(low):
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
        if k >= level.max(initial=0):
            break
        table, k = np.minimum(table[: -(1 << k)], table[1 << k :]), k + 1
    return out


def longest_matches(shard: Shard, block: Block, row_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix of every item (place in ``block.text``): the most words of it found verbatim, and the place of the
    first such match by the rows' ``row_rank``, then by word."""
    suffixes = np.flatnonzero(block.text != 0)
    best = np.zeros(len(suffixes), np.int64)
    index = shard.index
    if not len(suffixes) or not len(index.order):
        return suffixes, best, np.full(len(suffixes), -1, np.int64)
    widths = block.left[suffixes]
    low = bisect(index, block, suffixes, widths, False)
    for neighbour in (low - 1, low):  # the longest match stands beside the suffix's own place
        ok = (neighbour >= 0) & (neighbour < len(index.order))
        _, same = _compare(index, index.order[np.clip(neighbour, 0, len(index.order) - 1)], block, suffixes, widths)
        best = np.where(ok, np.maximum(best, same), best)
    where = np.full(len(suffixes), -1, np.int64)
    some = np.flatnonzero(best > 0)
    low = bisect(index, block, suffixes[some], best[some], False)
    high = bisect(index, block, suffixes[some], best[some], True)
    # all suffixes that begin with the match, the first of them by row and word
    places = index.places[index.order]
    rows = np.searchsorted(shard.firsts, places, "right") - 1
    keys = (row_rank[rows].astype(np.int64) << 32) + (places - shard.firsts[rows])
    by_rank = np.argsort(row_rank)
    least = range_least(keys, low, high)
    where[some] = shard.firsts[by_rank[least >> 32]] + (least & 0xFFFFFFFF)
    return suffixes, best, where


# -- Spark jobs --------------------------------------------------------------------------------------------------
def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> list[str]:
    """Files with the benchmark's blocks, below the shared folder.

    Items are dealt to blocks by a hash, into twice as many until none has more than ``most`` bytes (or is a single
    item). A task builds a block and writes its file; the driver sees the files' names only.
    """
    items = benchmark.selectExpr("cast(item_id as bigint) item_id", "text").where("text is not null and text <> ''").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count("*")).first()
    count = max(1, -(-size[0] // most))
    mark = F.xxhash64("item_id", "text")
    while count > 1:
        largest = items.groupBy(F.pmod(mark, F.lit(count)).alias("b")).agg(F.sum(F.octet_length("text").cast("bigint")).alias("bytes"), F.countDistinct("text").alias("n"))
        if not largest.where((F.col("bytes") > most) & (F.col("n") > 1)).limit(1).count():
            break
        count *= 2
    folder = new_folder(benchmark.sparkSession, "benchmark")
    if not size[1]:
        return [write_file(folder, "block-none.pickle", pickle.dumps(make_block([], window)))]

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        number = table.column("block")[0].as_py()
        return pa.table({"block": [number], "uri": [write_file(folder, f"block-{number:05d}.pickle", pickle.dumps(make_block(rows, window)))]})

    made = items.withColumn("block", F.pmod(mark, F.lit(count))).groupBy("block").applyInArrow(build, "block bigint, uri string")
    return [r["uri"] for r in written(made, "benchmark-blocks").orderBy("block").collect()]


_held: dict[str, Block] = {}


def load_block(uri: str) -> Block:
    """A block from its file; a worker keeps the last one only."""
    if uri not in _held:
        with open_file(uri) as file:
            block = pickle.loads(file.read())
        _held.clear()
        _held[uri] = block
    return _held[uri]


NEW = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"]


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``item_ids`` (items with an
    occurring window, sorted as strings), ``n_items``, ``items_sha256`` and ``contaminated`` (a twentieth of the
    words or more is hit).

    Every row is kept and stays where it is; nothing is shuffled or joined. Null and empty texts have no words and
    are clean. Null or empty items have no windows; an item without an id hits but is not listed; repeated items
    count once. Columns of ``docs`` with the names of results are replaced.
    """
    files = blocks(benchmark, window)
    frame = docs.drop(*NEW)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(batch.schema.get_field_index("text"))
            n_words, n_hit, listed = [], [], []
            for first, end, data, offsets in text_chunks(column, SHARD_BYTES):
                marks = firsts = None
                pairs: list[np.ndarray] = []
                for uri in files:
                    block = load_block(uri)
                    shard = make_shard(data, offsets, block)
                    firsts = shard.firsts
                    if marks is None:
                        marks = np.zeros(int(firsts[-1]) + 1, np.int64)
                    at, width, item = window_hits(shard, block)
                    if len(at):
                        np.add.at(marks, at, 1)
                        np.add.at(marks, at + width, -1)
                        rows = np.searchsorted(firsts, at, "right") - 1
                        found = np.unique(np.stack((rows, item), 1), axis=0)
                        found = found[block.has_id[found[:, 1]]]
                        pairs.append(np.stack((found[:, 0], block.item_ids[found[:, 1]]), 1))
                hit = np.concatenate(([0], np.cumsum(np.cumsum(marks[:-1]) > 0)))
                n_words += np.diff(firsts).tolist()
                n_hit += (hit[firsts[1:]] - hit[firsts[:-1]]).tolist()
                own: list[list[int]] = [[] for _ in range(end - first)]
                if pairs:
                    for row, item_id in np.unique(np.concatenate(pairs), axis=0).tolist():
                        own[row].append(item_id)
                listed += [sorted(x, key=str) for x in own]
            columns = [
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in listed], pa.int64()),
                pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in listed], pa.string()),
                pa.array([h > 0 and 20 * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
                pa.array(listed, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *NEW])

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return arrow_map(frame, make, f"{kept}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, item_ids array<bigint>")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every suffix of every item its longest verbatim match in all documents: ``item_id``, ``item_word``,
    ``n_words``, ``doc_id``, ``doc_word`` (of equally long ones the smallest ``doc_id``, null last, and place).

    Suffixes whose first word no document has are left out, as are null and empty items and texts; repeated items count
    once, rows that repeat a ``doc_id`` are told apart by their words only. Each shard sends one row per suffix found; maxima
    are combined within tasks."""
    files = blocks(benchmark, window)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    names = ["item_id", "item_word", "n_words", "doc_id", "doc_word"]
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, end, data, offsets in text_chunks(batch.column(1), SHARD_BYTES):
                own = ids[first:end]
                order = sorted(range(len(own)), key=lambda i: (own[i] is None, own[i] or 0, i))
                rank = np.empty(len(own), np.int64)
                rank[order] = np.arange(len(own))
                for uri in files:
                    block = load_block(uri)
                    shard = make_shard(data, offsets, block, 1)
                    suffix, length, at = longest_matches(shard, block, rank)
                    ok = length > 0
                    suffix, length, at = suffix[ok], length[ok], at[ok]
                    if not len(suffix):
                        continue
                    doc = np.searchsorted(shard.firsts, at, "right") - 1
                    item = block.item_of[suffix]
                    begins = np.searchsorted(block.item_of, item)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(i) if h else None for i, h in zip(block.item_ids[item], block.has_id[item])], pa.int64()),
                            pa.array(suffix - begins, pa.int64()),
                            pa.array(length, pa.int64()),
                            pa.array([own[int(d)] for d in doc], pa.int64()),
                            pa.array(at - shard.firsts[doc], pa.int64()),
                        ],
                        names,
                    )

    found = rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    best = F.struct((-F.col("n_words")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_word")
    top = found.groupBy("item_id", "item_word").agg(F.min(best).alias("top"))
    return top.select("item_id", "item_word", (-F.col("top.less")).alias("n_words"), "top.doc_id", "top.doc_word")


def longest_per_item(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per item with a word in some document: the longest verbatim match of any of its suffixes, and where it is in the
    item and in the documents (the first of equally long ones by item word, ``doc_id`` and place)."""
    found = matches(docs, benchmark)
    best = F.struct((-F.col("n_words")).alias("less"), "item_word", F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_word")
    top = found.groupBy("item_id").agg(F.min(best).alias("top"))
    return top.select("item_id", "top.item_word", (-F.col("top.less")).alias("n_words"), "top.doc_id", "top.doc_word")
