"""Stretches of words that repeat with a short period, and texts without the repeats.

A run of period ``q`` that begins at word ``i`` is a pair of equal stretches at ``i`` and ``i + q`` that can be made longer
neither to the right nor to the left: a *maximal pair*. Its length is the run's less ``q``, so a bound on the run's length
is a bound on the distance of the pair, and every maximal pair within that bound is a run; nothing is extended word by word.

Maximal pairs come from the tree of LCP intervals over the text's suffixes, built bottom up. An interval is the list of
places where a stretch stands, each with the class of its left word. When two children of an interval meet, their
places are pairs that agree for exactly the interval's length, and those with different left words are maximal. Only
neighbouring places have to be compared: if the stretch also stood between ``i`` and ``i + q``, it would have a shorter
period that divides ``q`` (as it is at least twice as long as ``q``), and so would the run. The smaller list is dealt into
the larger one, so a text of n words costs O(n log n) look-ups. Pairs at several periods' distance are the same run; the
smallest distance is its period.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.frames import arrow_map


@dataclass(frozen=True)
class RunRules:
    """A run has at least ``least`` words and ``times`` periods (three or more)."""

    least: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 3 or self.least < 2:
            raise ValueError("runs of under three periods or two words are not supported")

    def fits(self, same: int, distance: int) -> bool:
        """Whether a pair that agrees for ``same`` words at this distance is long enough for a run."""
        return same + distance >= self.least and same >= (self.times - 1) * distance

    @property
    def shortest(self) -> int:
        """Words that any such pair agrees for."""
        return min(max(self.least - q, (self.times - 1) * q) for q in range(1, self.least + 1))


_ODD = np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def may_repeat(words: list[bytes], size: int) -> bool:
    """Whether some stretch of ``size`` words may stand twice; never wrong if it says no."""
    count = len(words) - size + 1
    if count < 2:
        return False
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = hashes ^ (hashes >> np.uint64(31))
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total += hashes[j : j + count] * _ODD[j % 64]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the text's suffixes in order, and how many words each has in common with the one before.

    Ranks of stretches of 1, 2, 4, ... words, each from two of the length before; the end ranks lowest.
    """
    size = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    width = 1
    while int(ranks[-1].max()) + 1 < size:
        now = ranks[-1]
        second = np.zeros(size, np.int64)
        second[: size - width] = now[width:] + 1
        ranks.append(np.unique(now * (size + 1) + second, return_inverse=True)[1].astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1])
    left, right = order[:-1], order[1:]
    same = np.zeros(max(size - 1, 0), np.int64)
    for level in range(len(ranks) - 2, -1, -1):  # equal ranks are equal stretches of full length
        rank = np.append(ranks[level], -1)
        same += np.where(rank[left + same] == rank[right + same], 1 << level, 0)
    return order, np.concatenate(([0], same))


def find_runs(words: list[bytes], rules: RunRules = RunRules()) -> list[tuple[int, int, int]]:
    """All runs as (first word, length, smallest period), by first word, then period."""
    shortest = rules.shortest
    if len(words) < rules.least or not may_repeat(words, shortest):
        return []
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    order, same = suffixes(np.array(ids, np.int64))
    classes = [-1, *ids]  # the left word of each place
    found: dict[tuple[int, int], int] = {}

    def meet(one: list[int], other: list[int], length: int) -> list[int]:
        """The places of two children of an interval, after their maximal pairs are noted."""
        small, large = (one, other) if len(one) < len(other) else (other, one)
        for place in small:
            at = bisect_left(large, place)
            for neighbour in large[max(at - 1, 0) : at + 1]:
                if classes[neighbour] != classes[place]:
                    first, distance = min(place, neighbour), abs(place - neighbour)
                    if rules.fits(length, distance):
                        key = (first, length + distance)
                        found[key] = min(found.get(key, distance), distance)
        if 8 * len(small) < len(large):
            for place in small:
                insort(large, place)
            return large
        return sorted(large + small)

    open_: list[tuple[int, list[int]]] = []  # intervals from the outermost in
    lengths = same.tolist()
    for at, place in enumerate(order.tolist()):
        length = lengths[at + 1] if at + 1 < len(lengths) else -1
        node = [place]
        if length < shortest and not open_:
            continue
        while open_ and open_[-1][0] > length:
            outer, places = open_.pop()
            node = meet(places, node, outer)
        if open_ and open_[-1][0] == length:
            outer, places = open_.pop()
            open_.append((outer, meet(places, node, outer)))
        elif length >= shortest:
            open_.append((length, node))
    return sorted((first, length, period) for (first, length), period in found.items())


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for first, length, period in runs:
        steps[first + period] += 1
        steps[first + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:  # in order, so only a greater one replaces
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NAMES = ["n_words", "runs", "top", "collapsed"]


def _as_rows(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": p} for s, n, p in runs]


def repetitions(df: DataFrame, rules: RunRules = RunRules(), key: str = "doc_id", text: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``df`` without its text, with ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` in words), ``top`` (the
    strongest run, or null) and ``collapsed`` (the words that are left, joined by one space).

    Words are separated by space and \\x09 to \\x0D. Null and empty texts have no words and no runs; ``collapsed`` is then
    empty. Rows are worked on where they are, repeated ones each for itself; columns of ``df`` with the names of results
    are replaced. ``change`` gives the words to look at from the row's ``key`` and its words. A task holds one text's
    ranks at a time, about 8 bytes a word for each doubling of its longest repeat.
    """
    frame = df.drop(*_NAMES)
    others = [c for c in frame.columns if c != text]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index(text)
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            counts, runs, tops, left = [], [], [], []
            for own, value in zip(keys, batch.column(at).to_pylist()):
                words = (value or "").encode().split()  # bytes are split at exactly these six
                words = change(own, words) if change else words
                found = find_runs(words, rules)
                counts.append(len(words))
                runs.append(_as_rows(found))
                best = strongest(found)
                tops.append(_as_rows([best])[0] if best else None)
                left.append(b" ".join(without_repeats(words, found)).decode())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            new = [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(tops, _RUN), pa.array(left, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *new], [*others, *_NAMES])

        return run

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.drop(text).schema.fields)
    one = "struct<start: bigint, length: bigint, period: bigint>"
    return arrow_map(frame, make, f"{kept}n_words bigint, runs array<{one}>, top {one}, collapsed string")
