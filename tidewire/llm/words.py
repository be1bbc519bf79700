"""Words and word windows of many texts at once, as 64-bit hashes, with numpy over UTF-8 bytes.

A word's hash is a polynomial over random byte values with a final mix; a window's hash mixes its words'
hashes with their places. Two different windows meet with probability about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that separate words: space and \x09 to \x0D.
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_table(separators: bytes = SPACES, lower: bool = False) -> np.ndarray:
    """Each byte's value in a word; 0 ends words. ``lower`` maps A-Z to a-z. NUL bytes count as 255, which UTF-8 never has."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    if lower:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts: hash, first and end byte of each, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.firsts[row] : self.firsts[row + 1]]


def scan(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """All words of the texts that ``offsets`` cut from ``data``."""
    mapped = table[data]
    inside = mapped != 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begin[cuts] = inside[cuts]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    end[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, ends, firsts)
    lengths = ends - starts
    heads = np.cumsum(lengths) - lengths
    places = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()), _BASE, np.uint64))))
    values = _BYTE[mapped[inside]] * powers[places]
    return Words(mix(np.add.reduceat(values, heads)), starts, ends, firsts)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    total = np.zeros(count, np.uint64)
    for j in range(width):
        total += words[j : j + count] * _PLACE[j]
    return mix(total + np.uint64(width))
