"""Byte n-grams of texts as numbers, in numpy, and tables that look up many of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: No byte of UTF-8; stands before a text (as context) and after it (as the end symbol).
EDGE = b"\xff"

_PIECE = 1 << 20
#: Symbols that are worked on together.
SLAB = 1 << 21


def _pieces(raw: bytes, depth: int) -> Iterator[bytes]:
    """The text's symbols in parts, each behind the depth - 1 symbols that precede it."""
    whole = EDGE * (depth - 1) + raw + EDGE
    for at in range(depth - 1, len(whole), _PIECE):
        yield whole[at - depth + 1 : at + _PIECE]


def slabs(raws: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """For every symbol of the texts, ends included, the `depth` bytes that end with it as a number. In slabs of
    bounded size: the numbers, where each part of a text starts in them, and the text it is of."""
    streams, of, size = [], [], 0
    for i, raw in enumerate(raws):
        for piece in _pieces(raw, depth):
            streams.append(piece)
            of.append(i)
            size += len(piece)
            if size >= SLAB:
                yield *_paths(streams, depth), of
                streams, of, size = [], [], 0
    if streams:
        yield *_paths(streams, depth), of


def _paths(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    # windows of 8 bytes; the first ends with the first stream's first symbol after its context
    joined = b"\0" * (8 - depth) + b"".join(streams)
    windows = np.ndarray(len(joined) - 7, ">u8", joined, strides=(1,))
    lengths = np.array([len(s) for s in streams], np.int64)
    ends = np.cumsum(lengths)
    inside = np.ones(len(windows), bool)
    for back in range(1, depth):
        inside[ends[:-1] - back] = False  # these would reach from one stream into the next
    found = windows[inside].astype(np.uint64) & mask(depth)
    sizes = lengths - depth + 1
    return found, np.cumsum(sizes) - sizes


def counted(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths and how often each is there."""
    ordered = np.sort(paths)
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    return ordered[last], np.diff(np.append(-1, last))


def mask(length: int) -> np.uint64:
    return np.uint64((1 << 8 * length) - 1)


def key(path: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes of paths, with the length; never 0."""
    return (path & mask(length)) | np.uint64((length + 1) << 56)


class Table:
    """From keys to their places in the array it is made from, by open addressing, for arrays of keys."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        at = self._first(keys)
        while len(left):
            take = left[self.keys[at[left]] == 0]
            self.keys[at[take]] = keys[take]  # of several that want a place one has it
            left_now = self.keys[at[left]] == keys[left]
            done = left[left_now]
            self.places[at[done]] = done
            left = left[~left_now]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' places, -1 for keys that are not there."""
        at = self._first(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.places[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.places[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out
