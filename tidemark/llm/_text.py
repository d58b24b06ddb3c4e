"""Vectorised word kernel: Arrow string batches to word positions and names.

Works on UTF-8 bytes, a few megabytes at a time. Within a chunk words are numbered by
their bytes, exactly. A name is a 64-bit digest of a word's bytes, the same on every
executor; names of ranges are polynomials over such symbols. Names choose candidates;
the operators confirm what they find on words, bytes or 128-bit digests of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_P = int(_rng.integers(1, 2**62)) * 2 + 1
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts together, and where each begins (one more entry than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def digest(data) -> bytes:
    """128-bit digest that stands for a byte string wherever the string itself doesn't travel."""
    return blake2b(data, digest_size=16).digest()


def digests(strings: list[bytes]) -> np.ndarray:
    """(n, 2): the digests of byte strings as two integers each."""
    return np.frombuffer(b"".join(map(digest, strings)), np.uint64).reshape(-1, 2)


class Words:
    """Words of a chunk. start, end: byte positions; first: index of each text's first word (one more entry than texts)."""

    __slots__ = ("data", "end", "first", "inside", "off", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, kind: np.ndarray):
        self.data, self.off = data, off
        self.inside = inside = kind[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edges = off[:-1][off[:-1] < len(data)]
            before[edges] = False
            edges = off[1:][off[1:] > 0] - 1
            after[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word within the chunk, and the distinct words by number."""
        off = np.zeros(len(self.start) + 1, np.int64)
        np.cumsum(self.end - self.start, out=off[1:])
        held = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(off), pa.py_buffer(self.data[self.inside])]).dictionary_encode()
        return np.asarray(held.indices).astype(np.int64), held.dictionary.to_pylist()

    def names(self) -> np.ndarray:
        """64-bit name of each word."""
        ids, words = self.encoded()
        return digests(words)[ids, 0]

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' bytes with one space behind each, and where each begins and ends there."""
        length = self.end - self.start
        end = np.cumsum(length) + np.arange(len(length))
        out = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        letters = np.ones(len(out), bool)
        letters[end] = False
        out[letters] = self.data[self.inside]
        return out, end - length, end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def prefix_sums(symbols: np.ndarray, base: int = _P) -> np.ndarray:
    """Sums s with s[i] = symbols[0] + symbols[1] * base + ... (mod 2**64), one more entry than symbols."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * _powers_of(base, len(symbols)), out=out[1:])
    return out


def range_names(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = _PINV) -> np.ndarray:
    """Name of each range of symbols, the same wherever the range stands."""
    return mix((sums[end] - sums[start]) * _powers_of(inverse, len(sums))[start] + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def owner(first: np.ndarray) -> np.ndarray:
    """Text number of each item, from where each text's items begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def lengths_left(first: np.ndarray) -> np.ndarray:
    """For each item the number of items from it to the end of its text."""
    n = int(first[-1])
    return np.repeat(first[1:], np.diff(first)) - np.arange(n)


def chained(columns: np.ndarray) -> np.ndarray:
    """Name of each row of symbols."""
    h = np.zeros(len(columns), np.uint64)
    for j in range(columns.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + columns[:, j].astype(np.uint64))
    return h


def row_numbers(columns: np.ndarray) -> np.ndarray:
    """A number for each row of small non-negative integers, the same for equal rows alone."""
    out = np.zeros(len(columns), np.int64)
    for j in range(columns.shape[1]):
        column = columns[:, j]
        out = pd.factorize(out * (int(column.max(initial=0)) + 1) + column)[0].astype(np.int64)
    return out


def first_seen(numbers: np.ndarray) -> np.ndarray:
    """Where each value occurs for the first time."""
    top = np.maximum.accumulate(pd.factorize(numbers)[0])
    return np.flatnonzero(np.concatenate([[True], top[1:] > top[:-1]])) if len(top) else top
