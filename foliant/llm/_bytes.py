"""Vectorised work on UTF-8 texts: slices of bounded size, word bounds, and hashes of byte and word ranges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(20260105).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: The most rows in a slice.
_MOST = 60_000
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]

#: Words are maximal runs of bytes other than the six white-space characters of ASCII.
WORD = np.ones(256, bool)
WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Lower-case A-Z, leaving other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array of strings or binaries, nulls as empty; offsets start at 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    if texts.null_count:
        texts = texts.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off - off[0], raw


def slices(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have about limit bytes together (one longer text stands alone)."""
    for batch in batches:
        sizes = np.diff(buffers(batch.column(name))[0])
        ends = np.cumsum(sizes)
        i = 0
        while i < len(sizes):
            before = ends[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(ends, before + limit, "right"))), i + _MOST)
            yield batch.slice(i, j - i)
            i = j


def gathered(batches: Iterable[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Like slices(), but small batches are first put together."""
    kept: list[pa.RecordBatch] = []
    size = rows = 0
    for b in slices(batches, name, limit):
        n = int(buffers(b.column(name))[0][-1])
        if kept and (size + n > limit or rows + b.num_rows > _MOST):
            yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept, size, rows = [], 0, 0
        if b.num_rows:
            kept.append(b)
            size += n
            rows += b.num_rows
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n + n // 4 + 2, base, U)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


class Ranges:
    """64-bit hashes of any ranges of a byte array, each from two prefix sums."""

    def __init__(self, data: np.ndarray):
        p, self._inverse = _power(len(data))
        self._sums = np.zeros(len(data) + 1, U)
        np.cumsum(_TABLE[data] * p[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(U))

    def grams(self, q: int) -> np.ndarray:
        """Unmixed hashes of all q-byte ranges, by start."""
        n = len(self._sums) - q
        return (self._sums[q:] - self._sums[:n]) * self._inverse[:n] if n > 0 else np.zeros(0, U)


def word_bounds(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words' byte ranges in order, and for each text the index of its first word (one more at the end)."""
    w = is_word[data]
    if not len(w):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inner = offsets[(offsets > 0) & (offsets < len(w))]
    edge = np.empty(len(w), bool)
    edge[0] = True
    edge[1:] = ~w[:-1]
    edge[inner] = True
    starts = np.flatnonzero(w & edge)
    edge[-1] = True
    edge[:-1] = ~w[1:]
    edge[inner - 1] = True
    ends = np.flatnonzero(w & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed_words(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first): as word_bounds()."""
    starts, ends, first = word_bounds(offsets, data, is_word)
    return Ranges(data).of(starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each text's n-word shingles; a text of 1 to n - 1 words has one shingle, of all its words."""
    counts = np.diff(first)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(per)])
    total = int(out_first[-1])
    at = np.repeat(first[:-1] - out_first[:-1], per) + np.arange(total)  # each shingle's first word
    have = np.repeat(np.minimum(counts, n), per)
    h = np.zeros(total, U)
    for j in range(n):
        ok = have > j
        w = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else np.zeros(total, U)
        h = h * U(_BASE) + np.where(ok, w, U(j + 1))
    return mix(h), out_first


def pieces(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list array from flat values and first indices."""
    return pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(values)).cast(pa.list_(pa.array(values).type))
