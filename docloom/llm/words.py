"""Word scanning shared by the operators: numpy over Arrow string buffers.

``scan`` splits whole texts into words by a byte table and gives every word a
64-bit hash; ``window_hashes`` hashes runs of consecutive words.  Both work on
bounded slices of a batch (``SLICE_BYTES`` of text, at least one whole text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SEP = 32

_ALL = np.arange(256)
# any byte but space and \x09-\x0D
NON_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
# digits, lower-case a-z and every byte of a non-ASCII character
ALNUM = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.astype(np.uint8)

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _powers(base: np.uint64, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and its inverse modulo 2**64 for i < n (kept between calls)."""
    have = cache.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                         for b in (base, inverse))
        cache[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash is usable."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of values[start:end] for each run, from prefix sums."""
    up, down = _powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])
        h = (sums[ends] - sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Slice:
    """Words of rows ``first .. first + rows`` of a batch."""
    first: int
    rows: int
    text: np.ndarray      # bytes of the rows, a separator after each
    starts: np.ndarray    # of the words, in ``text``
    ends: np.ndarray
    splits: np.ndarray    # words of row r: splits[r] .. splits[r + 1]
    hashes: np.ndarray
    row_at: np.ndarray    # where each row starts in ``text``

    def word(self, i: int) -> bytes:
        return self.text[self.starts[i]:self.ends[i]].tobytes()

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.splits))


def joined(texts: pa.Array | pa.ChunkedArray, fold: np.ndarray,
           slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row starts and the last one ends) of
    bounded slices of the texts, a separator after each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + slice_bytes, "right")) - 1
        last = min(n, max(first + 1, last))
        lens = np.diff(offsets[first:last + 1])
        row_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens + 1)])
        text = np.full(row_at[-1], SEP, np.uint8)
        for r in range(last - first):
            text[row_at[r]:row_at[r] + lens[r]] = data[offsets[first + r]:offsets[first + r + 1]]
        yield first, fold[text], row_at
        first = last


def scan(texts: pa.Array | pa.ChunkedArray, keep: np.ndarray, fold: np.ndarray = LOWER,
         slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Words (maximal runs of ``keep`` bytes) of every text; null has none."""
    for first, text, row_at in joined(texts, fold, slice_bytes):
        inside = np.concatenate([[False], keep[text], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        yield Slice(first, len(row_at) - 1, text, starts, ends, np.searchsorted(starts, row_at),
                    _runs(text.astype(np.uint64) + np.uint64(1), starts, ends, _BASE[0]), row_at[:-1])


def window_hashes(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of k words inside one row."""
    end = np.repeat(s.splits[1:], np.diff(s.splits))
    at = np.flatnonzero(np.arange(len(s.hashes)) + k <= end)
    return at, _runs(s.hashes, at, at + k, _BASE[1])


def batches(frames: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes (one row at least)."""
    for b in frames:
        parts = max(1, -(-b.nbytes // most))
        step = max(1, -(-b.num_rows // parts))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
