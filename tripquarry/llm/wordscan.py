"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of digits, letters a-z (A-Z folded) and non-ASCII characters, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Every such character is one or
more bytes that are word bytes themselves, so scanning UTF-8 bytes gives the same words.

Words get 64-bit polynomial hashes from one prefix sum over the bytes; hashes of k consecutive
words are sums of k shifted products.  Memory is bounded by the slice of texts that is scanned
(``SLICE`` bytes, or one longer text) and, within it, by ``PIECE`` bytes of 8-byte temporaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
PIECE = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_GRAM = _U(0xD6E8FEB86659FD93)

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
LOWER = LOWER_BYTES.tobytes()
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER_BYTES]
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high and low bits of a hash are alike usable."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Consecutive ranges of texts of at most ``limit`` bytes, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words of consecutive texts: byte spans, hashes, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.base = data[offsets[0] : offsets[-1]], int(offsets[0])
        self.offsets = offsets - offsets[0]
        self.starts, self.ends = _spans(self.data, self.offsets)
        self.of_text = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of_text)

    @property
    def texts(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.of_text) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _hashed(self.data, self.starts, self.ends)
        return self._hashes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes().translate(LOWER)

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j, lower-cased, with single spaces between."""
        return b" ".join(self.word(k) for k in range(i, j))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every k consecutive words of one text, and the number of the first word."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h, total = self.hashes, np.zeros(n, np.uint64)
        for i in range(k):
            total = total * _GRAM + h[i : i + n]
        texts = self.texts
        at = np.flatnonzero(texts[:n] == texts[k - 1 : k - 1 + n])
        return mixed(total[at] + _U(k)), at


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    if len(edges):
        word = IS_WORD[data[edges]]
        first[edges[word]] = True
        before = edges - 1
        last[before[IS_WORD[data[before]]]] = True
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, lo, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while lo < n:
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        part = data[base : ends[hi - 1]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _power(_BASE, len(part)), out=sums[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = (sums[e] - sums[s]) * _power(_INVERSE, len(part))[s] + (e - s).astype(np.uint64)
        lo = hi
    return mixed(out)


def scan(column: pa.Array, limit: int = SLICE):
    """Words of a column, slice by slice: (lo, hi, Words)."""
    data, offsets = text_buffers(column)
    for lo, hi in slices(offsets, limit):
        yield lo, hi, Words(data, offsets[lo : hi + 1])


def char_offsets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code-point offsets of byte offsets within ``data`` (valid UTF-8)."""
    if not len(at):
        return at
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return lead[at]
