"""Words of many texts as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial in its bytes, taken for all words of a slice from one running sum, then
mixed. Arrays are aligned: ``hashes`` has the words of all texts in order, ``bounds[i]:bounds[i+1]``
those of text i.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WHITE = b" \t\n\x0b\x0c\r"
#: Everything in ASCII but letters and digits; bytes of other scripts count as letters.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())
_BLOCK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(length: int, variant: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(length - 1).bit_length())
    if (size, variant) not in _POWERS:
        base = _BASES[variant]
        out = []
        for factor in (base, pow(base, -1, 1 << 64)):
            line = np.full(size, factor, np.uint64)
            line[0] = 1
            out.append(np.multiply.accumulate(line))
        if size > 2 * _BLOCK:
            return out[0], out[1]
        _POWERS[size, variant] = (out[0], out[1])
    return _POWERS[size, variant]


def _buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets into them; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.fill_null("").cast(pa.large_string())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset: array.offset + len(array) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(array) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    return raw, (offsets - first if len(array) else np.zeros(1, np.int64))


class Words:
    """The words of an array of texts: byte ranges, hashes on demand, and where each text's words lie."""

    def __init__(self, array: pa.Array, separators: bytes = WHITE, fold: bool = False):
        raw, offsets = _buffers(array)
        if fold:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            raw = table[raw]
        gap = np.zeros(256, bool)
        gap[list(separators)] = True
        inside = ~gap[raw]
        opens, closes = inside.copy(), inside.copy()
        if len(raw):
            opens[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(raw))]
            opens[edges] = inside[edges]
            closes[edges - 1] = inside[edges - 1]
        self.raw = raw
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, variant: int = 0) -> np.ndarray:
        """One 64-bit hash a word; the two variants are independent of each other."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            lo = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, lo + _BLOCK, side="right")))
            hi = int(self.ends[upto - 1])
            power, inverse = _powers(hi - lo + 1, variant)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.raw[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = self.starts[at:upto] - lo, self.ends[at:upto] - lo
            out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = upto
        return out


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words that lies inside one text, and the word it starts at."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(bounds[:-1], bounds[1:])
                             if b - a >= width] or [np.empty(0, np.int64)])
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + hashes[k: k + n]
    return mix(acc[starts]), starts
