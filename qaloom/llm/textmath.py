"""Words, lines and word windows of whole blocks of texts as arrays.

Words are `[^\\x20\\x09-\\x0D]+`: only ASCII blanks part them, so all of it works on UTF-8 bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from qaloom.llm import pretoken

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Odd multipliers for the words of a window; fixed, so hashes agree on every machine.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The words of a block of texts, end to end: `words` (binary), `first` (len + 1 offsets of the texts into them)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        buffer, b, self.offsets = pretoken.utf8(column)
        self.bytes = b
        n = len(b)
        inside = ~_BLANK[b]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        self.inside = inside
        self.start = np.flatnonzero(start)
        data = (_LOWER[b] if lower else b)[inside]
        at = np.zeros(n + 1, np.int32)
        np.cumsum(inside, out=at[1:], dtype=np.int32)
        self.packed_at = at
        bounds = np.append(at[self.start], at[n]).astype(np.int32)
        self.data, self.bounds = data, bounds
        self.words = pa.Array.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        self.first = np.searchsorted(self.start, self.offsets)

    def word_hashes(self) -> np.ndarray:
        """64 bits of each word, a function of its bytes alone."""
        import xxhash

        coded = self.words.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        each = np.fromiter(map(digest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        return each[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.uint64)

    def codes(self) -> np.ndarray:
        """Each word's number in the block; equal words have equal numbers."""
        return self.words.dictionary_encode().indices.to_numpy()


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the windows of `size` words that begin at each word, as if the texts were one; the last size - 1 are void."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    x = words.astype(np.uint64)
    for k in range(min(size, n)):
        out[: n - k] += mix(x[k:] + _FACTORS[k]) * _FACTORS[k]
    return mix(out)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])
