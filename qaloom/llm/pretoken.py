"""Columnar pre-tokenisation for byte-level BPE.

The split pattern of the public byte-level vocabularies

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

covers every character, so the pre-tokens of a text are its tiles and one array of start
positions describes them.  `Splitter` finds the starts for a whole block of texts with array
operations on the UTF-8 bytes and hands the block to Arrow as one binary column, whose dictionary
is the block's distinct words and whose indices are the words' positions.

Which characters are letters, numbers and white space depends on the Unicode version inside the
library whose results are to be met, so the classes are asked from that library itself.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _all_characters() -> str:
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))


def _matched_by_tiktoken(pattern: str, text: str) -> str:
    import tiktoken

    bytes_only = {bytes([i]): i for i in range(256)}
    found = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
    return bytes(found.encode_ordinary(text)).decode()


def _matched_by_tokenizers(pattern: str, text: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return "".join(piece for piece, _ in split.pre_tokenize_str(text))


@functools.cache
def class_runs(library: str) -> tuple[tuple[int, int], ...]:
    """(first code point, class) of each run of equal classes, as `library` ("tiktoken" or
    "tokenizers") sees them; a few thousand pairs, so it travels with a task."""
    matched = {"tiktoken": _matched_by_tiktoken, "tokenizers": _matched_by_tokenizers}[library]
    table, text = np.full(0x110000, OTHER, np.uint8), _all_characters()
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        table[np.frombuffer(matched(pattern, text).encode("utf-32-le"), np.uint32)] = kind
    first = np.flatnonzero(np.diff(table, prepend=255))
    return tuple(zip(first.tolist(), table[first].tolist(), strict=True))


def class_table(runs: tuple[tuple[int, int], ...]) -> np.ndarray:
    first = np.array([a for a, _ in runs] + [0x110000])
    return np.repeat(np.array([k for _, k in runs], np.uint8), np.diff(first))


def text_blocks(column: pa.Array, most_bytes: int):
    """Slices (first row, column) of at most `most_bytes` of text, one row at least."""
    sizes = np.diff(_offsets(column))
    first, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > first and total + size > most_bytes:
            yield first, column.slice(first, row - first)
            first, total = row, 0
        total += size
    if len(column) > first:
        yield first, column.slice(first)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], wide) if column.buffers()[1] and len(column) else np.zeros(1, wide)
    return raw[column.offset : column.offset + len(column) + 1]


def utf8(column: pa.Array) -> tuple[pa.Buffer | bytes, np.ndarray, np.ndarray]:
    """The column's bytes, as a buffer and as an array, and len + 1 offsets into them; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    offsets = _offsets(column).astype(np.int64)
    buffer = column.buffers()[2] if len(column) and column.buffers()[2] is not None else pa.py_buffer(b"")
    buffer = buffer.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return buffer, np.frombuffer(buffer, np.uint8), offsets - offsets[0]


class Splitter:
    """Splits blocks of texts; `special`: strings that are tokens of their own wherever they stand."""

    def __init__(self, runs: tuple[tuple[int, int], ...], special: tuple[bytes, ...] = ()):
        self.table = class_table(runs)
        self.ascii = np.concatenate([self.table[:128], np.full(128, OTHER, np.uint8)])
        self.special = special

    def _classes(self, b: np.ndarray) -> np.ndarray:
        kinds = self.ascii[b]
        lead = np.flatnonzero(b >= 0xC0)
        if lead.size:
            b0 = b[lead].astype(np.int32)
            width = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
            point = b0 & (0xFF >> (width + 1))
            for k in (1, 2, 3):
                more = width > k
                point[more] = point[more] << 6 | b[lead[more] + k] & 0x3F
            kind = self.table[point]
            kinds[lead] = kind
            for k in (1, 2, 3):
                more = width > k
                kinds[lead[more] + k] = kind[more]
        return kinds

    def _specials(self, buffer, edge: np.ndarray) -> list[tuple[int, int]]:
        found, data = [], None
        for s in self.special:
            data = bytes(buffer) if data is None else data
            at = data.find(s)
            while at >= 0:
                if not edge[at + 1 : at + len(s)].any():
                    found.append((at, at + len(s)))
                    at = data.find(s, at + len(s))
                else:
                    at = data.find(s, at + 1)
        return found

    def starts(self, buffer, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Positions at which pre-tokens start."""
        n = len(b)
        if not n:
            return np.zeros(0, np.int64)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        specials = self._specials(buffer, edge)
        for x, y in specials:
            edge[x] = edge[y] = True
        kinds = self._classes(b)
        start = np.empty(n + 4, bool)
        start[0], start[n:] = True, False
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:n])
        start[:n] |= edge[:n]
        # a run of anything but white space takes one blank before it; other white space before it stands alone
        run = np.flatnonzero(start[:n] & (kinds != SPACE) & ~edge[:n])
        run = run[kinds[run - 1] == SPACE]
        last = run - 1
        for _ in range(3):
            last = last - ((b[last] & 0xC0) == 0x80)
        start[last] = True
        start[run[b[run - 1] == 0x20]] = False
        self._contractions(b, edge, start)
        for x, y in specials:
            start[x + 1 : y] = False
        return np.flatnonzero(start[:n])

    @staticmethod
    def _contractions(b: np.ndarray, edge: np.ndarray, start: np.ndarray) -> None:
        n = len(b)
        at = np.flatnonzero(b == 0x27)
        at = at[start[at] & (at + 1 < n)]
        at = at[~edge[at + 1]]
        one = at[np.isin(b[at + 1], np.frombuffer(b"stmd", np.uint8))]
        two = at[at + 2 < n]
        two = two[~edge[two + 2]]
        pair = b[two + 1].astype(np.int32) << 8 | b[two + 2]
        two = two[np.isin(pair, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])]
        for found, length in ((one, 2), (two, 3)):
            start[found + 1] = False
            start[found + length] = True

    def words(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words (binary), the words' indices in order of the texts, and len + 1 offsets of the texts into the indices."""
        buffer, b, offsets = utf8(column)
        start = self.starts(buffer, b, offsets)
        bounds = np.append(start, len(b)).astype(np.int32)
        tiles = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), buffer])
        coded = tiles.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(start, offsets)
