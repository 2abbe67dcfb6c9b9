"""Words to token ids, by the libraries' own merges, each distinct word once a worker while its memory holds."""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Words whose ids a worker remembers; beyond it the memory starts anew, which costs time only.
REMEMBERED = 500_000


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words:
    """Token ids of words, as little-endian unsigned 32-bit binaries."""

    def __init__(self, merge: Callable[[bytes], list[int]], fixed: dict[bytes, int] | None = None):
        self.merge = merge
        self.fixed = {w: struct.pack("<I", i) for w, i in (fixed or {}).items()}
        self.seen: dict[bytes, bytes] = dict(self.fixed)

    def ids(self, words: pa.Array) -> pa.Array:
        seen, merge = self.seen, self.merge
        if len(seen) > REMEMBERED:
            seen = self.seen = dict(self.fixed)
        out = []
        for w in words.to_pylist():
            got = seen.get(w)
            if got is None:
                ids = merge(w)
                got = seen[w] = struct.pack(f"<{len(ids)}I", *ids)
            out.append(got)
        return pa.array(out, pa.binary())


@functools.cache
def json_vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def json_specials(path: str) -> dict[bytes, int]:
    """Added strings that the library takes out of a text before it splits words."""
    return {t.content.encode(): i for i, t in json_vocabulary(path).get_added_tokens_decoder().items()}


def check_byte_level(path: str) -> None:
    """This module meets the library's ids for plain byte-level BPE files only; others are refused, not guessed."""
    import json

    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre, model = d["pre_tokenizer"] or {}, d["model"]
    plain = (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and d["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in d["added_tokens"])
    )
    if not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")


@functools.cache
def json_words(path: str) -> Words:
    """A worker's encoder for a `tokenizers` file: the library's own BPE model on one word."""
    model, letters = json_vocabulary(path).model, byte_letters()
    tokenize = model.tokenize
    return Words(lambda w: [t.id for t in tokenize(w.decode("latin-1").translate(letters))], json_specials(path))


@functools.cache
def rank_table(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def rank_words(path: str) -> Words:
    """A worker's encoder for a rank file: tiktoken's own merges on one word."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=rank_table(path), special_tokens={})
    return Words(encoding._core_bpe.encode_single_piece)


def token_bytes(path: str) -> pa.Array:
    """The token-byte table of a rank file: position = id."""
    by_id = {i: b for b, i in rank_table(path).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.binary())


def gathered(column: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `column` at the positions `at`, end to end, and the len + 1 offsets."""
    from qaloom.llm.pretoken import utf8

    _, data, offsets = utf8(column.take(pa.array(at)))
    return data, offsets
