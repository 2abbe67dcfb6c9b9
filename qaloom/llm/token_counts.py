"""Token counts by a whole-token shortcut.

Offline, once per vocabulary, every vocabulary string is proved: given alone to the library's
merges it must come back as that one token.  Pre-tokens that match a proved string count one
without any merge; only the rest are merged, each distinct one once a worker.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from qaloom.llm import common, pretoken, vocabulary


@functools.cache
def proved_words(path: str) -> pa.Array:
    """The vocabulary strings, as bytes, that the library's merges leave as one token, and the added strings."""
    tokenizer, letters = vocabulary.json_vocabulary(path), vocabulary.byte_letters()
    back, tokenize = {c: b for b, c in letters.items()}, tokenizer.model.tokenize
    alone = [bytes(back[c] for c in s) for s in tokenizer.get_vocab(with_added_tokens=False) if s and all(c in back for c in s) and len(tokenize(s)) == 1]
    return pa.array(sorted({*alone, *vocabulary.json_specials(path)}), pa.binary())


class Counter:
    def __init__(self, path: str, runs):
        self.splitter = pretoken.Splitter(runs, tuple(vocabulary.json_specials(path)))
        self.proved, self.words = proved_words(path), vocabulary.json_words(path)

    def count(self, column: pa.Array) -> np.ndarray:
        words, at, bounds = self.splitter.words(column)
        length = np.ones(len(words), np.int64)
        rest = np.flatnonzero(pc.is_in(words, value_set=self.proved).to_numpy(zero_copy_only=False) == False)  # noqa: E712
        length[rest] = np.diff(pretoken.utf8(self.words.ids(words.take(pa.array(rest))))[2]) // 4
        total = np.concatenate([[0], np.cumsum(length[at])])
        return np.diff(total[bounds])


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: `key`, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts equal those of the `tokenizers` library without added begin and end tokens; added strings inside a text are
    one token each, as by its default.  A null text counts as empty: 0 bytes, 0 tokens.  Null and repeated keys keep a
    row each; other columns are not looked at.  Every row is counted where it is read: no exchange at all.
    """
    vocabulary.check_byte_level(path)
    common.ready(docs.sparkSession)
    runs = pretoken.class_runs("tokenizers")
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"))

    def make():
        counter = Counter(path, runs)

        def each(batch: pa.RecordBatch):
            keys, texts = batch.columns
            for first, block in pretoken.text_blocks(texts, common.BLOCK_BYTES):
                n = pa.array(counter.count(block))
                size = pa.array(np.diff(pretoken.utf8(block)[2]))
                yield pa.RecordBatch.from_arrays([keys.slice(first, len(block)), size, n, pc.greater(n, limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

        return each

    kind = slim.schema["k"].dataType.simpleString()
    return common.arrow_map(slim, make, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("k", key)
