"""Byte-level BPE by a global distinct-word shuffle.

1. Each task splits its texts and keeps one dictionary of words for a chapter (a bounded amount of
   text).  A document is a row of positions into it; the dictionary is dealt into buckets by the
   word's hash.  Both go to one table in the shared folder.
2. The dictionaries meet by bucket, so every distinct word of the corpus is encoded once, whichever
   chapters hold it; its ids go back to each of them.
3. The ids of a chapter's words are joined to its rows of positions, which puts every text's ids
   together in the order of its pre-tokens.

The words travel, never the pre-tokens: a word that makes a third of the corpus is one entry a
chapter.  Decoding joins ids to the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import common, pretoken, vocabulary

#: A chapter ends after so many bytes of text, or words in its dictionary.
CHAPTER_BYTES, CHAPTER_WORDS = 256 << 20, 1_000_000
#: Bytes of text whose ids a worker puts together at a time.
BLOCK_BYTES = 4 << 20


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, their bytes regrouped by place and compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplanes(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(plain.reshape(4, -1).T).view("<u4").ravel()


def _pack_words(words: list[bytes]) -> bytes:
    sizes = np.array([len(w) for w in words], np.uint32)
    return len(words).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(sizes.tobytes() + b"".join(words))


def _unpack_words(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    plain = zstandard.ZstdDecompressor().decompress(data[4:])
    ends = (4 * n + np.cumsum(np.frombuffer(plain, np.uint32, n), dtype=np.int64)).tolist()
    return [plain[a:b] for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)] if n else []


class _Chapter:
    def __init__(self, name: int, buckets: int):
        self.name, self.buckets, self.bytes, self.index = name, buckets, 0, {}

    def add(self, words: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
        index = self.index
        new = [index.setdefault(w, len(index)) for w in words.to_pylist()]
        self.bytes += size
        return np.array(new, np.uint32)[at] if new else np.zeros(0, np.uint32)

    def entries(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(bucket, words, their positions in the dictionary) of each bucket that has words; one without words if none has."""
        words = list(self.index)
        if not words:
            yield 0, _pack_words([]), _planes(np.zeros(0, np.uint32))
            return
        bucket = np.array([zlib.crc32(w) for w in words], np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in range(self.buckets):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                yield b, _pack_words([words[i] for i in own.tolist()]), _planes(np.diff(own, prepend=0))


def _chapters(docs: DataFrame, runs, buckets: int) -> DataFrame:
    """Rows of a block of documents (keys, counts, codes) and of a bucket of a chapter's words (bucket, words, at)."""
    kind = docs.schema["k"].dataType
    schema = f"chapter long, bucket int, words binary, at binary, keys array<{kind.simpleString()}>, counts binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, first, number, chapter = pretoken.Splitter(runs), TaskContext.get().partitionId() << 32, 0, None
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), None, pa.binary(), pa.binary()]
        names = ["chapter", "bucket", "words", "at", "keys", "counts", "codes"]

        def close(chapter):
            for bucket, words, at in chapter.entries():
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chapter.name, bucket, words, at, None, None, None), types, strict=True)], names)

        for batch in batches:
            keys, texts = batch.columns
            types[4] = pa.list_(keys.type)
            for row, block in pretoken.text_blocks(texts, BLOCK_BYTES):
                if chapter is None:
                    chapter = _Chapter(first + number, buckets)
                words, at, bounds = splitter.words(block)
                codes = chapter.add(words, at, len(pretoken.utf8(block)[1]))
                own = keys.slice(row, len(block))
                listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                common.release()
                values = [pa.array([chapter.name]), pa.array([None], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), listed, pa.array([_planes(np.diff(bounds))]), pa.array([_planes(codes)])]
                yield pa.RecordBatch.from_arrays(values, names)
                if chapter.bytes >= CHAPTER_BYTES or len(chapter.index) >= CHAPTER_WORDS:
                    yield from close(chapter)
                    chapter, number = None, number + 1
        if chapter:
            yield from close(chapter)

    return docs.mapInArrow(run, schema)


def _encode_once(entries: DataFrame, path: str, parts: int) -> DataFrame:
    """chapter, file, at and the ids of its words, each distinct word encoded once in its bucket."""
    dealt = entries.repartition(parts, "bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, bucket, seen = vocabulary.rank_words(path).merge, None, {}
        for batch in batches:
            for chapter, file, b, words, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    bucket, seen = b, {}
                out = []
                for w in _unpack_words(words):
                    ids = seen.get(w)
                    if ids is None:
                        ids = seen[w] = merge(w)
                    out.append(ids)
                sizes = np.array([len(x) for x in out], np.uint32)
                flat = np.array([i for x in out for i in x], np.uint32)
                yield pa.RecordBatch.from_pydict({"chapter": [chapter], "file": [file], "at": [at], "sizes": [_planes(sizes)], "ids": [_planes(flat)]})

    return dealt.select("chapter", "file", "bucket", "words", "at").mapInArrow(run, "chapter long, file string, at binary, sizes binary, ids binary")


def _reassemble(ids: DataFrame, key_type: str, parts: int) -> DataFrame:
    """k, ids: the chapters' rows of positions, read from their file in the shared folder, joined to the ids of their words."""
    dealt = ids.repartition(parts, "chapter").sortWithinPartitions("chapter")

    def texts(chapter: int, file: str, got: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        places, sizes, flat = [], [], []
        for at, s, i in got:
            places.append(np.cumsum(_unplanes(at), dtype=np.uint32).astype(np.int64))
            sizes.append(_unplanes(s).astype(np.int64))
            flat.append(_unplanes(i).astype(np.uint32))
        place, size = np.concatenate(places), np.concatenate(sizes)
        ends = np.cumsum(size)
        order = np.argsort(place)
        if len(order) and place[order[-1]] != len(order) - 1:
            raise RuntimeError(f"chapter {chapter} lacks words")
        offsets = np.append(0, ends).astype(np.int64) * 4
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat).astype("<u4"))]).take(pa.array(order))
        filesystem, at = pyarrow.fs.FileSystem.from_uri(file)
        only = (pc.field("chapter") == chapter) & pc.field("bucket").is_null()
        rows = pyarrow.dataset.dataset(at, filesystem=filesystem, format="parquet").scanner(["keys", "counts", "codes"], filter=only, batch_size=4, batch_readahead=1, fragment_readahead=1, use_threads=False)
        for batch in rows.to_batches():
            for n in range(batch.num_rows):
                counts, codes = (_unplanes(batch.column(c)[n].as_py()) for c in (1, 2))
                data, offsets = vocabulary.gathered(words, codes)
                cut = offsets[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
                own = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1).flatten(), own], ["k", "ids"])
                del data, own
                common.release()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []
        for batch in batches:
            for chapter, file, at, sizes, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now and now[0] != chapter:
                    yield from texts(*now, got)
                    got = []
                now = (chapter, file)
                got.append((at, sizes, ids))
        if now:
            yield from texts(*now, got)

    return dealt.mapInArrow(run, f"k {key_type}, ids binary")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and ids (little-endian unsigned 32-bit) of every text by the rank file at `path`, as tiktoken gives them without
    special tokens.  A null text is empty and has no ids; repeated rows and null keys keep a row each."""
    spark = common.ready(docs.sparkSession)
    runs = pretoken.class_runs("tiktoken")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    chapters = common.written(_chapters(slim, runs, parts), "chapters")
    kind = slim.schema["k"].dataType.simpleString()
    entries = chapters.where("bucket is not null").select("chapter", "bucket", "words", "at", F.col("_metadata.file_path").alias("file"))
    return _reassemble(_encode_once(entries, path, parts), kind, parts).withColumnRenamed("k", key)


def decoded(column: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all ids in a column of id binaries, end to end, and the rows' offsets: a join with the token-byte table."""
    _, data, offsets = pretoken.utf8(column)
    plain, at = vocabulary.gathered(table, data.view("<u4"))
    return plain, at[offsets // 4]


def decode(ids: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` (binary) to rows with `ids` (a column `decoded` of theirs is replaced).  Null and empty ids decode to
    nothing; an empty table stays empty.  The token-byte table has one entry a vocabulary id."""
    common.ready(ids.sparkSession)
    ids = ids.drop("decoded")
    names = ids.columns

    def make():
        table = vocabulary.token_bytes(path)

        def each(batch: pa.RecordBatch):
            plain, cut = decoded(batch.column(names.index("ids")), table)
            out = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(plain)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

        return each

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema)
    return common.arrow_map(ids, make, f"{kinds}, decoded binary")


def codec_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, decodes and returns per document: `key`, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes)."""
    ids = encode(docs, path, key, text)

    def make():
        table = vocabulary.token_bytes(path)
        decimals = pa.array([b"%d," % i for i in range(len(table))], pa.binary())

        def digests(plain: np.ndarray, cut: np.ndarray, drop: int) -> pa.Array:
            view, at = memoryview(plain), cut.tolist()
            return pa.array([hashlib.sha256(view[a : max(a, b - drop)]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

        def each(batch: pa.RecordBatch):
            keys, column = batch.columns
            for first, block in pretoken.text_blocks(column, common.BLOCK_BYTES):
                counts = pa.array(np.diff(pretoken.utf8(block)[2]) // 4)
                columns = [keys.slice(first, len(block)), counts, digests(*decoded(block, decimals), 1), digests(*decoded(block, table), 0)]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    kind = ids.schema[key].dataType.simpleString()
    return common.arrow_map(ids, make, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
