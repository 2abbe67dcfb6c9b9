"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of keys, in ascending order.  Its layout is the public
seekable zstandard format, so any zstandard tool can decompress it whole:

    data frames      little-endian unsigned 32-bit ids, end to end; a frame ends at a document's end, or
                     inside a document that is longer than a frame
    index frame      skippable; the documents' keys and token counts as an Arrow stream, compressed
    seek table       skippable; compressed size, decompressed size and checksum (low half of XXH64 of the
                     decompressed bytes) of each frame before it, the index frame as one of size 0

A reader takes the seek table from the file's end, finds the wanted documents in the index and
reads and decompresses only the frames that hold them, each checked against its checksum.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import common, pretoken, vocabulary

# Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of text a file.
FILE_BYTES = 32 << 20
#: Bytes of ids after which a frame ends: what a reader of one document decompresses besides it.
FRAME_BYTES = 128 << 10


class FileWriter:
    """Writes one file; add() documents in order, then close()."""

    def __init__(self, sink, key_type: pa.DataType, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.key_type, self.frame_bytes = sink, key_type, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.keys: list = []
        self.counts: list[int] = []
        self.held: list[bytes] = []
        self.size = 0

    def _frame(self, data: bytes) -> None:
        packed = self.zstd.compress(data)
        self.sink.write(packed)
        self.table.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        data = b"".join(self.held)
        for at in range(0, len(data), 8 * self.frame_bytes):
            self._frame(data[at : at + 8 * self.frame_bytes])
        self.held, self.size = [], 0

    def add(self, key, ids: bytes) -> None:
        self.keys.append(key)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        out = pa.BufferOutputStream()
        index = pa.table({"key": pa.array(self.keys, self.key_type), "n_tokens": pa.array(self.counts, pa.int64())})
        with pa.ipc.new_stream(out, index.schema) as stream:
            stream.write_table(index)
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(out.getvalue().to_pybytes())
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self.table.append((len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class FileReader:
    """Random access to one file (any object with seek() and read())."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a file of frames with a seek table and checksums")
        source.seek(size - 9 - 12 * n)
        table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.plain_at = np.concatenate([[0], np.cumsum(table[:, 1])])
        self.checksum, self.unzstd = table[:, 2], zstandard.ZstdDecompressor()
        source.seek(int(self.packed_at[n - 1]) + 8)
        index = pa.ipc.open_stream(self.unzstd.decompressobj().decompress(source.read(int(table[n - 1, 0]) - 8))).read_all()
        self.keys, self.counts = index["key"].combine_chunks(), index["n_tokens"].to_numpy()
        self.token_at = np.concatenate([[0], np.cumsum(self.counts)])
        self._last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.source.seek(int(self.packed_at[k]))
            data = self.unzstd.decompress(self.source.read(int(self.packed_at[k + 1] - self.packed_at[k])))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.checksum[k]:
                raise ValueError(f"frame {k} doesn't meet its checksum")
            self._last = (k, data)
        return self._last[1]

    def ids(self, row: int) -> bytes:
        """The ids of the document in this row of the index, from as few frames as hold them."""
        a, b = 4 * int(self.token_at[row]), 4 * int(self.token_at[row + 1])
        out, k = [], int(np.searchsorted(self.plain_at, a, "right")) - 1
        while a < b:
            start = int(self.plain_at[k])
            part = self.frame(k)[a - start : b - start]
            out.append(part)
            a, k = a + len(part), k + 1
        return b"".join(out)


def _open(uri: str):
    filesystem, path = pyarrow.fs.FileSystem.from_uri(uri)
    return filesystem, path


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", files: int | None = None) -> list[dict]:
    """Encodes `docs` and writes one file a range of ascending keys to `folder` (a URI that executors and driver share).

    Returns the manifest, a row a file in ascending order: file, n_docs, n_tokens.  Rows of equal keys keep the input's
    order; null keys come first; a null text is empty, so only `end_id`.  An empty table gives no file.  An attempt
    writes under a name of its own and counts only if its row comes back, so retried tasks do no harm.
    """
    vocabulary.check_byte_level(path)
    spark = common.ready(docs.sparkSession)
    runs, specials = pretoken.class_runs("tokenizers"), tuple(vocabulary.json_specials(path))
    if files is None:  # by the texts' bytes, so a file and its index don't grow with the input
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"), F.monotonically_increasing_id().alias("m"))
    ordered = slim.repartitionByRange(files, "k", "m").sortWithinPartitions("k", "m").select("k", "t")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        splitter, words = pretoken.Splitter(runs, specials), vocabulary.json_words(path)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.ids.zst"
        for batch in batches:
            keys, texts = batch.columns
            for first, block in pretoken.text_blocks(texts, common.BLOCK_BYTES):
                if writer is None:
                    filesystem, place = _open(folder)
                    filesystem.create_dir(place, recursive=True)
                    sink = filesystem.open_output_stream(f"{place}/{name}", compression=None)
                    writer = FileWriter(sink, keys.type)
                found, at, bounds = splitter.words(block)
                data, offsets = vocabulary.gathered(words.ids(found), at)
                cut = offsets[bounds].tolist()
                for i, k in enumerate(keys.slice(first, len(block)).to_pylist()):
                    writer.add(k, data[cut[i] : cut[i + 1]].tobytes() + end)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "n_docs": [len(writer.counts)], "n_tokens": [sum(writer.counts)]})

    rows = ordered.mapInArrow(write, "file string, n_docs long, n_tokens long").collect()  # a row a file
    return [r.asDict() for r in sorted(rows, key=lambda r: r["file"])]


def read_token_files(spark, folder: str, manifest: list[dict], key_type: str = "bigint", keys: list | None = None) -> DataFrame:
    """The documents of the files: k, start (tokens in all files before it), n_tokens, ids (binary).

    With `keys`, only those documents, and only the frames that hold them are read (a key of several rows gives them all, one that
    isn't there none).  Null keys come back as null, documents without ids of their own as their end token; an empty
    manifest gives no rows.
    """
    common.ready(spark)
    base, rows = 0, []
    for m in manifest:
        rows.append((m["file"], base))
        base += m["n_tokens"]
    wanted = None if keys is None else pa.array(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, place = _open(folder)
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{place}/{name}"
                with filesystem.open_input_file(at) as source:
                    file = FileReader(source, source.size())
                    chosen = np.arange(len(file.counts))
                    if wanted is not None:
                        chosen = np.flatnonzero(pc.is_in(file.keys, value_set=wanted.cast(file.keys.type)).to_numpy(zero_copy_only=False))
                    held, size = [], 0
                    for k, row in enumerate(chosen.tolist()):
                        held.append((row, file.ids(row)))
                        size += len(held[-1][1])
                        if size >= common.BLOCK_BYTES or k + 1 == len(chosen):
                            at_rows = np.array([r for r, _ in held])
                            columns = [file.keys.take(pa.array(at_rows)), pa.array(before + file.token_at[at_rows]), pa.array(file.counts[at_rows]), pa.array([x for _, x in held], pa.binary())]
                            yield pa.RecordBatch.from_arrays(columns, ["k", "start", "n_tokens", "ids"])
                            held, size = [], 0

    frame = spark.createDataFrame(rows, "file string, base long")
    return frame.repartition(max(1, len(rows))).mapInArrow(read, f"k {key_type}, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files, reads them back and returns per document: `key`, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = common.new_path(spark, "token-files")
    manifest = write_token_files(docs, path, folder, key=key, text=text)
    kind = docs.schema[key].dataType.simpleString()
    read = read_token_files(spark, folder, manifest, kind)
    return read.select(F.col("k").alias(key), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
