import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from qaloom.llm import bpe_codec, packing, pretoken, token_counts, token_files, vocabulary
from tests.llm.helpers import SCHEMA, hard

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library_ids(text):
    return vocabulary.json_vocabulary(JSON).encode(text or "", add_special_tokens=False).ids


def test_pretokens_and_counts_meet_the_library_on_random_texts():
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t", " ", "　", "a", "B", "é", "中", "1", "٣", "²", "!", "#$", "<|endoftext|>", "<|", "🙂", "́", "\r\n", "\x1c", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", None]
    got = token_counts.Counter(JSON, pretoken.class_runs("tokenizers")).count(pa.array(texts))
    assert got.tolist() == [len(library_ids(t)) for t in texts]


def test_token_counts(spark):
    docs = hard(spark)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, JSON).collect())
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), n := len(library_ids(r.text)), n > 1024) for r in docs.collect())
    assert got == want
    assert token_counts.token_counts(hard(spark, []), JSON).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        vocabulary.check_byte_level(public_tokenizers.path("word_bpe_49k.json"))


def test_codec(spark, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CHAPTER_BYTES", 1 << 14)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.rank_table(RANKS), special_tokens={})
    docs = hard(spark)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((r.doc_id or -1, len(i := enc.encode_ordinary(r.text or "")), sha(",".join(map(str, i)).encode()), sha((r.text or "").encode())) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.codec_digest(docs, RANKS).collect()) == want
    assert bpe_codec.codec_digest(hard(spark, []), RANKS).count() == 0
    only_empty = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.n_tokens for r in bpe_codec.codec_digest(only_empty, RANKS).collect()} == {0}


def test_files_round_trip_and_random_access(spark):
    docs = hard(spark)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_file_digest(docs, JSON).collect()]
    rows = docs.collect()
    ids = {r.doc_id: np.array([*library_ids(r.text), 0], "<u4").tobytes() for r in rows}
    start = 0
    for doc_id, s, n, crc in sorted(got, key=lambda r: r[1]):
        assert (s, n, crc) == (start, len(ids[doc_id]) // 4, zlib.crc32(ids[doc_id]))
        start += n
    assert [r[0] or -1 for r in sorted(got, key=lambda r: r[1])] == sorted(r.doc_id or -1 for r in rows)
    folder = token_files.common.new_path(spark, "t")
    manifest = token_files.write_token_files(docs, JSON, folder)
    one = token_files.read_token_files(spark, folder, manifest, keys=[9]).collect()
    assert [bytes(r.ids) for r in one] == [ids[9]]
    assert token_files.token_file_digest(hard(spark, []), JSON).count() == 0


def test_file_checksums_and_long_documents():
    sink = io.BytesIO()
    writer = token_files.FileWriter(sink, pa.int64(), frame_bytes=64)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (3, 0, 5000, 16, 1)]
    for k, d in enumerate(docs):
        writer.add(k if k != 2 else None, d)
    writer.close()
    raw = bytearray(sink.getvalue())
    reader = token_files.FileReader(io.BytesIO(raw), len(raw))
    assert [reader.ids(k) for k in (4, 2, 0, 1, 3)] == [docs[k] for k in (4, 2, 0, 1, 3)]
    reader.checksum[0] ^= 1
    reader._last = (-1, b"")
    with pytest.raises(ValueError):
        reader.ids(0)


def test_packing(spark):
    docs = hard(spark)
    got = packing.best_fit_packing(docs, JSON, capacity=256, with_ids=True).collect()
    bins: dict = {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(r.length for r in got) == sum(len(library_ids(r.text)) + 1 for r in docs.collect())
    assert packing.best_fit_packing(hard(spark, []), JSON).count() == 0


def test_pieces_hold_the_library_s_ids(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(r for r in hard(spark).collect())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    capacity = 256
    held: dict = {}
    for r in packing.best_fit_packing(docs, JSON, capacity=capacity, with_ids=True).collect():
        held.setdefault(r.doc_id, []).append(r)
    assert set(held) == {r[0] for r in rows}
    for i, text, *_ in rows:
        want = np.array([*library_ids(text), 0], "<u4").tobytes()
        own = sorted(held[i], key=lambda r: r.piece)
        assert b"".join(bytes(r.ids) for r in own) == want and [r.piece for r in own] == list(range(len(own)))
        starts = np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        assert [r.start for r in own] == starts
        assert len(own) == 1 if len(want) <= 4 * capacity else all(r.length == capacity for r in own[1:])


def test_decode_as_an_operator(spark):
    docs = hard(spark).select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    ids = bpe_codec.encode(docs, RANKS).selectExpr("doc_id", "ids", "1 as decoded")
    assert {r.doc_id: bytes(r.decoded) for r in bpe_codec.decode(ids, RANKS).collect()} == texts
    assert bpe_codec.decode(ids.where("false"), RANKS).count() == 0


def test_histogram_packing_covers_and_is_tight():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.choice([16, 100, 2048])
        histogram = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 60))}
        groups = packing.pack_histogram(histogram, capacity)
        held: dict = {}
        for bins, items in groups:
            assert sum(x * c for x, c in items) <= capacity and sum(c for x, c in items if 3 * x > capacity) <= 2
            for x, c in items:
                held[x] = held.get(x, 0) + bins * c
        assert held == histogram
        least = -(-sum(x * c for x, c in histogram.items()) // capacity)
        large = sorted((x for x, c in histogram.items() for _ in range(c) if 3 * x > capacity), reverse=True)
        i, j, pairs = 0, len(large) - 1, 0
        while i <= j:  # the least bins that the long pieces need alone
            j -= i < j and large[i] + large[j] <= capacity
            i, pairs = i + 1, pairs + 1
        assert sum(b for b, _ in groups) <= max(pairs, 1.25 * least + 1) + 1


def test_schema_of_empty_is_stable(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], SCHEMA), JSON).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
