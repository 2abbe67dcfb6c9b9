"""Exact Jaccard join of word n-gram sets by a prefix tree.

1. Texts with equal sets are one class.  The sets' n-grams meet by hash range; those of a single class
   are dropped, as no link can use them, and the rest learn in how many classes they are.  Classes
   whose remaining n-grams are too few for any link go.
2. N-grams are ordered, rarest first.  Two sets that link share one of their first
   size - ceil(t size) + 1 n-grams, so components of the graph of classes and such n-grams hold all links.
3. In a component, the ordered sets stand in a trie, commonest n-gram first so that long paths are
   shared.  All sets traverse it together: a node adds its n-grams' overlaps to its parent's once for
   all sets below it, and a subtree is left when what remains of it can't reach the threshold, when
   sizes exclude it, or when it is already linked with all that still could.

Only a spanning forest of the links leaves a trie, never all pairs.  A large component is dealt into
chunks: each is joined in itself, then representatives of what was found join the chunks.  What shares no
first n-gram with another part by then is done; of the rest, in components anew, only chunks that still
hold different parts meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaloom.llm import common
from qaloom.llm.components import components
from qaloom.llm.pretoken import text_blocks
from qaloom.llm.textmath import Block, mix, sums, windows

#: Words an n-gram, and the least similarity as numerator and denominator.
WORDS, LEAST, OF = 5, 3, 4
#: Bytes of the input, as it is stored, for which there is a task of the n-grams' ranges.  Each class's number goes to every
#: range that has one of its n-grams, so more ranges than a text has n-grams cost a number an n-gram.
RANGE_BYTES = 32 << 20
#: Most classes and n-grams of a chunk of a component, on average.
CHUNK, CHUNK_GRAMS = 512, 400_000


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's n-grams, ascending in each text, and the offsets of the texts.  With fewer words the
    whole sequence is one; without words there is none."""
    block = Block(column, lower=True)
    hashes = block.word_hashes()
    texts, n = len(column), np.diff(block.first)
    text = np.repeat(np.arange(texts), n)
    grams = windows(hashes, words)
    left = block.first[1:][text] - np.arange(len(hashes))  # words from here to the text's end
    full = left >= words
    short = np.flatnonzero((n > 0) & (n < words))
    some = []
    for i in short.tolist():  # at most four words each
        x = np.uint64(n[i])
        for h in hashes[block.first[i] : block.first[i + 1]]:
            x = mix(np.array([x ^ h], np.uint64))[0]
        some.append(x)
    owner = np.concatenate([text[full], short])
    value = np.concatenate([grams[full], np.array(some, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(texts + 1))


def class_numbers(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """63 bits of each set and its size, whatever the order of its n-grams: sets of one class have one number."""
    one, two = (sums(mix(value ^ np.uint64(k)).view(np.int64), offsets).view(np.uint64) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    return (mix(one ^ mix(two + np.diff(offsets).astype(np.uint64))) >> np.uint64(1)).astype(np.int64)


def _z(*arrays: np.ndarray) -> bytes:
    """Arrays, regrouped by the place of their bytes, compressed."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unz(data: bytes, *kinds: tuple[int, type]) -> list[np.ndarray]:
    plain, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for n, kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(plain, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _digests(docs: DataFrame, words: int) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch):
            for first, block in text_blocks(batch.column(1), common.WORD_BLOCK_BYTES):
                value, offsets = shingle_sets(block, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(block)), pa.array(np.diff(offsets)), pa.array(class_numbers(value, offsets))], ["k", "n", "cid"])

        return each

    return common.arrow_map(docs, make, f"k {docs.schema['k'].dataType.simpleString()}, n long, cid long")


def _postings(docs: DataFrame, words: int, buckets: int) -> DataFrame:
    """bucket, grams, classes, data: the n-grams of a block's classes in one range of hashes."""

    def make():
        width = (1 << 64) // buckets + 1

        def each(batch: pa.RecordBatch):
            for _, block in text_blocks(batch.column(0), common.WORD_BLOCK_BYTES):
                value, offsets = shingle_sets(block, words)
                cid, size = class_numbers(value, offsets), np.diff(offsets)
                _, first = np.unique(cid, return_index=True)
                chosen = np.zeros(len(block), bool)
                chosen[first] = True
                owner = np.repeat(np.arange(len(block)), size)
                keep = chosen[owner]
                value, owner = value[keep], owner[keep]
                order = np.argsort(value, kind="stable")
                value, owner = value[order], owner[order]
                edges = np.append(np.searchsorted(value, np.arange(buckets, dtype=np.uint64) * np.uint64(width)), len(value))
                rows = []
                for b in range(buckets):
                    x, y = edges[b], edges[b + 1]
                    if x < y:
                        own, local = np.unique(owner[x:y], return_inverse=True)
                        data = _z(np.diff(value[x:y], prepend=np.uint64(0)), local.astype(np.uint32), cid[own], size[own].astype(np.uint32))
                        rows.append((b, int(y - x), len(own), data))
                for at in range(0, len(rows), 64):
                    cols = zip(*rows[at : at + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "grams", "classes", "data"])

        return each

    return common.arrow_map(docs, make, "bucket int, grams int, classes int, data binary")


def _shared(postings: DataFrame, groups: int) -> DataFrame:
    """grp, grams, classes, data: the n-grams that more than one class has, with the coded number of classes, by class."""

    def meet(t: pa.Table) -> pa.Table:
        values, local, ids, base = [], [], [], 0
        for g, c, data in zip(*(t[x].to_pylist() for x in ("grams", "classes", "data")), strict=True):
            v, i, cid, size = _unz(data, (g, np.uint64), (g, np.uint32), (c, np.int64), (c, np.uint32))
            values.append(np.cumsum(v, dtype=np.uint64))
            local.append(i.astype(np.int64) + base)
            ids.append(np.stack([cid, size.astype(np.int64)], axis=1))
            base += c
        value, own, ident = np.concatenate(values), np.concatenate(local), np.concatenate(ids)
        order = np.lexsort((ident[:, 1], ident[:, 0]))
        s = ident[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]).any(axis=1)
        number = np.empty(len(s), np.int64)
        number[order] = np.cumsum(new) - 1
        ident, own = s[new], number[own]
        order = np.lexsort((own, value))
        value, own = value[order], own[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
        value, own = value[new], own[new]
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(value)))
        n_of = np.repeat(n, n)
        shared = n_of > 1
        value, own, code = value[shared], own[shared], np.floor(8 * np.log2(np.maximum(n_of[shared], 1))).astype(np.uint16)
        grp = (ident[:, 0] % groups)[own]
        order = np.lexsort((own, grp))
        value, own, code, grp = value[order], own[order], code[order], grp[order]
        edges = np.searchsorted(grp, np.arange(groups + 1))
        rows = []
        for k in range(groups):
            x, y = edges[k], edges[k + 1]
            if x < y:
                u, count = np.unique(own[x:y], return_counts=True)
                rows.append((k, int(y - x), len(u), _z(value[x:y], code[x:y], count.astype(np.uint32), ident[u, 0].copy(), ident[u, 1].astype(np.uint32))))
        cols = [[r[i] for r in rows] for i in range(4)]
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["grp", "grams", "classes", "data"])

    return postings.repartition(groups // 2, "bucket").groupBy("bucket").applyInArrow(meet, "grp int, grams int, classes int, data binary")


def _survivors(shared: DataFrame, groups: int) -> DataFrame:
    """cid, n, prefix, grams, codes: classes that could link, n-grams ordered rarest first; `prefix` of them could be
    the first that a link shares."""

    def meet(t: pa.Table) -> pa.Table:
        values, codes, counts, ids = [], [], [], []
        for g, c, data in zip(*(t[x].to_pylist() for x in ("grams", "classes", "data")), strict=True):
            v, code, count, cid, size = _unz(data, (g, np.uint64), (g, np.uint16), (c, np.uint32), (c, np.int64), (c, np.uint32))
            values.append(v)
            codes.append(code)
            counts.append(count)
            ids.append(np.stack([cid, size.astype(np.int64)], axis=1))
        value, code, count, ident = (np.concatenate(x) for x in (values, codes, counts, ids))
        ident, number = np.unique(ident, axis=0, return_inverse=True)
        own = np.repeat(number.ravel(), count)
        m, n = np.bincount(own, minlength=len(ident)), ident[:, 1]
        needed = -(-LEAST * n // OF)
        alive = m >= needed
        keep = alive[own]
        own, value, code = own[keep], value[keep], code[keep]
        order = np.lexsort((value, code, own))
        own, value, code = own[order], value[order], code[order]
        chosen = np.flatnonzero(alive)
        edges = np.append(np.searchsorted(own, chosen), len(own))
        grams = [value[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        coded = [code[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out = [pa.array(np.ascontiguousarray(ident[chosen, i])) for i in range(2)]
        return pa.table([*out, pa.array((m - needed + 1)[chosen]), pa.array(grams, pa.binary()), pa.array(coded, pa.binary())], names=["cid", "n", "prefix", "grams", "codes"])

    return shared.repartition(groups // 2, "grp").groupBy("grp").applyInArrow(meet, "cid long, n long, prefix long, grams binary, codes binary")


def _prefix_grams(sets: DataFrame) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch):
            cid, prefix, grams = (batch.column(c) for c in ("cid", "prefix", "grams"))
            for at in range(0, batch.num_rows, 256):
                own, value = [], []
                for c, p, g in zip(cid[at : at + 256].to_pylist(), prefix[at : at + 256].to_pylist(), grams[at : at + 256].to_pylist(), strict=True):
                    v = np.frombuffer(g, np.int64, p)
                    own.append(np.full(p, c))
                    value.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.concatenate(value))], ["cid", "gram"])

        return each

    return common.arrow_map(sets.select("cid", "prefix", "grams"), make, "cid long, gram long")


class Trie:
    """Ordered sets as a compact prefix tree over their sorted rows."""

    def __init__(self, rows: list[np.ndarray], n: np.ndarray):
        """rows: dense n-gram numbers, ascending (0 is the commonest); n: whole sizes of the sets."""
        self.order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.rows, self.n = [rows[i] for i in self.order], n[self.order]
        self.lcp = [0] * len(rows)
        for i in range(1, len(rows)):
            a, b = self.rows[i - 1], self.rows[i]
            k = min(len(a), len(b))
            different = np.flatnonzero(a[:k] != b[:k])
            self.lcp[i] = int(different[0]) if len(different) else k

    def links(self, probes: list[np.ndarray], sizes: np.ndarray, vocabulary: int, label: np.ndarray, probe_label: np.ndarray) -> list[tuple[int, int]]:
        """(row, probe) pairs that join different labels by a link; the labels are merged in place."""
        flat = np.concatenate(probes) if probes else np.zeros(0, np.int64)
        who = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
        order = np.argsort(flat, kind="stable")
        who, at = who[order], np.searchsorted(flat[order], np.arange(vocabulary + 1))
        held = np.array([len(r) for r in self.rows])
        found: list[tuple[int, int]] = []
        label_at = np.array(self.order)
        stack = [(0, len(self.rows), 0, np.zeros(len(probes), np.int64), np.ones(len(probes), bool))] if self.rows else []
        while stack:
            lo, hi, depth, overlap, alive = stack.pop()
            end = len(self.rows[lo]) if hi - lo == 1 else min(min(self.lcp[lo + 1 : hi]), len(self.rows[lo]))
            if end > depth:
                grams = self.rows[lo][depth:end]
                hit = np.concatenate([who[at[g] : at[g + 1]] for g in grams.tolist()])
                overlap = overlap + np.bincount(hit, minlength=len(probes))
            own = label[label_at[lo:hi]]
            least, most, rest = int(self.n[lo:hi].min()), int(self.n[lo:hi].max()), int(held[lo:hi].max()) - end
            alive = alive & ((OF + LEAST) * (overlap + rest) >= LEAST * (least + sizes)) & (OF * sizes >= LEAST * least) & (LEAST * sizes <= OF * most)
            if (own == own[0]).all():
                alive = alive & (probe_label != own[0])
            if not alive.any():
                continue
            first = lo
            while first < hi and len(self.rows[first]) == end:  # sets that end here
                row = int(label_at[first])
                near = np.flatnonzero(alive & ((OF + LEAST) * overlap >= LEAST * (int(self.n[first]) + sizes)) & (probe_label != label[row]))
                for p in near.tolist():
                    if probe_label[p] != label[row]:
                        found.append((row, p))
                        old, new = probe_label[p], label[row]
                        probe_label[probe_label == old] = new
                        label[label == old] = new
                first += 1
            if first < hi:
                cuts = [first, *(i for i in range(first + 1, hi) if self.lcp[i] == end), hi]
                stack += [(a, b, end, overlap, alive) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return found


def trie_links(left: tuple, right: tuple | None) -> list[tuple[int, int]]:
    """Spanning links between (cids, n, grams, codes, labels) of one chunk, or of two."""
    sides = [left] if right is None else [left, right]
    grams = np.concatenate([g for s in sides for g in s[2]])
    codes = np.concatenate([c for s in sides for c in s[3]])
    value, at, dense = np.unique(grams, return_index=True, return_inverse=True)
    rank = np.empty(len(value), np.int64)
    rank[np.lexsort((value, -codes[at].astype(np.int64)))] = np.arange(len(value))  # commonest first
    dense = rank[dense]
    cut = np.cumsum([len(g) for s in sides for g in s[2]])
    rows = [np.sort(r) for r in np.split(dense, cut[:-1])]
    labels = np.concatenate([s[4] for s in sides])
    k = len(left[0])
    if right is None:
        n, label = np.array(left[1]), labels.copy()
        return [(left[0][a], left[0][b]) for a, b in Trie(rows, n).links(rows, n, len(value), label, label)]
    merged = labels.copy()
    found = Trie(rows[:k], np.array(left[1])).links(rows[k:], np.array(right[1]), len(value), merged[:k], merged[k:])
    return [(left[0][a], right[0][b]) for a, b in found]


def _join_cells(members: DataFrame) -> DataFrame:
    """members: cell, side, cid, n, grams, codes, label.  Links a, b found within each cell."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int")).repartition(parts, "part").sortWithinPartitions("part", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def join():
            sides = [tuple(np.array(x) if i in (1, 4) else x for i, x in enumerate(zip(*held[s], strict=True))) for s in sorted(held)]
            found = trie_links(sides[0], sides[1] if len(sides) > 1 else None) if len(sides) > 1 or len(held[min(held)]) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for cell, side, cid, n, grams, codes, label in zip(*(batch.column(c).to_pylist() for c in ("cell", "side", "cid", "n", "grams", "codes", "label")), strict=True):
                if now is not None and cell != now and held:
                    yield from join()
                    held = {}
                now = cell
                held.setdefault(side, []).append((cid, n, np.frombuffer(grams, np.uint64), np.frombuffer(codes, np.uint16), label))
        if held:
            yield from join()

    return dealt.mapInArrow(run, "a long, b long")


def _members(sets: DataFrame, whole: DataFrame) -> DataFrame:
    """sets: cid, n, grams, codes; whole: cid, comp.  The sets that stand in a component, with it and the number of its chunks,
    which are counted first, so that the sets themselves move once at most."""
    light = sets.select("cid", (F.octet_length("grams") / 8).alias("g")).join(whole, "cid")
    size = light.groupBy("comp").agg(F.count(F.lit(1)).alias("classes"), F.sum("g").alias("grams"))
    parts = F.greatest(F.ceil(F.col("classes") / CHUNK), F.ceil(F.col("grams") / CHUNK_GRAMS)).cast("int")
    size = common.written(size.select("comp", parts.alias("parts")), "sizes")
    return common.written(sets.select("cid", "n", "grams", "codes").join(whole.join(size, "comp"), "cid"), "members")


def _links(member: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """Spanning links a, b of the classes, from _members.  prefixes: cid, gram, the n-grams of which two sets that link share one;
    with them only what can still link stays in a large component after its chunks were joined."""
    cell = lambda *x: F.concat_ws("/", *(F.col(c).cast("string") if isinstance(c, str) else c for c in x))
    side = lambda k: F.lit(k).cast("int").alias("side")
    each = ["cid", "n", "grams", "codes"]
    deal = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    alone = lambda rows, label: rows.select(cell("comp", deal("parts")).alias("cell"), side(0), *each, label.alias("label"))

    found = common.written(_join_cells(alone(member, F.col("cid"))), "links")
    if not member.where("parts > 1").take(1):
        return found
    # representatives of what the chunks found join the chunks
    inside = common.bucketed(member.where("parts > 1"), "cid")
    ids = inside.select("cid", "comp")
    reps = _labelled(ids, found).where("cid = label")
    count = reps.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("rep_parts"))
    second = inside.drop("comp").join(reps.join(count, "comp"), "cid").select(cell("comp", deal("rep_parts")).alias("cell"), side(0), *each, "label")
    found = common.written(found.union(_join_cells(second)), "links")
    light = common.written(_labelled(ids, found), "labels")
    if prefixes is None:
        labels = common.written(inside.drop("comp").join(light, "cid"), "labelled")
    else:
        # an n-gram whose classes are one part already has no link to give
        own = prefixes.join(light.select("cid", "label"), "cid")
        open_ = common.written(own.groupBy("gram").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("cid").alias("b")).where("x <> y").select("gram", "b"), "open")
        whole = components(own.join(open_, "gram").select(F.col("cid").alias("a"), "b").where("a <> b").distinct())
        rest = _members(inside.select(*each), whole.select(F.col("node").alias("cid"), F.col("label").alias("comp")))
        labels = common.written(rest.join(light.select("cid", "label"), "cid"), "labelled")
        found = common.written(found.union(_join_cells(alone(labels.where("parts = 1"), F.col("label")))), "links")
        labels = labels.where("parts > 1")
        if not labels.take(1):
            return found
    # chunks of one part each, and of small parts together; those with different parts meet
    per = labels.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.octet_length("grams") / 8).alias("grams"))
    own = F.greatest(F.ceil(F.col("classes") / CHUNK), F.ceil(F.col("grams") / CHUNK_GRAMS)).cast("int")
    per = per.withColumn("pure", F.col("classes") >= CHUNK // 4).withColumn("own", own)
    loose = per.where("not pure").groupBy("comp").agg(F.greatest(F.ceil(F.sum("classes") / CHUNK), F.ceil(F.sum("grams") / CHUNK_GRAMS)).cast("int").alias("loose"))
    per = per.join(loose, "comp", "left").select("comp", "label", "pure", "own", "loose")
    name = F.when(F.col("pure"), F.concat_ws(":", F.lit("p"), F.col("label").cast("string"), deal("own").cast("string"))).otherwise(F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("cid"), F.col("loose")).cast("string")))
    chunked = common.written(labels.join(per, ["comp", "label"]).select("comp", name.alias("chunk"), F.when(F.col("pure"), F.col("label")).alias("pure"), *each, "label"), "chunks")
    chunks = chunked.select("comp", "chunk", "pure").distinct()
    x, y = chunks.select("comp", F.col("chunk").alias("x"), F.col("pure").alias("px")), chunks.select("comp", F.col("chunk").alias("y"), F.col("pure").alias("py"))
    cells = x.join(y, "comp").where("x <= y and not (px is not null and py is not null and px = py)")
    cells = common.written(cells.select("comp", cell("comp", "x", "y").alias("cell"), "x", "y"), "cells")
    lefts = chunked.join(cells.select("comp", F.col("x").alias("chunk"), "cell"), ["comp", "chunk"]).select("cell", side(0), *each, "label")
    rights = chunked.join(cells.where("x < y").select("comp", F.col("y").alias("chunk"), "cell"), ["comp", "chunk"]).select("cell", side(1), *each, "label")
    return common.written(found.union(_join_cells(lefts.union(rights))), "links")


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    label = components(links).withColumnRenamed("node", "cid")
    return member.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """One row a document: `key`, n_shingles, component_id, class_id (least key of the documents with an equal set).

    A text is lower-cased in A-Z; its set holds the distinct n-grams of `words` words; with fewer words the whole sequence
    is one n-gram.  Sets link when OF * intersection >= LEAST * union.  component_id: the least key that links reach.  A null
    text or one without words has an empty set, links with nothing and is a component of its own, as its row is.  Rows with
    a null key link as others do but name no component.  N-grams are compared by 64-bit hashes and a
    class goes by 63 bits of its set.
    """
    common.ready(docs.sparkSession)
    parts = common.partitions(docs, RANGE_BYTES)
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    with common.scratch():
        return common.keep(_components(slim, key, words, parts))


def _components(slim: DataFrame, key: str, words: int, parts: int) -> DataFrame:
    own = common.written(_digests(slim, words), "digests")
    classes = own.where("n > 0").groupBy("cid").agg(F.min("k").alias("class_id"))
    with common.scratch():
        shared = _shared(_postings(slim.select("t"), words, 2 * parts), 2 * parts)
        sets = common.bucketed(_survivors(shared, 2 * parts), "cid")
        grams = common.written(_prefix_grams(sets), "prefixes")
        star = grams.groupBy("gram").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("many")).where("many > 1").select("gram", "b")
        whole = components(grams.join(star, "gram").select(F.col("cid").alias("a"), "b").where("a <> b").distinct())
        member = common.keep(_members(sets, whole.select(F.col("node").alias("cid"), F.col("label").alias("comp"))))
        prefixes = common.keep(grams)
    label = components(_links(member, prefixes)).withColumnRenamed("node", "cid")
    labelled = common.written(classes.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid")), "labelled")
    # written, so that a large component's label is a plain exchange, which Spark splits
    least = common.written(labelled.groupBy("label").agg(F.min("class_id").alias("component_id")), "least")
    named = common.written(labelled.join(least, "label").select("cid", "class_id", "component_id"), "named")
    many = own.where("n > 0").join(named, "cid").select("k", "n", "component_id", "class_id")
    alone = own.where("n = 0").select("k", "n", F.col("k").alias("component_id"), F.col("k").alias("class_id"))
    return common.written(many.union(alone).select(F.col("k").alias(key), F.col("n").alias("n_shingles"), "component_id", "class_id"), "components")
