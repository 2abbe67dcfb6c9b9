"""Quality rules whose thresholds adapt to each language and source.

1. Every text is measured (`measures`).
2. Each measure's values go to quantile sketches, one per language and source: counts in buckets
   whose bounds grow by a fixed ratio, so any quantile is known to within that ratio.  Sketches of
   the same bounds merge by adding counts, whatever the order: tasks pre-aggregate them, and those of
   a language's sources, or of all languages, add up to the wider ones that small groups fall back to.
3. A fence beyond the upper quartiles of the sketch replaces the fixed cutoff.  The thresholds, a row
   a group, are joined to the measures, and rows beyond any of them go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from qaloom.llm import common
from qaloom.llm.pretoken import text_blocks
from qaloom.llm.textmath import Block, mix, sums, windows

# Fixed values of the contract: symbols, the size of a repeated window, least words, most repeated words in a hundred.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = b"#*$%&|<>", 8, 20, 30
#: Ratio of neighbouring bucket bounds, as (numerator, denominator): 1/16 relative error of a quantile.
RATIO = 17 / 16
#: A group with fewer texts falls back to its language, then to all.
SUPPORT = 200
#: Rates are shifted by this before they are bucketed, so that 0 has a bucket.
SHIFT = 1 / 256


def _repeated(block: Block) -> np.ndarray:
    """Whether each word stands in a window of WINDOW words that its text holds twice or more."""
    codes = block.codes()
    n = len(codes)
    marked = np.zeros(n, bool)
    if n < WINDOW:
        return marked
    text = np.repeat(np.arange(len(block.first) - 1), np.diff(block.first))
    valid = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
    keyed = windows(codes, WINDOW)[valid] ^ mix(text[valid].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keyed, kind="stable")
    run = keyed[order]
    same = np.zeros(len(run) + 1, bool)
    same[1:-1] = run[1:] == run[:-1]
    twice = same[:-1] | same[1:]
    at, head = valid[order[twice]], valid[order[np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(run))))[twice]]]
    if any((codes[at + k] != codes[head + k]).any() for k in range(WINDOW)):  # two windows of a text share a hash: word by word
        whole = np.stack([text[valid], *(codes[valid + k] for k in range(WINDOW))], axis=1)
        _, which, many = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
        at = valid[many[which.ravel()] > 1]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change[:n]) > 0


def _duplicate_lines(block: Block) -> np.ndarray:
    """Per text: lines with a word that equal an earlier line of the text."""
    b, offsets = block.bytes, block.offsets
    texts = len(offsets) - 1
    data = np.insert(b, offsets[1:], 0x0A)  # every line ends, the last of a text too
    ends = np.flatnonzero(data == 0x0A) + 1
    bounds = np.concatenate([[0], ends]).astype(np.int32)
    lines = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.insert(block.inside, offsets[1:], False), out=filled[1:])
    has_word = np.diff(filled[bounds]) > 0
    text = np.searchsorted(offsets[1:] + np.arange(1, texts + 1), ends, "left")
    key = (text * (len(lines) + 1) + lines)[has_word]
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(text[has_word][again], minlength=texts)


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    block = Block(column)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    head = (block.bytes & 0xC0) != 0x80
    return {
        "n_words": np.diff(block.first),
        "word_chars": sums(head & block.inside, block.offsets),
        "n_symbols": sums(symbol[block.bytes], block.offsets),
        "n_dup_lines": _duplicate_lines(block),
        "n_repeat_words": sums(_repeated(block), block.first),
    }


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` with the five measures; a null text has none of anything."""
    common.ready(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    slim = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(keep)), docs[text].alias("t"))
    carried = slim.columns[:-1]

    def make():
        def each(batch: pa.RecordBatch):
            for first, block in text_blocks(batch.column(len(carried)), common.WORD_BLOCK_BYTES):
                got = measured(block)
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(block)) for c in batch.columns[:-1]), *(pa.array(got[n].astype(np.int64)) for n in NAMES)], [*carried, *NAMES])

        return each

    kinds = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = common.arrow_map(slim, make, kinds + ", ".join(f"{n} long" for n in NAMES))
    return out.toDF(*keep, *NAMES)


def _rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / words, "word_length": F.col("word_chars") / words}


#: Fences: quartile +- REACH x interquartile range +- the measure's margin, which keeps groups without spread from
#: rejecting what differs by next to nothing.
REACH = 3.0
MARGIN = {"symbols": 0.1, "dup_lines": 0.1, "word_length": 3.0}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bucket(x: Column) -> Column:
    return F.floor(F.log(x + F.lit(SHIFT)) / F.lit(math.log(RATIO))).cast("int")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, measure, bucket, n: one sketch a group and measure, of the texts that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(x).alias("bucket")) for m, x in _rates().items())))
    rows = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("e"))
    return rows.groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of wider groups: counts of equal buckets add up."""
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """by, measure, n and a column for each wanted quantile: the middle of the bucket in which it falls."""
    key = [*by, "measure"]
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.pow(F.lit(RATIO), F.col("bucket") + 0.5) - F.lit(SHIFT)
    counted = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
    found = [F.min(F.when(F.col("upto") >= q * F.col("all"), value)).alias(name) for name, q in at.items()]
    return counted.groupBy(*key).agg(F.first("all").alias("n"), *found)


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and, for each measure, its fences: of the group if it has SUPPORT texts, else of its language, else of all."""
    at = {"q1": 0.25, "q3": 0.75}
    level = [quantiles(sketch if len(by) == 2 else merged(sketch, by), by, at) for by in (["lang", "source"], ["lang"], [])]
    groups = sketch.select("lang", "source", "measure").distinct()
    out = groups
    for k, (by, q) in enumerate(zip((["lang", "source"], ["lang"], []), level, strict=True)):
        q = q.select(*(F.col(c).alias(f"{c}_{k}") for c in [*by, "measure"]), F.when(F.col("n") >= SUPPORT if k < 2 else F.lit(True), F.struct("q1", "q3")).alias(f"q_{k}"))
        on = F.col("measure") == F.col(f"measure_{k}")
        for c in by:
            on &= F.col(c).eqNullSafe(F.col(f"{c}_{k}"))
        out = out.join(q, on, "left").drop(*(f"{c}_{k}" for c in [*by, "measure"]))
    best = F.coalesce("q_0", "q_1", "q_2")
    out = out.withColumn("q1", best["q1"]).withColumn("q3", best["q3"])
    wide = []
    for m, margin in MARGIN.items():
        reach = REACH * (F.col("q3") - F.col("q1")) + margin
        wide += [F.max(F.when(F.col("measure") == m, F.col("q1") - reach)).alias(f"least_{m}"), F.max(F.when(F.col("measure") == m, F.col("q3") + reach)).alias(f"most_{m}")]
    return out.groupBy("lang", "source").agg(*wide)


#: Thresholds are broadcast up to this many groups; beyond it the join is dealt by group and salt.
MOST_BROADCAST, SALTS = 100_000, 64


def judged(measured: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds base_failed and kept.  `limits`: a written table of thresholds()."""
    own = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(c for c in limits.columns if c not in ("lang", "source")))
    on = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    if limits.count() <= MOST_BROADCAST:
        joined = measured.join(F.broadcast(own), on, "left")
    else:
        salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("_own", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, on & (F.col("_own") == F.col("_salt")), "left")
    inside = F.lit(True)
    for m, x in _rates().items():
        inside &= F.coalesce(x.between(F.col(f"least_{m}"), F.col(f"most_{m}")), F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside).select(*measured.columns, "base_failed", "kept")


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: `key`, the five measures, base_failed and kept.

    A null or empty text has no words, so it fails the base rules.  Null languages and sources are groups of their own.
    Repeated rows are judged alike.  An empty table gives no rows.
    """
    slim = docs.select(docs[key].alias("k"), docs[text].alias("t"), docs[lang].alias("lang"), docs[source].alias("source"))
    got = common.written(measures(slim, "t", ["k", "lang", "source"]), "measures")
    limits = common.written(thresholds(sketches(got)), "thresholds")
    return judged(got, limits).select(F.col("k").alias(key), *NAMES, "base_failed", "kept")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns, whatever those are called.  The texts are measured twice rather
    than moved.  Null, empty and short texts fail; repeated rows stay or go alike; an empty table stays empty."""
    slim = docs.select(docs[text].alias("t"), docs[lang].alias("lang"), docs[source].alias("source"))
    limits = common.written(thresholds(sketches(measures(slim, "t", ["lang", "source"]))), "thresholds")
    names = [f"_in{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    own = {c: names[docs.columns.index(c)] for c in (text, lang, source)}
    kept = judged(measures(inner, own[text]), limits, own[lang], own[source]).where("kept")
    return kept.select(*names).toDF(*docs.columns)
