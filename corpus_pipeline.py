"""A training corpus from raw documents, stage by stage; each stage reads what the one before it kept.

1. quality rules: documents that the base rules or their group's thresholds reject go;
2. n-gram Jaccard join: of each group of near copies the one with the least doc_id stays;
3. substring dedup: passages that an earlier document holds are cut from the texts;
4. best-fit packing: what is left becomes sequences of 2048 tokens.

Stages that number rows write them once with their number: places depend on how files are split, and so on the executors.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.llm.common import bucketed, keep, scratch, table, written
from qaloom.llm.ngram_join import ngram_components
from qaloom.llm.packing import best_fit_packing
from qaloom.llm.passage_dedup import without_repeats
from qaloom.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, unchanged.  Null, empty and short texts fail; repeated rows pass or fail alike."""
    return quality_filter(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the least doc_id (null first).  Rows, not doc_ids, are the documents: of repeated rows one
    stays too.  Texts without words are groups of their own; an empty table gives an empty one."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # the input's names can't clash with the row number's
    own = {c: names[docs.columns.index(c)] for c in ("doc_id", "text")}
    numbered = bucketed(docs.toDF(*names).withColumn("row_no", F.monotonically_increasing_id()), "row_no")  # the texts move once, here
    keyed = numbered.select(F.struct(F.col(own["doc_id"]).alias("doc_id"), "row_no").alias("row_key"), F.col(own["text"]).alias("text"))
    group = ngram_components(keyed, key="row_key")
    stays = group.where(F.col("row_key") == F.col("component_id")).select("row_key.row_no")
    return numbered.join(stays, "row_no", "left_semi").select(*names).toDF(*docs.columns)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, passages that an earlier document holds cut out, n_chars counted anew (null for a null text).  Other columns stay,
    whatever their names."""
    out = without_repeats(docs)
    count = F.length("text").cast("long")
    return out.withColumn("n_chars", count) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, a null or empty text's end token too, in sequences of 2048 tokens."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_near_copies),
    ("substring_dedup", passages_once),
    ("best_fit_packing", packed),
]

#: Sketches, components and packing iterate, which SQL can't do over whole tables: tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():  # what a stage leaves behind goes when its rows are written
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
