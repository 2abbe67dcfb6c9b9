"""The registered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qaloom.llm.ann import nearest
from qaloom.llm.bpe_codec import codec_digest
from qaloom.llm.common import table
from qaloom.llm.ngram_join import ngram_components
from qaloom.llm.oracles import JACCARD_SQL, QUALITY_SQL
from qaloom.llm.packing import best_fit_packing
from qaloom.llm.passage_dedup import repeated_passages
from qaloom.llm.preference import PREFERENCE_SQL, preference_query
from qaloom.llm.quality import quality_verdicts
from qaloom.llm.sharding import shard_by_bytes
from qaloom.llm.token_counts import token_counts
from qaloom.llm.token_files import token_file_digest


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op3_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors["vec_id"] % 100 == 0, 10)


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_query(table(spark, sf_dir, "conversations"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_codec": op1_bpe_codec,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_passage_dedup": op3_passage_dedup,
        "op4_sampled_splitters": op4_sampled_splitters,
        "op5_quality_rules": op5_quality_rules,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_preference_format": op7_preference_format,
        "op8_token_files": op8_token_files,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": JACCARD_SQL, "op5_quality_rules": QUALITY_SQL, "op7_preference_format": PREFERENCE_SQL}
